"""Irregular readings onto a regular grid, by compact-kernel local polynomial regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fit_at_zero(s: list[Column], t: list[Column], degree: int, spread: float) -> Column:
    """Value at 0 of the weighted least-squares polynomial with moments s_k = sum(w d^k), t_k = sum(w d^k y);
    falls back to the next lower degree where the system is singular, or for a line where the readings' places vary by less than `spread` steps (standard
    deviation), so that readings close together aren't led far."""
    mean = F.try_divide(t[0], s[0])
    if degree == 0:
        return mean
    det1 = s[0] * s[2] - s[1] * s[1]
    line = F.when(det1 > spread * spread * s[0] * s[0], (t[0] * s[2] - t[1] * s[1]) / det1).otherwise(mean)
    if degree == 1:
        return line
    det2 = s[0] * (s[2] * s[4] - s[3] * s[3]) - s[1] * (s[1] * s[4] - s[2] * s[3]) + s[2] * (s[1] * s[3] - s[2] * s[2])
    top = t[0] * (s[2] * s[4] - s[3] * s[3]) - s[1] * (t[1] * s[4] - t[2] * s[3]) + s[2] * (t[1] * s[3] - t[2] * s[2])
    return F.when(det2 > 1e-9 * s[0] * s[0] * s[0], top / det2).otherwise(line)


def regular_grid(
    readings: DataFrame,
    grids: DataFrame,
    *,
    source: str = "recording_id",
    idx: str = "sample_idx",
    time: str = "t",
    value: str = "value",
    start: str = "grid_start",
    end: str = "grid_end",
    step: str = "grid_step",
    bandwidth: float = 2.5,
    degree: int = 1,
    min_support: float = 1.5,
    min_spread: float = 0.1,
    valid: tuple[float, float] | None = None,
    chunk: int = 4096,
) -> DataFrame:
    """One row per slot of every grid: (source, slot, t, value, support, readings, mark).

    Slot k covers start + k*step <= t < start + (k+1)*step, the last one ends at `end`. `readings` counts the
    readings in the slot. The value is a local polynomial of `degree` fitted at the slot's middle with tricube
    weights over `bandwidth` steps to either side; `support` is Kish's effective number of readings behind it.
    mark: 'observed' (the slot has a reading), 'filled' (none, but support >= min_support with readings on both
    sides of the slot's middle), 'missing' (value null). Readings outside `valid` count but get no weight, so that an observed slot may have a null value.

    Grids are cut into chunks of `chunk` slots. Readings cross the network once, as they are, to the chunks whose slots their kernel reaches (mostly one, near a
    border two), together with one row per chunk for its empty slots; copies are dropped, readings indexed to slots and moments summed
    up behind that one shuffle. So a task holds a chunk's readings at most as a stream, and a source with a third of all rows is spread over its chunks.
    Nulls: readings with null or NaN time or value, or without a grid, take no part; grids with a null bound or a step <= 0,
    or an end before the start, have no slots. Rows delivered twice (same source and idx) count once.
    Empty readings give all slots as missing. Other columns of either table are ignored."""
    g = (
        grids.select(F.col(source).alias("src"), F.col(start).cast("double").alias("g0"), F.col(end).cast("double").alias("g1"), F.col(step).cast("double").alias("gs"))
        .filter("gs > 0 and g1 > g0 and src is not null")
        .withColumn("slots", F.ceil((F.col("g1") - F.col("g0")) / F.col("gs")))
    )
    r = readings.select(F.col(source).alias("src"), F.col(idx).alias("i"), F.col(time).cast("double").alias("t"), F.col(value).cast("double").alias("y"))
    r = r.filter("src is not null and t is not null and not isnan(t) and y is not null and not isnan(y)")
    j = r.join(g, "src").filter((F.col("t") >= F.col("g0") - (bandwidth + 1) * F.col("gs")) & (F.col("t") < F.col("g1") + (bandwidth + 1) * F.col("gs")))
    u = (F.col("t") - F.col("g0")) / F.col("gs")
    j = j.withColumn("u", u)
    j = j.withColumn("lo", F.greatest(F.lit(0).cast("long"), F.ceil(F.col("u") - 0.5 - bandwidth).cast("long")))
    j = j.withColumn("hi", F.least(F.col("slots") - 1, F.floor(F.col("u") - 0.5 + bandwidth).cast("long"))).filter("hi >= lo")
    # the slot itself is found by comparison with its bounds, as a division may round over them
    k = F.floor("u").cast("long")
    k = k + F.when(F.col("t") >= F.col("g0") + (k + 1) * F.col("gs"), 1).when(F.col("t") < F.col("g0") + k * F.col("gs"), -1).otherwise(0)
    own = F.when((F.col("t") >= F.col("g0")) & (F.col("t") < F.col("g1")), k)
    cell = lambda c: F.floor(F.col(c) / chunk).cast("long")
    none = F.lit(None).cast("double")
    j = j.select("src", F.explode(F.sequence(cell("lo"), cell("hi"))).alias("c"), F.lit(True).alias("read"), "i", "u", "y", own.alias("own"), "lo", "hi", none.alias("g0"), none.alias("gs"))
    b = g.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / chunk).cast("long"))))
    b = b.select(
        "src", "c", F.lit(False).alias("read"), F.lit(None).cast(j.schema["i"].dataType).alias("i"), none.alias("u"), none.alias("y"), F.lit(None).cast("long").alias("own"),
        F.lit(0).cast("long").alias("lo"), (F.col("slots") - 1).alias("hi"), "g0", "gs",
    )
    e = j.unionByName(b).repartition("src", "c").dropDuplicates(["src", "c", "read", "i"])
    e = e.withColumn("slot", F.explode(F.sequence(F.greatest("lo", F.col("c") * chunk), F.least("hi", (F.col("c") + 1) * chunk - 1))))
    a = F.abs(F.col("u") - (F.col("slot") + 0.5)) / bandwidth
    ok = F.lit(True) if valid is None else F.col("y").between(*valid)
    w = F.when(F.col("read") & ok & (a < 1), F.pow(1 - F.pow(a, 3), 3)).otherwise(0.0)
    e = e.withColumn("d", F.coalesce(F.col("u") - (F.col("slot") + 0.5), F.lit(0.0))).withColumn("w", w).withColumn("y", F.coalesce("y", F.lit(0.0)))
    W, D, Y = F.col("w"), F.col("d"), F.col("y")
    moments = [F.sum(W * (F.pow(D, k) if k > 1 else D if k else F.lit(1.0))).alias(f"s{k}") for k in range(2 * degree + 1)]
    moments += [F.sum(W * Y * (F.pow(D, k) if k > 1 else D if k else F.lit(1.0))).alias(f"t{k}") for k in range(degree + 1)]
    agg = e.groupBy("src", "c", "slot").agg(
        F.max("g0").alias("g0"), F.max("gs").alias("gs"), F.count(F.when(F.col("own") == F.col("slot"), 1)).alias("readings"), F.sum(W * W).alias("ww"),
        F.max((W > 0) & (D <= 0)).alias("before"), F.max((W > 0) & (D >= 0)).alias("after"), *moments,
    )
    support = F.coalesce(F.try_divide(F.col("s0") * F.col("s0"), F.col("ww")), F.lit(0.0))
    fit = _fit_at_zero([F.col(f"s{k}") for k in range(2 * degree + 1)], [F.col(f"t{k}") for k in range(degree + 1)], degree, min_spread)
    mark = F.when(F.col("readings") > 0, "observed").when((F.col("support") >= min_support) & F.col("before") & F.col("after"), "filled").otherwise("missing")
    return (
        agg.withColumn("support", support)
        .withColumn("mark", mark)
        .select(
            F.col("src").alias(source), "slot", (F.col("g0") + (F.col("slot") + 0.5) * F.col("gs")).alias("t"),
            F.when(F.col("mark") != "missing", fit).alias("value"), "support", "readings", "mark",
        )
    )
