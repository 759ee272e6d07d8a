"""Numeric operators over ordered samples: differences, derivatives, smoothing, rates, synthesised times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .masks import CHUNK, in_chunks, ordered, with_position


def seconds(ts: str | Column) -> Column:
    """Seconds since 1970 of a naive timestamp, as double."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz")) / 1e6


def gradient(x: Column, t: Column, w: WindowSpec) -> Column:
    """Derivative on uneven times: second order inside, first differences at the ends, null where two times are equal."""
    xp, xn, tp, tn = F.lag(x).over(w), F.lead(x).over(w), F.lag(t).over(w), F.lead(t).over(w)
    hs, hd = t - tp, tn - t
    inner = F.try_divide(hs * hs * xn + (hd * hd - hs * hs) * x - hd * hd * xp, hs * hd * (hs + hd))
    return F.when(tp.isNull(), F.try_divide(xn - x, hd)).when(tn.isNull(), F.try_divide(x - xp, hs)).otherwise(inner)


def with_gradient(df: DataFrame, keys: list[str], order: str, time: str, values: dict[str, str], size: int = CHUNK) -> DataFrame:
    """Adds for each name -> column of `values` the derivative of the column on `time`, over chunks of positions; a null in a neighbour makes it null."""
    d, w = in_chunks(with_position(df, keys, order, size), keys, 1, size)
    d = d.withColumns({out: gradient(F.col(x), F.col(time), w) for out, x in values.items()})
    return d.filter("not __halo").select(*df.columns, *values)


def smooth(df: DataFrame, keys: list[str], order: str, value: str, width: int, out: str, size: int = CHUNK) -> DataFrame:
    """Adds i, n and the centred moving mean over `width` samples; near the ends windows are one sample shorter than a clipped one."""
    h = width // 2
    if size < width:
        raise ValueError("a chunk must hold a window")
    d, w = in_chunks(with_position(df, keys, order, size), keys, h, size)
    mid = F.avg(value).over(w.rowsBetween(-h, (width - 1) // 2))
    head = F.avg(value).over(w.rowsBetween(-h, h - 1))
    tail = F.avg(value).over(w.rowsBetween(-(h - 1), h))
    d = d.withColumn(out, F.when(F.col("i") < h, head).when(F.col("n") - 1 - F.col("i") < h, tail).otherwise(mid))
    return d.filter("not __halo").drop("__halo", "__c")


def rates(df: DataFrame, keys: list[str], order: str, time: str) -> DataFrame:
    """(keys, n, median_rate, mean_rate, t_first, t_last) from the differences of `time` (seconds); rates of series with one sample are null."""
    d = df.select(*keys, F.col(time).alias("t"), (F.col(time) - F.lag(time).over(ordered(keys, order))).alias("dt"))
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile("dt", 0.5).alias("med"), F.avg("dt").alias("mean"), F.min("t").alias("t_first"), F.max("t").alias("t_last"))
    return g.select(*keys, "n", F.try_divide(F.lit(1.0), "med").alias("median_rate"), F.try_divide(F.lit(1.0), "mean").alias("mean_rate"), "t_first", "t_last")


def stable_rate_index(df: DataFrame, keys: list[str], order: str, time: str, eps_hz: float = 1.0, width_s: float = 1.0) -> DataFrame:
    """(keys, stable): first position from which the moving mean rate is within eps_hz of the mean rate, plus one; null if there is none.

    The moving mean runs over n differences, n = rate*width rounded to even and made odd, and divides by n at the
    ends too. As n differs from series to series, it is taken from prefix sums: a join of each position with those n/2 away."""
    w = ordered(keys, order)
    d = with_position(df.select(*keys, order, F.col(time).alias("t")), keys, order)
    d = d.withColumn("dt", F.lead("t").over(w) - F.col("t"))
    g = d.groupBy(*keys).agg(F.avg("dt").alias("mean"), (F.count(F.lit(1)) - 1).alias("m")).filter("m > 0 and mean > 0")
    k = F.bround(1 / F.col("mean")).cast("long") * width_s
    g = g.withColumn("w", k.cast("long")).withColumn("w", F.col("w") + F.when(F.col("w") % 2 == 0, 1).otherwise(0)).withColumn("h", F.floor((F.col("w") - 1) / 2).cast("long"))
    cs = d.filter("dt is not null").withColumn("cs", F.sum("dt").over(w.rowsBetween(Window.unboundedPreceding, 0))).select(*keys, "i", "cs")
    at = cs.join(g, keys)
    up = cs.select(*keys, F.col("i").alias("hi"), F.col("cs").alias("cs_hi"))
    dn = cs.select(*keys, F.col("i").alias("lo"), F.col("cs").alias("cs_lo"))
    j = at.withColumn("hi", F.least(F.col("i") + F.col("h"), F.col("m") - 1)).join(up, [*keys, "hi"]).withColumn("lo", F.col("i") - F.col("h") - 1).join(dn, [*keys, "lo"], "left")
    ma = (F.col("cs_hi") - F.coalesce("cs_lo", F.lit(0.0))) / F.col("w")
    ok = F.abs(1 / F.col("mean") - F.try_divide(F.lit(1.0), ma)) < eps_hz
    return j.groupBy(*keys).agg((F.min(F.when(ok, F.col("i"))) + 1).alias("stable"))


def chunk_explode(df: DataFrame, keys: list[str], order: str, time: str, values: str) -> DataFrame:
    """(keys, chunk, pos, value, t): chunks of samples with one end time each, taken apart; sample times run evenly from the end
    of the chunk before. The first chunk takes its start from the mean distance of ends. Series with fewer than two chunks give no rows;
    of chunks with an odd width the first column is dropped."""
    w = ordered(keys, order)
    d = with_position(df, keys, order)
    prev = F.lag(time).over(w)
    every = Window.partitionBy(*keys)
    mean = (F.max(time).over(every) - F.min(time).over(every)) / (F.col("n") - 1)
    d = d.filter("n > 1").withColumn("mean", mean).withColumn("prev", F.coalesce(prev, F.col(time) - F.col("mean")))
    v = F.when(F.size(values) % 2 == 1, F.slice(values, 2, F.size(values))).otherwise(F.col(values))
    d = d.withColumn("v", v)
    e = d.select(*keys, F.col("i").alias("chunk"), "prev", F.col(time).alias("end"), F.size("v").alias("width"), F.posexplode("v").alias("pos", "value"))
    return e.select(*keys, "chunk", "pos", "value", (F.col("prev") + (F.col("pos") + 1) * (F.col("end") - F.col("prev")) / F.col("width")).alias("t"))


def linspace(i: Column, n: Column, start: Column, end: Column) -> Column:
    """The i-th of n evenly spaced values from start to end inclusive; start if n is 1."""
    return start + F.coalesce(F.try_divide(i * (end - start), n - 1), F.lit(0.0))


def uniform_times(df: DataFrame, keys: list[str], order: str, bounds: DataFrame, rate: float) -> DataFrame:
    """Last round((end-start)*rate) samples of each series, evenly spaced over its `bounds` (keys, start, end): adds k and t. Series without bounds don't come out; where the bounds ask for more samples than there are, all are kept."""
    d = with_position(df, keys, order).join(bounds, keys)
    keep = F.bround((F.col("end") - F.col("start")) * rate).cast("long")
    skip = F.greatest(F.lit(0).cast("long"), F.col("n") - keep)
    d = d.withColumn("skip", skip).filter("i >= skip").withColumn("k", F.col("i") - F.col("skip"))
    return d.withColumn("t", linspace(F.col("k"), F.col("n") - F.col("skip"), F.col("start"), F.col("end"))).drop("skip")


def endpoint_times(df: DataFrame, keys: list[str], order: str, bounds: DataFrame, rate: float, align: str = "end") -> DataFrame:
    """All samples, spaced over n/rate seconds that begin at `start` or stop at `end` of the bounds: adds i and t."""
    d = with_position(df, keys, order).join(bounds, keys)
    span = F.col("n") / rate
    a = F.col("end") - span if align == "end" else F.col("start")
    return d.withColumn("t", linspace(F.col("i"), F.col("n"), a, a + span))


def batch_times(batches: DataFrame, keys: list[str], order: str, count: str, time: str, rate: float) -> DataFrame:
    """(keys, batch, first_sample, offset, start): sample batches with a time of receipt each. `start` is the running duration less the first one's, plus the mean
    offset between times of receipt and running durations."""
    w = ordered(keys, order)
    d = with_position(batches, keys, order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    dur = F.sum(F.col(count) / rate).over(run)
    d = d.withColumn("dur", dur).withColumn("first_sample", (F.sum(count).over(run) - F.col(count)).cast("long")).withColumn("own", F.col(count) / rate)
    off = F.avg(F.col(time) - F.col("dur")).over(Window.partitionBy(*keys))
    d = d.withColumn("offset", off).withColumn("first", F.first("dur").over(w))
    return d.select(*keys, F.col("i").alias("batch"), "first_sample", "offset", (F.col("dur") - F.col("own") - F.col("first") + F.col("offset")).alias("start"))


def trim_beginning(df: DataFrame, keys: list[str], order: str, time: str, eps_hz: float = 1.0, width_s: float = 1.0) -> DataFrame:
    """Samples from the position on at which the rate is stable; series that never are fall out."""
    at = stable_rate_index(df, keys, order, time, eps_hz, width_s)
    return with_position(df, keys, order).join(at, keys).filter("i >= stable").drop("i", "n", "stable")


def mono(channels: Column) -> Column:
    """Mean of a sample's channels (an array); null if any channel is null or there is none."""
    total = F.aggregate(channels, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.when(F.size(channels) > 0, total / F.size(channels))


def positional_zip(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str, prefix: str = "r_") -> DataFrame:
    """The rows of both sides that have the same position in their recording, side by side: left columns, i, right columns with `prefix`. What one side has more falls out."""
    a = with_position(left, keys, left_order).drop("n")
    b = with_position(right, keys, right_order).drop("n")
    b = b.select(*keys, "i", *[F.col(c).alias(prefix + c) for c in right.columns if c not in keys])
    return a.join(b, [*keys, "i"]).select(*left.columns, "i", *[c for c in b.columns if c not in (*keys, "i")])
