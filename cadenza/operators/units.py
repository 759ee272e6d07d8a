"""Quantities recorded in different units: a graph of conversions, units found in the data, common units out."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import with_chunks

# Affine conversions (from, to, scale, offset), to = scale * from + offset.
CONVERSIONS = [
    ("0.1mm", "mm", 0.1, 0.0),
    ("mm", "cm", 0.1, 0.0),
    ("cm", "m", 0.01, 0.0),
    ("in", "cm", 2.54, 0.0),
    ("ns", "us", 1e-3, 0.0),
    ("us", "ms", 1e-3, 0.0),
    ("ms", "s", 1e-3, 0.0),
    # said twice, so that the check for contradictions has something to check
    ("in", "mm", 25.4, 0.0),
    ("m", "mm", 1000.0, 0.0),
    ("s", "ns", 1e9, 0.0),
]

# Spellings of units in headers and notes.
SPELLINGS = {
    "0.1mm": ["0.1 mm", "0.1mm", "1/10 mm", "tenths of a millimetre", "tenths of mm", "tenth mm"],
    "mm": ["mm", "millimetres", "millimeters", "millimetre"],
    "cm": ["cm", "centimetres", "centimeters", "centimetre"],
    "m": ["m", "metres", "meters", "metre"],
    "in": ["in", "inch", "inches"],
    "ns": ["ns", "nsec", "nanoseconds"],
    "us": ["us", "µs", "μs", "usec", "microseconds"],
    "ms": ["ms", "msec", "milliseconds"],
    "s": ["s", "sec", "seconds"],
}


def compose(edges: list[tuple[str, str, float, float]], tolerance: float = 1e-9) -> list[tuple[str, str, float, float, int]]:
    """Shortest compositions (from, to, scale, offset, hops) between all units that the edges connect.

    Every edge counts in both directions. Cycles are checked: if the shortest way to a unit, followed by
    an edge, disagrees with the shortest way to that edge's end, the graph contradicts itself and a ValueError says where.
    The table has as many rows as pairs of units, whatever the data's size."""
    out: dict[str, list[tuple[str, float, float]]] = {}
    for a, b, k, c in edges:
        if k == 0:
            raise ValueError(f"{a} -> {b}: a scale of 0 can't be inverted")
        out.setdefault(a, []).append((b, k, c))
        out.setdefault(b, []).append((a, 1 / k, -c / k))
    rows = []
    for a in out:
        at, todo = {a: (1.0, 0.0, 0)}, deque([a])
        while todo:
            x = todo.popleft()
            k0, c0, hops = at[x]
            for y, k, c in out[x]:
                new = (k0 * k, c0 * k + c)
                if y not in at:
                    at[y] = (*new, hops + 1)
                    todo.append(y)
                elif abs(at[y][0] - new[0]) > tolerance * abs(new[0]) or abs(at[y][1] - new[1]) > tolerance * max(1.0, abs(new[1])):
                    raise ValueError(f"conversions from {a} to {y} disagree: {at[y][:2]} and {new}")
        rows += [(a, b, *v) for b, v in at.items()]
    return sorted(rows)


def conversion_table(spark: SparkSession, edges: list[tuple[str, str, float, float]] | None = None) -> DataFrame:
    return spark.createDataFrame(compose(edges or CONVERSIONS), "unit string, target string, scale double, offset double, hops int")


def to_common(df: DataFrame, value: str, unit: str, target: Column | str, out: str, conversions: DataFrame) -> DataFrame:
    """Adds `out`: the value in unit `target`, by an equi-join on (source unit, canonical target).

    The conversion table has one row per pair of units, so it is broadcast. Null or unknown units, or units of another
    quantity than the target's, give null; rows stay. NaN stays NaN."""
    c = conversions.select(F.col("unit").alias("__u"), F.col("target").alias("__t"), "scale", "offset")
    t = F.lit(target) if isinstance(target, str) else target
    j = df.withColumn("__want", t).join(F.broadcast(c), (F.col(unit) == F.col("__u")) & (F.col("__want") == F.col("__t")), "left")
    return j.withColumn(out, F.col(value) * F.col("scale") + F.col("offset")).drop("__u", "__t", "__want", "scale", "offset")


def declared_unit(field: str, description: Column, note: Column) -> Column:
    """Unit named for `field` in a header's description or else in an operator's note; null if none is. Notes must name the field."""
    words = sorted(((w, u) for u, ws in SPELLINGS.items() for w in ws), key=lambda x: (x[0] == "in", -len(x[0])))  # "in" last: it is a preposition too
    said = F.coalesce(
        F.nullif(F.regexp_extract(description, r"(?:\(([^()]*)\)|\[[^\]]*\]|, in [^,]+)\s*$", 0), F.lit("")),
        F.when(note.contains(field), F.regexp_replace(F.regexp_extract(note, rf"([^;,]*{field}[^;,]*)", 1), field, " ")),
    )
    table = F.array(*[F.struct(F.lit(rf"(^|[^A-Za-z0-9./µμ]){w.replace('.', '[.]')}($|[^A-Za-z0-9/])").alias("p"), F.lit(u).alias("u")) for w, u in words])
    return F.get(F.filter(F.transform(F.array(said), lambda x: F.get(F.filter(table, lambda t: F.rlike(x, t["p"])), F.lit(0))["u"]), lambda u: u.isNotNull()), F.lit(0))


def scales(target: str) -> dict[str, tuple[float, float]]:
    """(scale, offset) to `target` of every unit that the composed conversions lead to it."""
    return {u: (k, c) for u, t, k, c, _ in compose(CONVERSIONS) if t == target}


def nearest_unit(value: Column, typical: float, target: str) -> Column:
    """The unit in which a value, converted to `target` by the composed conversions, comes nearest to `typical` (by ratio); null for null, NaN,
    zero or negative values. Whether the converted value is plausible is for the caller to judge (`plausible`)."""
    gap = [F.struct(F.abs(F.log((value * k + c) / typical)).alias("gap"), F.lit(u).alias("unit")) for u, (k, c) in sorted(scales(target).items())]
    return F.when((value > 0) & ~F.isnan(value), F.array_min(F.array(*gap))["unit"])


def plausible(common: Column, low: float, high: float, slack: float = 0.1) -> Column:
    """Whether a converted value lies between low and high, widened by `slack` (a share of the bound); null and NaN don't."""
    return F.coalesce((common >= low * (1 - slack)) & (common <= high * (1 + slack)) & ~F.isnan(common), F.lit(False))


def clock_units(
    df: DataFrame,
    *,
    source: str,
    idx: str,
    value: str,
    clock: str,
    out: str,
    jump: float = 16.0,
    min_votes: int = 3,
    chunk: int = 8192,
) -> DataFrame:
    """Adds `out`: the unit in which each `value` of a clock is given, judged by its speed against `clock` (s).

    The candidates are the units that the composed conversions lead to seconds. Consecutive readings vote by the advance of the value against the clock's, for the unit under
    which it comes nearest to 1 in seconds. A stretch ends where the value falls (restart) or leaps by more
    than a factor `jump` (another unit); its unit is the most frequent vote, so that late receipts and lost rows don't matter.
    Stretches with fewer than `min_votes` votes take the unit under which they continue the stretch before or after.
    Works on (source, chunk) with a halo, not on whole sources. Rows delivered twice come out once. Null or NaN
    values get a null unit; rows without clock have no vote, but belong to their stretch."""
    d = with_chunks(df, idx, chunk, 64, "__c")
    w = Window.partitionBy(source, "__c").orderBy(F.col(idx).asc_nulls_first())
    d = d.withColumn("__again", F.coalesce(F.lag(idx).over(w) == F.col(idx), F.lit(False))).filter("not __again")
    v, t = F.nanvl(F.col(value), F.lit(None).cast("double")), F.nanvl(F.col(clock), F.lit(None).cast("double"))
    d = d.withColumn("__v", v).withColumn("__t", t)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__last", F.last(F.when(F.col("__v").isNotNull(), F.struct("__v", "__t")), True).over(before))
    d = d.withColumn("__pv", F.col("__last")["__v"]).withColumn("__pt", F.col("__last")["__t"])
    V, P = F.col("__v"), F.col("__pv")
    far = (V < P) | (V > P * jump) | (P <= 0)
    d = d.withColumn("__seg", F.sum(F.when(V.isNotNull() & (P.isNull() | far), 1).otherwise(0)).over(w))
    ratio = F.when(~far & (V > P) & (F.col("__t") > F.col("__pt")), (V - P) / (F.col("__t") - F.col("__pt")))
    units = sorted(scales("s").items(), key=lambda x: -x[1][0])
    speed = [F.struct(F.abs(F.log(ratio * k)).alias("gap"), F.lit(j).alias("k")) for j, (_, (k, _)) in enumerate(units)]
    d = d.withColumn("__k", F.when(ratio > 0, F.array_min(F.array(*speed))["k"]))
    s = Window.partitionBy(source, "__c", "__seg")
    votes = [F.sum(F.when(F.col("__k") == k, 1).otherwise(0)).over(s) for k in range(len(units))]
    d = d.withColumn("__n", F.array(*votes)).withColumn("__most", F.array_max("__n"))
    d = d.withColumn("__sure", F.when(F.col("__most") >= min_votes, F.array_position("__n", F.col("__most")).cast("int") - 1))
    known = F.when(V.isNotNull() & F.col("__sure").isNotNull(), F.struct(F.col("__sure").alias("k"), V.alias("v"), F.col("__t").alias("t")))
    d = d.withColumn("__known", known)
    back = Window.partitionBy(source, "__c").orderBy(F.col(idx).desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__p", F.last("__known", True).over(before)).withColumn("__q", F.last("__known", True).over(back))
    to_s = F.array(*[F.struct(F.lit(k).alias("scale"), F.lit(c).alias("offset")) for _, (k, c) in units])
    sec = lambda val, k: val * F.get(to_s, k)["scale"] + F.get(to_s, k)["offset"]

    def miss(n: Column, k: Column) -> Column:
        """By how many seconds a value read in unit k misses the line through a known neighbour n, and how far k is from its unit."""
        g = F.abs((sec(V, k) - sec(n["v"], n["k"])) - F.coalesce(F.col("__t") - n["t"], F.lit(0.0)))
        return F.struct(F.coalesce(g, F.lit(float("inf"))).alias("g"), F.abs(k - F.coalesce(n["k"], F.lit(9))).alias("change"), k.alias("k"))

    ks = F.array(*[F.lit(k) for k in range(len(units))])
    best = F.array_min(F.transform(F.array("__p", "__q"), lambda n: F.array_min(F.transform(ks, lambda k: miss(n, k)))))
    voted = F.when(F.col("__most") > 0, F.array_position("__n", F.col("__most")).cast("int") - 1)
    k = F.coalesce(F.col("__sure"), F.when(best["g"] < 60, best["k"]), voted)
    name = F.get(F.array(*[F.lit(u) for u, _ in units]), k)
    d = d.withColumn(out, F.when(V.isNotNull() & k.isNotNull(), name)).filter("not __halo")
    return d.drop(*[c for c in d.columns if c.startswith("__")])
