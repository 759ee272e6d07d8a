"""Approximate joins: nearest date, prior visit, intervals, as-of, nearest time.

Every join has an equality on its hard keys, so that it is a hash or sort-merge join which AQE may split where a key is skewed; none
broadcasts by hint."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _prefixed(df: DataFrame, on: list[str], prefix: str) -> DataFrame:
    return df.select(*on, *[F.col(c).alias(prefix + c) for c in df.columns if c not in on])


def _neighbours(left: DataFrame, right: DataFrame, on: list[str], at: str) -> DataFrame:
    """(on, at, before, after) for each distinct (on, at) of `left`: the last `at` of `right` not after it and the first not before it, by one sort of the distinct
    values of both sides in each direction, without pairing them."""
    there = F.col("__side") == 0
    u = left.select(*on, at).distinct().withColumn("__side", F.lit(1)).unionByName(right.select(*on, at).distinct().withColumn("__side", F.lit(0)))
    up = Window.partitionBy(*on).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*on).orderBy(F.desc(at), "__side").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("before", F.last(F.when(there, F.col(at)), True).over(up)).withColumn("after", F.last(F.when(there, F.col(at)), True).over(down))
    return u.filter(~there).drop("__side")


def nearest_date_join(left: DataFrame, right: DataFrame, on: list[str], left_date: str, right_date: str, offset: str, prefix: str = "r_") -> DataFrame:
    """Left join on `on`, keeping for each (keys, left date) the right rows nearest in time; adds the signed offset, right less left, in days.

    All ties stay. Right rows without a date take no part; a left row without any partner stays with nulls, one without a date
    falls out. Right columns get `prefix`, so clashing names are no problem. The nearest dates are found among the distinct dates; only their rows are joined."""
    stamp = lambda c: F.col(c).cast("timestamp_ntz")
    a = left.filter(F.col(left_date).isNotNull()).withColumn("__at", stamp(left_date))
    b = _prefixed(right.filter(F.col(right_date).isNotNull()), on, prefix).withColumn("__near", stamp(prefix + right_date))
    gap = lambda c: F.abs(F.timestamp_diff("MICROSECOND", F.col("__at"), F.col(c)))
    n = _neighbours(a, b.select(*on, F.col("__near").alias("__at")), on, "__at")
    least = F.least(gap("before"), gap("after"))
    n = n.select(*on, "__at", F.explode(F.array_distinct(F.filter(F.array(F.when(gap("before") == least, F.col("before")), F.when(gap("after") == least, F.col("after"))), lambda x: x.isNotNull()))).alias("__near"))
    d = a.join(n, [*on, "__at"], "left").join(b, [*on, "__near"], "left")
    d = d.withColumn(offset, F.timestamp_diff("MICROSECOND", F.col("__at"), F.col("__near")) / F.lit(86400e6))
    return d.select(*left.columns, *[c for c in b.columns if c not in (*on, "__near")], offset)


def visit_number(event: Column) -> Column:
    """Number after the first 'v' that precedes '_arm'; null without one."""
    return F.nullif(F.regexp_extract(event, r"v(\d+)_arm", 1), F.lit("")).try_cast("int")


def prior_visit_join(left: DataFrame, right: DataFrame, on: list[str], event: str, offset: str, prefix: str = "r_") -> DataFrame:
    """For each (keys, left visit) the right rows of the same or the nearest earlier visit; offset = left visit less right visit >= 0. Ties stay; left rows without such a partner don't come out."""
    a = left.withColumn("__at", visit_number(F.col(event))).filter("__at is not null")
    b = _prefixed(right, on, prefix).withColumn("__near", visit_number(F.col(prefix + event))).filter("__near is not null")
    n = _neighbours(a, b.select(*on, F.col("__near").alias("__at")), on, "__at").filter("before is not null").select(*on, "__at", F.col("before").alias("__near"))
    d = a.join(n, [*on, "__at"]).join(b, [*on, "__near"]).withColumn(offset, F.col("__at") - F.col("__near"))
    return d.select(*left.columns, *[c for c in b.columns if c not in (*on, "__near")], offset)


def interval_flag(series: DataFrame, intervals: DataFrame, keys: list[str], time: str, start: str, end: str, out: str, width: float, half_open: bool = False, last_by: str | None = None) -> DataFrame:
    """Boolean `out`: whether the sample's time (seconds) lies in any interval of its recording, ends included unless half_open; with `last_by` only in
    the recording's last interval by that column (nulls never are the last).

    Both sides are indexed by time buckets of `width` seconds: an interval is listed in each bucket it touches, a sample in its own, and the join is on
    (keys, bucket), so that neither a recording with a third of all rows nor many intervals meet in one task. Null times
    and inverted intervals match nothing. The series must not hold columns named like `start`, `end` or __b."""
    if last_by is not None:
        intervals = intervals.groupBy(*keys).agg(F.max_by(F.struct(F.col(start), F.col(end)), last_by).alias("__x")).select(*keys, "__x.*")
    iv = intervals.select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e")).filter("__s <= __e")
    iv = iv.withColumn("__b", F.explode(F.sequence(F.floor(F.col("__s") / width).cast("long"), F.floor(F.col("__e") / width).cast("long"))))
    iv = iv.groupBy(*keys, "__b").agg(F.collect_set(F.struct("__s", "__e")).alias("__iv"))
    d = series.withColumn("__b", F.floor(F.col(time) / width).cast("long")).join(iv, [*keys, "__b"], "left")
    t = F.col(time)
    inside = F.exists("__iv", lambda x: (t >= x["__s"]) & ((t < x["__e"]) if half_open else (t <= x["__e"])))
    return d.withColumn(out, F.coalesce(inside, F.lit(False))).drop("__b", "__iv")


def interval_number(series: DataFrame, intervals: DataFrame, keys: list[str], time: str, start: str, end: str, number: str, out: str, width: float) -> DataFrame:
    """Integer `out`: the highest number of the half-open intervals [start, end) that hold the sample, 0 without one (later intervals overwrite earlier ones). Indexed by time buckets like interval_flag."""
    iv = intervals.select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(number).alias("__n")).filter("__s < __e")
    iv = iv.withColumn("__b", F.explode(F.sequence(F.floor(F.col("__s") / width).cast("long"), F.floor(F.col("__e") / width).cast("long"))))
    iv = iv.groupBy(*keys, "__b").agg(F.collect_set(F.struct("__s", "__e", "__n")).alias("__iv"))
    d = series.withColumn("__b", F.floor(F.col(time) / width).cast("long")).join(iv, [*keys, "__b"], "left")
    t = F.col(time)
    hit = F.array_max(F.transform(F.filter("__iv", lambda x: (t >= x["__s"]) & (t < x["__e"])), lambda x: x["__n"]))
    return d.withColumn(out, F.coalesce(hit, F.lit(0))).drop("__b", "__iv")


def interval_labels(series: DataFrame, intervals: DataFrame, keys: list[str], time: str, start: str, end: str, label: str, out: str, width: float) -> DataFrame:
    """Array `out`: the distinct labels of the half-open intervals [start, end) that hold the sample, sorted, empty without one. One join for any number of labels,
    indexed by time buckets like interval_flag; null labels and inverted or empty intervals don't count."""
    iv = intervals.select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(label).alias("__n")).filter("__s < __e and __n is not null")
    iv = iv.withColumn("__b", F.explode(F.sequence(F.floor(F.col("__s") / width).cast("long"), F.floor(F.col("__e") / width).cast("long"))))
    iv = iv.groupBy(*keys, "__b").agg(F.collect_set(F.struct("__s", "__e", "__n")).alias("__iv"))
    d = series.withColumn("__b", F.floor(F.col(time) / width).cast("long")).join(iv, [*keys, "__b"], "left")
    t = F.col(time)
    hit = F.array_sort(F.array_distinct(F.transform(F.filter("__iv", lambda x: (t >= x["__s"]) & (t < x["__e"])), lambda x: x["__n"])))
    return d.withColumn(out, F.coalesce(hit, F.array().cast(f"array<{intervals.schema[label].dataType.simpleString()}>"))).drop("__b", "__iv")


def asof_marker(series: DataFrame, markers: DataFrame, keys: list[str], order: str, time: str, marker_time: str, marker: str, out: str, inclusive_end: bool = False, width: float = 3600.0) -> DataFrame:
    """`out`: the last marker at or before each sample. The last marker holds up to the series' last time, exclusive unless
    inclusive_end, and not at all if the series ends with or before it. Samples before the first marker get null.

    One union, sorted within time buckets of `width` seconds, instead of a range join; what holds at a bucket's start comes from one row per bucket, so that a
    recording is many tasks. Of markers at the same time the largest in value counts last. Null keys are a recording of their own; a null time gets null."""
    s = series.select(*keys, F.col(time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("string").alias("__m"), F.col(order).alias("__o"), F.struct(*series.columns).alias("__row"))
    m = markers.select(*keys, F.col(marker_time).alias("__t"), F.lit(0).alias("__side"), F.col(marker).cast("string").alias("__m"), F.lit(None).cast(series.schema[order].dataType).alias("__o"), F.lit(None).cast(s.schema["__row"].dataType).alias("__row"))
    u = s.unionByName(m).withColumn("__b", F.floor(F.col("__t") / width))
    w = Window.partitionBy(*keys, "__b").orderBy("__t", "__side", "__m", "__o").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("__last", F.last("__m", True).over(w))
    sample = F.col("__side") == 1
    c = u.groupBy(*keys, "__b").agg(F.max_by("__m", F.when(F.col("__m").isNotNull(), F.struct("__t", "__m"))).alias("__m"), F.max(F.when(sample, F.col("__t"))).alias("__te"), F.max(F.when(~sample, F.col("__t"))).alias("__me"))
    every = Window.partitionBy(*keys)
    up = every.orderBy(F.col("__b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    c = c.select(*keys, "__b", F.last("__m", True).over(up).alias("__held"), F.max("__te").over(every).alias("__te"), F.max("__me").over(every).alias("__me"))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "__b")]
    u = u.filter(sample).alias("a").join(c.alias("b"), on)
    t, te, me = F.col("a.__t"), F.col("b.__te"), F.col("b.__me")
    beyond = te > me
    hidden = (~beyond & (t >= me)) | (F.lit(not inclusive_end) & beyond & (t == te))
    return u.select("a.__row.*", F.when(t.isNotNull() & ~F.coalesce(hidden, F.lit(False)), F.coalesce("a.__last", "b.__held")).alias(out))


def nearest_last_writer(left: DataFrame, right: DataFrame, keys: list[str], left_no: str, left_time: str, right_no: str, right_time: str, width: float = 3600.0) -> DataFrame:
    """(keys, right_no, left_no): each right row writes itself to its nearest left row (the smaller number of two equally near); of several writers the
    last, by number, stays. All right rows come out, overwritten ones with null.

    Nearest neighbours come from one sort of the union within time buckets of `width` seconds: the left row before and the one after; the nearest left rows outside
    a bucket come from one row per bucket. Times of left rows must rise with their number."""
    a = left.select(*keys, F.col(left_time).alias("t"), F.lit(0).alias("side"), F.col(left_no).alias("l"), F.lit(None).cast(right.schema[right_no].dataType).alias("r"))
    b = right.select(*keys, F.col(right_time).alias("t"), F.lit(1).alias("side"), F.lit(None).cast(left.schema[left_no].dataType).alias("l"), F.col(right_no).alias("r"))
    one = F.when(F.col("side") == 0, F.struct("t", "l"))
    u = a.unionByName(b).withColumn("b", F.floor(F.col("t") / width))
    w = Window.partitionBy(*keys, "b").orderBy("t", "side", "l", "r").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(*keys, "b").orderBy(F.desc("t"), F.desc("side"), F.desc("l"), F.desc("r")).rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("p", F.last(one, True).over(w)).withColumn("q", F.last(one, True).over(back))
    c = u.groupBy(*keys, "b").agg(F.min(one).alias("first"), F.max(one).alias("last"))
    up = Window.partitionBy(*keys).orderBy(F.col("b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.col("b").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    c = c.select(*keys, "b", F.last("last", True).over(up).alias("ahead"), F.last("first", True).over(down).alias("behind"))
    on = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in (*keys, "b")]
    u = u.filter("side = 1").alias("x").join(c.alias("y"), on).select(*[F.col(f"x.{k}") for k in (*keys, "t", "r")], F.coalesce("x.p", "y.ahead").alias("p"), F.coalesce("x.q", "y.behind").alias("q"))
    gp, gq = F.abs(F.col("t") - F.col("p.t")), F.abs(F.col("q.t") - F.col("t"))
    pick = F.when(F.col("q").isNull() | (gp < gq) | ((gp == gq) & (F.col("p.l") <= F.col("q.l"))), F.col("p.l")).otherwise(F.col("q.l"))
    u = u.withColumn("at", pick)
    wins = F.row_number().over(Window.partitionBy(*keys, "at").orderBy(F.desc("r"))) == 1
    return u.withColumn("wins", wins).select(*keys, F.col("r").alias(right_no), F.when(F.col("wins"), F.col("at")).alias(left_no))


def overlap_expand(samples: DataFrame, keys: list[str], order: str, time: str, mask: str, other: str, margin: float, out: str, width: float = 3600.0, size: int = 65536) -> DataFrame:
    """Boolean `out`: within `margin` of a region of `mask` (times of its first sample and of the sample that ends it, ends included), or in a region of `other` of which a
    sample is. Regions are those of masks.islands(): the last sample of a recording only ends one. Null masks are false; null keys or times and inverted regions match nothing.

    Work grows with the rows, not with how long regions last. Rows lie in buckets of `size` values of a whole-numbered order (any other is one bucket), regions are carried over the borders by
    one row per bucket, and the sample that ends a region puts it out as one row. Samples and regions are then sorted by time in buckets of `width`: a sample is near if the latest
    end of the regions begun so far isn't before it. Only the rows of a region of `other` meet in one window, others are spread."""
    whole = isinstance(samples.schema[order].dataType, T.IntegralType)
    on, ex = lambda c: F.col(c) % 2 == 1, lambda c: F.col(c) >= 2
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    at = lambda c: F.struct(F.col(c).alias("t"))
    bucket = F.coalesce(F.floor(F.col(order) / size), F.lit(-(1 << 62))) if whole else F.lit(0).cast("long")
    keyed = reduce(and_, [F.col(k).isNotNull() for k in keys])
    # rows without a key stay aside and both masks are one column: all branches then read the same and share one shuffle
    d = samples.filter(keyed).withColumn("__f", flag(mask) + 2 * flag(other)).withColumn("__b", bucket)
    w = Window.partitionBy(*keys, "__b").orderBy(order)
    past, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__r", F.row_number().over(w)).withColumn("__p", F.lag("__f").over(w))
    turn, turn_x = F.when(on("__f") != on("__p"), F.col("__r")), F.when(ex("__f") != ex("__p"), F.col("__r"))
    c = d.groupBy(*keys, "__b").agg(
        F.max("__r").alias("__k"), F.min_by("__f", "__r").alias("__f0"), F.max_by("__f", "__r").alias("__f1"), F.min_by(time, "__r").alias("__t0"),
        F.max(turn).alias("__mr"), F.max_by(time, turn).alias("__mt"), F.max(turn_x).alias("__xr"),
    )
    up = Window.partitionBy(*keys).orderBy("__b")
    earlier = up.rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("__pf", F.lag("__f1").over(up)).withColumn("__from", F.coalesce(F.sum("__k").over(earlier), F.lit(0))).withColumn("__final", F.lead("__k").over(up).isNull())
    c = c.withColumn("__opens", F.coalesce(on("__f0") != on("__pf"), F.lit(True))).withColumn("__opens_x", F.coalesce(ex("__f0") != ex("__pf"), F.lit(True)))
    since = F.when(F.col("__mr").isNotNull(), at("__mt")).when(F.col("__opens"), at("__t0"))
    since_x = F.when(F.col("__xr").isNotNull(), F.col("__from") + F.col("__xr") - 1).when(F.col("__opens_x"), F.col("__from"))
    c = c.withColumn("__ms", F.last(since, True).over(earlier)).withColumn("__xs", F.last(since_x, True).over(earlier))
    c = c.select(*keys, "__b", "__k", "__t0", "__pf", "__from", "__final", "__opens", "__opens_x", "__ms", "__xs")

    d = d.withColumn("__mt", F.last(F.when(turn.isNotNull(), at(time)), True).over(before)).withColumn("__xr", F.last(turn_x, True).over(past))
    d = d.join(c, [*keys, "__b"], "left").withColumn("__p", F.coalesce("__p", "__pf"))
    final = F.col("__final") & (F.col("__r") == F.col("__k"))
    start = F.coalesce("__mt", F.when((F.col("__r") > 1) & F.col("__opens"), at("__t0")), "__ms")
    d = d.withColumn("__lo", start["t"] - margin).withColumn("__hi", F.col(time) + margin)
    ends = on("__p") & (final | ~on("__f")) & (F.col("__lo") <= F.col("__hi")) & ~F.isnan("__hi")
    region = F.coalesce(F.col("__from") + F.col("__xr") - 1, F.when(F.col("__opens_x"), F.col("__from")), "__xs")
    d = d.withColumn("__x", F.when(ex("__f") & ~final, region)).withColumn("__s", F.explode(F.when(ends, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    d = d.select(*samples.columns, "__x", "__s", F.when(F.col("__s"), F.col(time)).otherwise(F.col("__lo")).alias("__at"), F.when(~F.col("__s"), F.col("__hi")).alias("__hi"))
    d = d.withColumn("__a", F.floor(F.col("__at") / width).cast("long"))
    held = d.groupBy(*keys, "__a").agg(F.max("__hi").alias("__held"))
    held = held.select(*keys, "__a", F.max("__held").over(Window.partitionBy(*keys).orderBy("__a").rowsBetween(Window.unboundedPreceding, -1)).alias("__held"))
    d = d.withColumn("__hi", F.max("__hi").over(Window.partitionBy(*keys, "__a").orderBy("__at", "__s").rowsBetween(Window.unboundedPreceding, 0)))
    d = d.filter("__s").join(held, [*keys, "__a"], "left").withColumn("__near", F.coalesce(F.greatest("__hi", "__held") >= F.col("__at"), F.lit(False)))
    touched = F.max("__near").over(Window.partitionBy(*keys, "__x", F.when(F.col("__x").isNull(), bucket)))
    d = d.select(*samples.columns, (F.col("__near") | (F.col("__x").isNotNull() & touched)).alias(out))
    return d.unionByName(samples.filter(~keyed).withColumn(out, F.lit(False)))


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per key the last non-null value of every other column in `order`."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) if c != order else F.max(c).alias(c) for c in rest])

