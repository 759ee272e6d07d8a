"""Masks over ordered samples: edges, islands, spans, and painting runs back onto samples.

All operators take `keys` (the recording), `order` (a column that orders samples within it) and a mask
column; null mask values count as false. Positions come from counts per bucket of the order plus the place inside the bucket, and what looks at
neighbours runs over chunks of positions with a halo, so that a recording with a third of all rows is many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import with_chunks

CHUNK = 65536


def ordered(keys: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def _on(keys: list[str]) -> list[Column]:
    return [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]


def with_position(df: DataFrame, keys: list[str], order: str, width: int = CHUNK) -> DataFrame:
    """Adds i (0-based position) and n (length of the recording).

    For a whole-numbered order, rows are numbered within buckets of `width` of its values, and buckets start where the counts of those before end: no
    task holds more of a recording than a bucket, if numbers aren't repeated. Any other order needs one window per recording."""
    if not isinstance(df.schema[order].dataType, T.IntegralType):
        return df.withColumn("i", (F.row_number().over(ordered(keys, order)) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    d = df.withColumn("__b", F.floor(F.col(order) / width))
    c = d.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__k"))
    up = Window.partitionBy(*keys).orderBy(F.col("__b").asc_nulls_first())
    c = c.withColumn("__from", F.sum("__k").over(up) - F.col("__k")).withColumn("n", F.sum("__k").over(Window.partitionBy(*keys))).drop("__k")
    d = d.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(order)))
    j = d.alias("a").join(c.alias("b"), _on([*keys, "__b"]), "left")
    return j.select(*[F.col(f"a.{x}") for x in df.columns], (F.col("b.__from") + F.col("a.__r") - 1).alias("i"), F.col("b.n").alias("n"))


def in_chunks(df: DataFrame, keys: list[str], halo: int, size: int = CHUNK) -> tuple[DataFrame, WindowSpec]:
    """Rows that have a position i, in chunks with `halo` neighbours on both sides, and the window over a chunk. The caller drops rows with __halo."""
    return with_chunks(df, "i", size, halo, "__c"), Window.partitionBy(*keys, "__c").orderBy("i")


def edge(mask: Column, i: Column, n: Column, w: WindowSpec, endpoints: bool, integer: bool = False) -> Column:
    """Whether a sample is an edge. With endpoints the first and the last sample always are, and the last one's own value is
    not looked at; without them a change is an edge, and for integer masks also a first value that isn't 0."""
    change = mask != F.lag(mask).over(w)
    if endpoints:
        return (i == 0) | (i == n - 1) | F.coalesce((i < n - 1) & change, F.lit(False))
    return F.coalesce(change, (mask != 0) if integer else F.lit(False))


def mark_edges(df: DataFrame, keys: list[str], order: str, mask: str, endpoints: bool, integer: bool = False, size: int = CHUNK) -> DataFrame:
    """Adds i, n and is_edge. Empty input stays empty."""
    m = F.coalesce(F.col(mask), F.lit(0) if integer else F.lit(False))
    d, w = in_chunks(with_position(df, keys, order, size), keys, 1, size)
    return d.withColumn("is_edge", edge(m, F.col("i"), F.col("n"), w, endpoints, integer)).filter("not __halo").drop("__halo", "__c")


def mark_runs(df: DataFrame, keys: list[str], order: str, mask: str, size: int = CHUNK) -> DataFrame:
    """Adds i, n and run: number of the run of equal mask values, from 1. The last sample of a recording belongs to the run before it.

    Runs are counted within chunks and start where the chunks before end."""
    m = F.coalesce(F.col(mask), F.lit(False))
    d, w = in_chunks(with_position(df, keys, order, size), keys, 1, size)
    d = d.withColumn("__edge", edge(m, F.col("i"), F.col("n"), w, True)).filter("not __halo").drop("__halo")
    opens = (F.col("__edge") & ((F.col("i") < F.col("n") - 1) | (F.col("n") == 1))).cast("int")
    d = d.withColumn("__open", opens).withColumn("__no", F.sum("__open").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = d.groupBy(*keys, "__c").agg(F.sum("__open").alias("__k"))
    c = c.withColumn("__from", F.sum("__k").over(Window.partitionBy(*keys).orderBy("__c")) - F.col("__k"))
    j = d.alias("a").join(c.alias("b"), _on([*keys, "__c"]))
    return j.select(*[F.col(f"a.{x}") for x in df.columns], "a.i", "a.n", (F.col("b.__from") + F.col("a.__no")).alias("run"))


def runs(marked: DataFrame, keys: list[str], mask: str, time: str) -> DataFrame:
    """One row per run of mark_runs(): run, first (position), last (position of the next run's first sample, or of the last sample), on, t_first, t_last."""
    g = marked.groupBy(*keys, "run").agg(
        F.min("i").alias("first"), F.max("n").alias("n"), F.min_by(F.coalesce(F.col(mask), F.lit(False)), "i").alias("on"), F.min_by(time, "i").alias("t_first"), F.max_by(time, "i").alias("t_end"),
    )
    w = ordered(keys, "run")
    return g.select(*keys, "run", "first", F.coalesce(F.lead("first").over(w), F.col("n") - 1).alias("last"), "on", "t_first", F.coalesce(F.lead("t_first").over(w), "t_end").alias("t_last"))


def islands(df: DataFrame, keys: list[str], order: str, mask: str, time: str) -> DataFrame:
    """True regions: (keys, island, first, last, samples, t_first, t_last) with `last` exclusive, so that a region reaching the end lacks its final sample. Islands are numbered from 1."""
    r = runs(mark_runs(df, keys, order, mask), keys, mask, time).filter(F.col("on") & (F.col("last") > F.col("first")))
    return r.select(*keys, F.row_number().over(ordered(keys, "first")).alias("island"), "first", "last", (F.col("last") - F.col("first")).alias("samples"), "t_first", "t_last")


def last_long_island(df: DataFrame, keys: list[str], order: str, mask: str, time: str, min_samples: int) -> DataFrame:
    """The last island of at least min_samples samples of each recording; recordings without one don't come out."""
    long = islands(df, keys, order, mask, time).filter(F.col("samples") >= min_samples)
    return long.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("island")))).filter("k = 1").drop("k")


def paint(marked: DataFrame, keys: list[str], qualified: DataFrame, out: str, size: int = CHUNK) -> DataFrame:
    """Boolean `out` on samples of mark_runs(): true within a qualified run and on the first sample after it.

    `qualified` holds (keys, run). Runs are few against samples; the join is on recording and run."""
    q = qualified.select(*keys, "run", F.lit(True).alias("__q"))
    d, w = in_chunks(marked.join(q, [*keys, "run"], "left"), keys, 1, size)
    before = F.coalesce(F.lag("__q").over(w), F.lit(False)) & (F.col("run") != F.lag("run").over(w))
    return d.withColumn(out, F.coalesce("__q", F.lit(False)) | F.coalesce(before, F.lit(False))).filter("not __halo").drop("__q", "__halo", "__c")
