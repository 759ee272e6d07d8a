"""Count windows over ordered samples, with zero padding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .masks import with_position


def tumbling_windows(df: DataFrame, keys: list[str], order: str, value: str, length: int) -> DataFrame:
    """(keys, win, values): consecutive windows of `length` samples, the last padded with zeros. Null samples count as 0."""
    d = with_position(df, keys, order).withColumn("win", F.floor(F.col("i") / length).cast("long"))
    return _fill(d, keys, value, length, F.col("i") % length)


def hopping_windows(df: DataFrame, keys: list[str], order: str, value: str, length: int, hop: int) -> DataFrame:
    """(keys, win, values): windows of `length` starting every `hop` samples. The series is padded by t - n mod t zeros, t = min(hop, length), which is
    never 0, so an exact multiple gets a further window; a series shorter than a window gives one."""
    d = with_position(df, keys, order)
    t = min(hop, length)
    padded = F.when(F.col("n") < length, F.lit(length).cast("long")).otherwise(F.col("n") + t - F.col("n") % t)
    d = d.withColumn("last_win", F.floor((padded - length) / hop).cast("long"))
    lo = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("i") - length + 1) / hop).cast("long"))
    hi = F.least(F.col("last_win"), F.floor(F.col("i") / hop).cast("long"))
    inside = d.filter(hi >= lo).select(*keys, F.col("i"), F.col(value), F.explode(F.sequence(lo, hi)).alias("win"))
    inside = inside.withColumn("i", F.col("i") - F.col("win") * hop)
    # a window of nothing but padding holds no sample: give every series its last window
    tail = d.filter("i = 0").select(*keys, F.lit(-1).cast("long").alias("i"), F.lit(None).cast("double").alias(value), F.col("last_win").alias("win"))
    return _fill(inside.unionByName(tail), keys, value, length, F.col("i"))


def _fill(d: DataFrame, keys: list[str], value: str, length: int, pos) -> DataFrame:
    m = F.map_from_entries(F.collect_list(F.when(pos >= 0, F.struct(pos.cast("int"), F.coalesce(F.col(value).cast("double"), F.lit(0.0))))))
    g = d.groupBy(*keys, "win").agg(m.alias("m"))
    return g.select(*keys, "win", F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("values"))
