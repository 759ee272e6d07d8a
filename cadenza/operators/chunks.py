"""Splitting long recordings: windows over (recording, chunk) with a halo instead of over a whole recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def with_chunks(df: DataFrame, idx: str, size: int = 8192, halo: int = 64, out: str = "chunk") -> DataFrame:
    """Adds `out` and `__halo`: every row is in its own chunk of `size` index values, and rows within
    `halo` of a border also, marked __halo, in the neighbouring one. An operator that looks at most
    `halo` rows around then needs no window over a whole recording, so that a recording which holds a
    third of all rows is spread over as many tasks as it has chunks. Null indexes go to chunk 0."""
    i = F.coalesce(F.col(idx), F.lit(0)).cast("long")
    own = F.floor(i / F.lit(size)).cast("long")
    pos = F.pmod(i, F.lit(size))
    near = F.filter(
        F.array(own, F.when((pos < halo) & (own > 0), own - 1), F.when(pos >= size - halo, own + 1)),
        lambda c: c.isNotNull(),
    )
    return df.withColumn("__own", own).withColumn(out, F.explode(near)).withColumn("__halo", F.col(out) != F.col("__own")).drop("__own")


def by(*cols: str) -> WindowSpec:
    return Window.partitionBy(*cols)


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def previous_row(df: DataFrame, key: list[str], order: str, tie: str, carry: list[str], bucket: Column) -> DataFrame:
    """Each row with the `carry` columns of the row before it in its key, as prev_<column>.

    A lag over a whole key would put a hot key into one task. Here rows are laged inside (key, bucket),
    where `bucket` rises with `order`; only the first row of a bucket takes its predecessor from the last
    row of the bucket before, found over one row per bucket. The first row of a key gets nulls."""
    d = df.withColumn("__b", bucket)
    w = Window.partitionBy(*key, "__b").orderBy(F.col(order).asc_nulls_first(), F.col(tie).asc_nulls_first())
    row = F.struct(*[F.col(c) for c in carry])
    inner = d.withColumn("__prev", F.lag(row).over(w)).withColumn("__first", F.row_number().over(w) == 1)
    ends = d.groupBy(*key, "__b").agg(F.max_by(row, F.struct(F.col(order), F.col(tie))).alias("__last"))
    carried = ends.withColumn("__before", F.lag("__last").over(Window.partitionBy(*key).orderBy(F.col("__b").asc_nulls_first())))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*key, "__b"]]
    j = inner.alias("a").join(carried.select(*key, "__b", "__before").alias("b"), on, "left")
    out = F.when(F.col("a.__first"), F.col("b.__before")).otherwise(F.col("a.__prev"))
    return j.select(*[F.col(f"a.{c}") for c in df.columns], *[out[c].alias(f"prev_{c}") for c in carry])
