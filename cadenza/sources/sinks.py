"""Sinks: device series by session and device, and outputs that aren't there yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_series(df: DataFrame, path: str, by: list[str], overwrite: bool = False) -> None:
    """Parquet partitioned by `by`; fails if there is data already, unless overwrite. Rows are clustered by the partition columns first, so that
    a partition gets few files, and salted, so that a large one isn't written by one task."""
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c not in by]), F.lit(8))
    df.repartition(*by, salt).write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*by).parquet(path)


def missing_outputs(wanted: DataFrame, existing: DataFrame, path: str = "path") -> DataFrame:
    """Rows of `wanted` whose output isn't among the existing ones."""
    return wanted.join(existing.select(path).distinct(), path, "left_anti")


def attach_videos(streams: DataFrame, video_markers: DataFrame) -> DataFrame:
    """Adds videos, the files announced for a stream by markers 'stream,file' (file names may hold commas); empty without any. Streams without description, the marker
    stream and the announcing stream fall out."""
    parts = F.split("text", ",", 2)
    v = video_markers.select("path", F.trim(parts[0]).alias("name"), F.trim(F.get(parts, F.lit(1))).alias("file")).filter("file is not null")
    v = v.groupBy("path", "name").agg(F.array_sort(F.collect_set("file")).alias("videos"))
    s = streams.filter(~F.col("name").isin("Marker", "videofiles") & F.col("description").isNotNull())
    return s.join(v, ["path", "name"], "left").withColumn("videos", F.coalesce("videos", F.array().cast("array<string>")))
