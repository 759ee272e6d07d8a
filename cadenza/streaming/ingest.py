"""Incremental ingest: new files through a transformation into a table, with a ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema: str, target: str, ledger: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], files_per_batch: int = 1000) -> StreamingQuery:
    """Processes all files of `source` (parquet) that no earlier run has, batch by batch, and ends.

    Each batch is written under its own number, so that a batch run again after a failure replaces its own output; the ledger
    gets one row per file. Which files are done is kept by the stream's checkpoint."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source).withColumn("source_file", F.col("_metadata.file_path"))

    def write(batch: DataFrame, number: int) -> None:
        transform(batch.drop("source_file")).write.mode("overwrite").parquet(f"{target}/batch={number}")
        batch.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    return s.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts per window and key with late rows up to `delay`."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), key).agg(F.count(F.lit(1)).alias("n"))
