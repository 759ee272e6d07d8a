"""Back-filling metadata of files written before it was kept, and the registry of such corrections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import version_struct


def backfill(files: DataFrame, fields: DataFrame) -> DataFrame:
    """Adds version (major, minor) and columns_: where the major version is below 1 the device's usual columns, in order, else what the file states.

    `fields` has one row per column of a device, a fixed few dozen; the aggregate is one row per device."""
    usual = fields.groupBy("device").agg(F.array_sort(F.collect_list(F.struct("position_no", "column_name"))).alias("c"))
    usual = usual.select("device", F.array_join(F.transform("c", lambda x: x["column_name"]), ",").alias("usual_columns"))
    d = files.withColumn("version", version_struct(F.col("data_version"))).join(F.broadcast(usual), "device", "left")
    return d.withColumn("columns_", F.when(F.col("version.major") < 1, F.col("usual_columns")).otherwise(F.col("column_names"))).drop("usual_columns")


Correction = Callable[[DataFrame], DataFrame]


def correct(df: DataFrame, device: str, registry: dict[str, Correction]) -> DataFrame:
    """Rows of each device that the registry knows go through its function; the others stay. Functions must keep the schema."""
    out = df.filter(~F.col(device).isin(list(registry)) | F.col(device).isNull()) if registry else df
    for name, f in registry.items():
        out = out.unionByName(f(df.filter(F.col(device) == name)))
    return out
