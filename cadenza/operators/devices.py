"""Typed series of the devices from their tables, in common units, with optional interval flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import nan_to_null, table
from .drift import unified_records
from .events import boundaries, mouse_state
from .joins import interval_flag
from .series import trim_beginning

# Columns of each device's series and what their values are divided by.
SERIES = {
    "eyelink": {
        "R_GazeX": 1, "R_GazeY": 1, "R_PupilSize": 1, "L_GazeX": 1, "L_GazeY": 1, "L_PupilSize": 1, "Target_PositionX": 1, "Target_PositionY": 1, "Target_Distance": 10,
        "ResolutionX": 1, "ResolutionY": 1, "Time_EDF": 1000, "Time_NUC": 1, "Time_LSL": 1,
    },
    "flir": {"FrameNum": 1, "Time_FLIR": 1e9, "Time_LSL": 1},
    "realsense": {"FrameNum": 1, "FrameNum_RealSense": 1, "Time_RealSense": 1000, "Time_ACQ": 1, "Time_LSL": 1},
    "mbient": {"Time_Mbient": 1000, "AccelX": 1, "AccelY": 1, "AccelZ": 1, "GyroX": 1, "GyroY": 1, "GyroZ": 1, "Time_LSL": 1},
}


def decode(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One device's series: its columns scaled as the header says they usually are, NaN as null; only these columns are read."""
    cols = SERIES[name]
    d = table(spark, sf, name).select("recording_id", "sample_idx", *cols)
    d = nan_to_null(d)
    return d.select("recording_id", "sample_idx", *[(F.col(c) / k).alias(c) if k != 1 else F.col(c) for c, k in cols.items()])


def flagged(df: DataFrame, markers: DataFrame, keys: list[str], order: str, text: str, marker_time: str, time: str, starts: list[str], ends: list[str], out: str, last_only: bool = False) -> DataFrame:
    """Adds `out`: whether a sample lies within a pair of start and end markers, both ends included; with last_only within the last pair. Unpaired boundaries flag nothing."""
    pairs = boundaries(markers, keys, order, text, marker_time, starts, ends).dropna(subset=["start", "end"])
    return interval_flag(df, pairs, keys, time, "start", "end", out, 600.0, last_by="k" if last_only else None)


def decode_records(files: DataFrame, records: DataFrame, fields: DataFrame, device: str) -> DataFrame:
    """(recording_id, row_no, the device's usual columns): the rows of one device's files that are kept as written, in whatever notation, order and naming.

    Columns come from `unified_records` by their canonical values; whole-numbered ones (`value_type` int) as long, others as double. A value that
    a file lacks or marks as absent is null; MouseState is spelled out (Release, Move, Click). Rows without any usual value don't come out. `fields` is a fixed few dozen rows."""
    usual = [(r["column_name"], r["value_type"]) for r in fields.filter(F.col("device") == device).orderBy("position_no").collect()]
    u = unified_records(files.filter(F.col("device") == device), records, fields).filter(F.col("column_name").isin([c for c, _ in usual]))
    value = lambda c: F.max(F.when(F.col("column_name") == c, F.col("canonical")))
    d = u.groupBy("recording_id", "row_no").agg(*[(value(c).cast("long") if kind == "int" else value(c)).alias(c) for c, kind in usual])
    return d.withColumn("MouseState", mouse_state(F.col("MouseState"))) if "MouseState" in d.columns else d


def mean_colours(df: DataFrame, keys: list[str], order: str, time: str, exclude_beginning: bool = False) -> DataFrame:
    """Mean colours of a video's frames as MeanColor_R, _G, _B; with exclude_beginning only from the position on at which the frame rate is stable, and nothing of videos whose never is."""
    d = trim_beginning(df, keys, order, time) if exclude_beginning else df
    return nan_to_null(d.withColumnsRenamed({c: f"MeanColor_{c}" for c in "RGB"}))


def split_eyes(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """One row per sample and eye: columns R_x and L_x become x with eye 'R' or 'L'. One pass over the input."""
    sides = [F.struct(F.lit(e).alias("eye"), *[F.col(f"{e}_{m}").alias(m) for m in measures]) for e in ("R", "L")]
    return df.select(*keys, F.explode(F.array(*sides)).alias("s")).select(*keys, "s.*")
