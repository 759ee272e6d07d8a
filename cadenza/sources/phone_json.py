"""Phone JSON: frames as JSON strings within JSON, into video, dropped and audio tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FRAME = "FrameNumber string, TimestampVideo string, TimestampVideoUnix string, DroppedFrameNumber string, DroppedTimestamp string, DroppedReason string, AudioSampleTimeReceived string"


def phone_frames(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, frame) of every element of the files under `path`; an outer object with Framedata or a bare list. Files that
    are neither give no rows."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    outer = F.from_json("value", "struct<Framedata: array<string>>")["Framedata"]
    bare = F.from_json("value", "array<string>")
    e = t.select("path", F.posexplode(F.when(F.ltrim("value").startswith("["), bare).otherwise(outer)).alias("pos", "text"))
    return e.select("path", "pos", F.from_json("text", _FRAME).alias("f"))


def video_frames(frames: DataFrame) -> DataFrame:
    n = F.col("f.FrameNumber").try_cast("long")
    return frames.filter(n.isNotNull()).select("path", n.alias("FrameNum"), F.col("f.TimestampVideo").try_cast("double").alias("Time_iPhone"), F.col("f.TimestampVideoUnix").try_cast("double").alias("Time_ACQ")).orderBy("path", "FrameNum")


def dropped_frames(frames: DataFrame) -> DataFrame:
    n = F.col("f.DroppedFrameNumber").try_cast("long")
    return frames.filter(n.isNotNull()).select("path", n.alias("FrameNum"), F.col("f.DroppedTimestamp").try_cast("double").alias("Time_iPhone"), F.col("f.DroppedReason").alias("Reason")).orderBy("path", "FrameNum")


def audio_batches(frames: DataFrame) -> DataFrame:
    """Third level of JSON, in the order of the file."""
    a = F.from_json("f.AudioSampleTimeReceived", "struct<NumberOfSamples: long, Timestamp: double>")
    return frames.filter("f.AudioSampleTimeReceived is not null").select("path", "pos", a["NumberOfSamples"].alias("samples"), a["Timestamp"].alias("time"))


def phone_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(path, ios_version, app_version, device_id, device_type) of each file under `path`; what a file doesn't say is null."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "iOSVersionNumber string, appVersionNumber string, deviceID string, deviceType string").alias("m"))
    return t.select("path", F.col("m.iOSVersionNumber").alias("ios_version"), F.col("m.appVersionNumber").alias("app_version"), F.col("m.deviceID").alias("device_id"), F.col("m.deviceType").alias("device_type"))
