"""ASCII exports of the eye tracker: sample tables and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _samples(spark: SparkSession, path: str, names: dict[int, str]) -> DataFrame:
    """Tab-separated samples without a header; dots stand for absent values."""
    p = F.split("value", "\t")
    num = lambda k: F.trim(F.get(p, F.lit(k))).try_cast("double")
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), *[num(k).alias(n) for k, n in names.items()]).filter("Time_EDF is not null")


def href_samples(spark: SparkSession, path: str) -> DataFrame:
    return _samples(spark, path, {0: "Time_EDF", 1: "L_X_HREF", 2: "L_Y_HREF", 4: "R_X_HREF", 5: "R_Y_HREF"})


def gaze_samples(spark: SparkSession, path: str) -> DataFrame:
    return _samples(spark, path, {0: "Time_EDF", 1: "L_X", 2: "L_Y", 4: "R_X", 5: "R_Y", 7: "X_Res", 8: "Y_Res"})


def event_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, tokens): whitespace tokens in upper case, numbered within the file."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    return t.select("path", "line", F.split(F.upper(F.trim("text")), r"\s+").alias("tokens"))


def eye_spans(lines: DataFrame) -> DataFrame:
    """(path, kind, eye, start, end) of saccades, fixations and blinks."""
    tok = lambda k: F.try_element_at("tokens", F.lit(k))
    kind = F.when(tok(1) == "ESACC", "saccade").when(tok(1) == "EFIX", "fixation").when(tok(1) == "EBLINK", "blink")
    return lines.select("path", kind.alias("kind"), tok(2).alias("eye"), tok(3).try_cast("int").alias("start"), tok(4).try_cast("int").alias("end")).filter("kind is not null")


def task_spans(lines: DataFrame) -> DataFrame:
    """(path, start, end, status): first TASK_START and the first TASK_END after it, less the message's offset. status 'nested' if a second start or an end comes first; missing
    markers give null."""
    tok = lambda k: F.try_element_at("tokens", F.lit(k))
    has_offset = tok(3).rlike(r"^[+-]?\d+$")
    code: Column = F.when(has_offset, tok(4)).otherwise(tok(3))
    t = tok(2).try_cast("double") - F.when(has_offset, tok(3).try_cast("double")).otherwise(0.0)
    m = lines.filter(tok(1) == "MSG").select("path", "line", code.alias("code"), t.alias("t")).filter(F.col("code").isin("TASK_START", "TASK_END"))
    w = Window.partitionBy("path").orderBy("line")
    m = m.withColumn("k", F.row_number().over(w)).filter("k <= 2")
    g = m.groupBy("path").agg(F.max(F.when(F.col("k") == 1, F.col("code"))).alias("a"), F.max(F.when(F.col("k") == 2, F.col("code"))).alias("b"), F.max(F.when(F.col("k") == 1, F.col("t"))).alias("ta"), F.max(F.when(F.col("k") == 2, F.col("t"))).alias("tb"))
    good = F.col("a") == "TASK_START"
    return lines.select("path").distinct().join(g, "path", "left").select(
        "path", F.when(good, F.col("ta")).alias("start"), F.when(good & (F.col("b") == "TASK_END"), F.col("tb")).alias("end"),
        F.when((F.col("a") == "TASK_END") | (F.col("b") == "TASK_START"), "nested").when(F.col("b").isNull(), "missing").otherwise("ok").alias("status"),
    )
