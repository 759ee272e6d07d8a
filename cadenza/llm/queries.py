"""Registered queries of the numbered problems that belong to this subpackage: 4, 6, 7 and 8."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.units import conversion_table, to_common
from ..plans.data_queries import clock_readings
from ..sources.tables import table
from .language import label_languages, named_language, train_networks
from .mixing import mix
from .nearest_stream import replay_nearest
from .packing import pack, packing_report
from .tokens import with_token_counts

# codes of the streams, in the last two bits of an entity
BAG, LSL, EDF = 0, 1, 2
TOLERANCE = {BAG: 0.015, LSL: 0.005, EDF: 0.005, 3: 0.0}


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    conv = conversion_table(spark)

    def side(df: DataFrame, code: int, left: bool, no: str, t: str) -> DataFrame:
        return df.select((F.col("recording_id") * 4 + code).alias("entity"), F.lit(left).alias("is_left"), F.col(no).cast("long").alias("no"), F.col(t).alias("t"))

    bag = table(spark, sf, "mean_rgb").select("recording_id", "FrameNum_Bag", "Time_Bag").dropDuplicates()
    cam = to_common(clock_readings(spark, sf, "Time_RealSense"), "value", "unit", "s", "t", conv)
    eye = to_common(clock_readings(spark, sf, "Time_EDF"), "value", "unit", "s", "t", conv)
    mark = table(spark, sf, "marker").select("recording_id", "marker_idx", "Time_LSL", (F.col("Time_EDF") / 1000).alias("t")).dropDuplicates()
    rows = side(bag, BAG, True, "FrameNum_Bag", "Time_Bag").unionByName(side(cam, BAG, False, "FrameNum", "t"))
    rows = rows.unionByName(side(mark, LSL, True, "marker_idx", "Time_LSL")).unionByName(side(mark.filter("Time_LSL is null or isnan(Time_LSL)"), EDF, True, "marker_idx", "t"))
    both = eye.select("recording_id", "sample_idx", F.explode(F.array(F.struct(F.lit(LSL).alias("c"), F.col("Time_LSL").alias("x")), F.struct(F.lit(EDF).alias("c"), F.col("t").alias("x")))).alias("p"))
    rows = rows.unionByName(both.select((F.col("recording_id") * 4 + F.col("p.c")).alias("entity"), F.lit(False).alias("is_left"), F.col("sample_idx").cast("long").alias("no"), F.col("p.x").alias("t")))
    # counted in the files' footers; eye samples stand on both of their clocks
    expected = sum(k * table(spark, sf, t).count() for t, k in (("mean_rgb", 1), ("realsense", 1), ("marker", 1), ("eyelink", 2)))
    pairs = replay_nearest(spark, rows, TOLERANCE, expected=expected)
    code = F.pmod(F.col("entity"), F.lit(4))
    return pairs.select(F.when(code == BAG, "bag").otherwise("marker").alias("stream"), F.floor(F.col("entity") / 4).cast("long").alias("recording_id"), "left_no", "right_no")


CAPACITY = 2048


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    """All texts in containers of 2,048 tokens."""
    return pack(with_token_counts(table(spark, sf, "documents").select("doc_id", "text")), CAPACITY)


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing_report(p6_containers(spark, sf), CAPACITY)


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = with_token_counts(table(spark, sf, "documents").select("doc_id", "source", F.xxhash64("text", F.lit(1)).alias("k1"), F.xxhash64(F.reverse("text")).alias("k2"), "text"))
    key = F.concat_ws("-", F.col("k1").cast("string"), F.col("k2").cast("string"))
    return mix(docs.select("doc_id", "source", key.alias("key"), "n_tokens"), table(spark, sf, "mix_targets"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The records used for each source and how often."""
    return _mix(spark, sf)[0]


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Target shares and the shares really reached."""
    return _mix(spark, sf)[1]


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return label_languages(docs, train_networks(docs, table(spark, sf, "lang_samples")), carry=named_language(F.col("lang")).alias("named"))


def p8_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Language of each document and of its stretches, with confidence."""
    return _labels(spark, sf)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    wrong = F.col("named").isNull() | (F.col("named") != F.col("main")) | (F.size("langs") > 1)
    return _labels(spark, sf).filter((F.size("langs") > 0) & wrong).select("doc_id", F.explode("langs").alias("lang"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p4_found, p6_containers, p6_report, p7_mix, p7_report, p8_found, p8_labels)}
ORACLES: dict[str, str] = {}
