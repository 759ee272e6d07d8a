import math

import pytest
from pyspark.sql import functions as F

from cadenza.operators.units import clock_units, compose, conversion_table, declared_unit, nearest_unit, plausible, scales, to_common


def test_compose_shortest_and_cycles():
    t = {(a, b): (k, c) for a, b, k, c, _ in compose([("C", "K", 1.0, 273.15), ("F", "C", 5 / 9, -160 / 9)])}
    assert t["F", "K"][0] * 212 + t["F", "K"][1] == pytest.approx(373.15)
    assert t["K", "F"][0] * 373.15 + t["K", "F"][1] == pytest.approx(212)
    compose([("a", "b", 2.0, 0.0), ("b", "c", 3.0, 0.0), ("a", "c", 6.0, 0.0)])
    with pytest.raises(ValueError):
        compose([("a", "b", 2.0, 0.0), ("b", "c", 3.0, 0.0), ("a", "c", 7.0, 0.0)])


def test_to_common_keeps_rows(spark):
    df = spark.createDataFrame([(1.0, "in"), (2.0, "m"), (3.0, None), (4.0, "s"), (None, "cm"), (float("nan"), "mm")], "v double, u string")
    got = [r["o"] for r in to_common(df, "v", "u", "mm", "o", conversion_table(spark)).orderBy(F.col("v").asc_nulls_last()).collect()]
    assert got[0] == pytest.approx(25.4) and got[1] == pytest.approx(2000) and got[2] is None and got[3] is None and math.isnan(got[4]) and got[5] is None


def test_lengths(spark):
    vals = [6000.0, 600.0, 60.0, 0.6, 24.0, 0.0, -32768.0, None, float("nan"), 1e6]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double").withColumn("u", nearest_unit(F.col("v"), 600.0, "mm"))
    d = to_common(d, "v", "u", "mm", "c", conversion_table(spark)).withColumn("u", F.when(plausible(F.col("c"), 400.0, 800.0), F.col("u")))
    assert [r["u"] for r in d.orderBy("i").collect()] == ["0.1mm", "mm", "cm", "m", "in", None, None, None, None, None]
    assert scales("s")["ns"] == (pytest.approx(1e-9), 0.0) and set(scales("s")) == {"s", "ms", "us", "ns"}


def test_declared(spark):
    rows = [("How far (tenths of a millimetre)", None), ("How far, in metres", None), ("How far", "NB in for Target_Distance here"), (None, "operator says Target_Distance was exported as centimetres"), ("How far", "battery changed"), (None, None), ("Clock, in msec", None)]
    got = [r["u"] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d string, n string").select("i", declared_unit("Target_Distance", F.col("d"), F.col("n")).alias("u")).orderBy("i").collect()]
    assert got == ["0.1mm", "m", "in", "cm", None, None, "ms"]


def _clock(spark, rows, **kw):
    df = spark.createDataFrame(rows, "recording_id long, sample_idx int, v double, c double, extra string")
    return {(r["recording_id"], r["sample_idx"]): r["u"] for r in clock_units(df, source="recording_id", idx="sample_idx", value="v", clock="c", out="u", **kw).collect()}


def test_clock_mixed_restart_and_gaps(spark):
    t = [100 + 0.01 * i for i in range(120)]
    rows = [(1, i, (500 + x) * (1000 if i < 60 else 1), x, "a") for i, x in enumerate(t)]  # ms, then s
    rows += [(2, i, (3000 + x if i < 50 else x - t[50]) * 1e9, x + (4.0 if 20 < i < 24 else 0), "a") for i, x in enumerate(t)]  # ns, restart near 0, late receipts
    rows += [(3, i, (500 + x) * (1000 if i != 40 else 1), x, "a") for i, x in enumerate(t)]  # one reading in s
    rows += [(4, i, None if i % 3 else 1e6 * x, x if i % 5 else None, "a") for i, x in enumerate(t)]
    rows += rows[:10]
    got = _clock(spark, rows)
    assert len(got) == 480
    assert {got[1, i] for i in range(60)} == {"ms"} and {got[1, i] for i in range(60, 120)} == {"s"}
    assert {got[2, i] for i in range(120)} == {"ns"}
    assert got[3, 40] == "s" and {got[3, i] for i in range(120) if i != 40} == {"ms"}
    assert got[4, 1] is None and got[4, 15] == "us" and got[4, 3] == "us"


def test_clock_same_over_chunks(spark):
    rows = [(1, i, (500 + 0.01 * i) * (1000 if i < 333 else 1), 0.01 * i, "a") for i in range(700)]
    assert _clock(spark, rows, chunk=128) == _clock(spark, rows)
    assert _clock(spark, []) == {}
