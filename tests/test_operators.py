"""Operators of time series against closed forms traced by hand or computed with numpy."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.functions import geometry, names
from cadenza.operators import events, gaze, joins, masks, series, stats, windows

K = ["rec"]


def frame(spark, values, name="v", kind="double", rec=1):
    return spark.createDataFrame([(rec, i, float(i), v) for i, v in enumerate(values)], f"rec int, o int, t double, {name} {kind}")


def edges(spark, m, end, kind="boolean"):
    d = masks.mark_edges(frame(spark, m, "m", kind), K, "o", "m", end, kind == "int")
    return [r["i"] for r in d.filter("is_edge").orderBy("i").collect()]


def edges_closed(m):
    n = len(m)
    return sorted({0, n - 1} | {k for k in range(1, n - 1) if m[k] != m[k - 1]})


def test_edges_by_hand(spark):
    F_, T = False, True
    assert edges(spark, [F_, F_, T], True) == [0, 2]  # the last value is not looked at
    assert edges(spark, [T], True) == [0]
    assert edges(spark, [F_, T, T, F_], True) == [0, 1, 3]
    assert edges(spark, [T, T, F_, T], False) == [2, 3]
    assert edges(spark, [2, 2, 0, 1], False, "int") == [0, 2, 3]
    assert edges(spark, [0, 2, 2, 0], True, "int") == [0, 1, 3]
    assert edges(spark, [None, T, None], False) == [1, 2]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.booleans(), min_size=2, max_size=12))
def test_islands_property(spark, m):
    e = edges_closed(m)
    want = [(a, b) for a, b in zip(e[:-1], e[1:]) if m[a] and b > a]
    got = [(r["first"], r["last"]) for r in masks.islands(frame(spark, m, "m", "boolean"), K, "o", "m", "t").orderBy("first").collect()]
    assert got == want


def test_windows(spark):
    def win(f, *a):
        return [r["values"] for r in f(frame(spark, [1.0, 2.0, 3.0, 4.0, 5.0]), K, "o", "v", *a).orderBy("win").collect()]

    assert win(windows.tumbling_windows, 2) == [[1, 2], [3, 4], [5, 0]]
    assert win(windows.hopping_windows, 5, 5) == [[1, 2, 3, 4, 5], [0, 0, 0, 0, 0]]  # a multiple gains one
    assert win(windows.hopping_windows, 8, 2) == [[1, 2, 3, 4, 5, 0, 0, 0]]
    assert win(windows.hopping_windows, 3, 2) == [[1, 2, 3], [3, 4, 5]]
    assert windows.tumbling_windows(frame(spark, [1.0]).limit(0), K, "o", "v", 2).count() == 0


def test_gradient_and_smoothing(spark):
    t = np.array([0, 1, 3, 4, 7.0])
    x = t**2
    d = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, x))], "rec int, o int, t double, v double")
    w = masks.ordered(K, "o")
    got = [r["g"] for r in d.select("o", series.gradient(F.col("v"), F.col("t"), w).alias("g")).orderBy("o").collect()]
    assert got == pytest.approx(np.gradient(x, t).tolist())
    same = d.withColumn("t", F.lit(1.0)).select(series.gradient(F.col("v"), F.col("t"), w).alias("g")).collect()
    assert all(r["g"] is None for r in same)
    v = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0]
    got = [r["s"] for r in series.smooth(frame(spark, v), K, "o", "v", 5, "s").orderBy("i").collect()]
    assert got == pytest.approx([np.mean(v[:2]), np.mean(v[:3]), np.mean(v[:5]), np.mean(v[1:6]), np.mean(v[2:7]), np.mean(v[4:]), np.mean(v[5:])])


def test_stats(spark):
    assert stats.mad(frame(spark, [1.0, 2.0, 4.0]), K, "v").collect()[0]["mad"] == pytest.approx(1.4826)
    assert stats.mad(frame(spark, [1.0, None, 4.0]), K, "v").collect()[0]["mad"] is None
    v = np.array([0, 0, 0, 0, 9.0])
    got = stats.detection_radius(frame(spark, v.tolist()), K, "v", 2.0).collect()[0]["radius"]
    assert got == pytest.approx(2 * (math.sqrt((v**2).mean()) - v.mean() ** 2)) if math.sqrt((v**2).mean()) > v.mean() ** 2 else got is None
    assert stats.detection_radius(frame(spark, [0.0, 0.0]), K, "v", 2.0).collect()[0]["radius"] is None
    q = spark.range(1).select(*[stats.t_quantile(0.975, F.lit(float(k))).alias(f"d{k}") for k in (1, 2, 5, 10, 100)]).collect()[0]
    assert list(q) == pytest.approx([12.7062, 4.30265, 2.57058, 2.22814, 1.98397], abs=2e-3)


def test_clock_offset(spark):
    d = spark.createDataFrame([(1, float(i), i + 5 + 1e-6 * (-1) ** i) for i in range(50)] + [(2, float(i), i * 1.1) for i in range(50)] + [(3, 1.0, 2.0)], "rec int, a double, b double")
    got = {r["rec"]: r for r in stats.clock_offset(d, K, "a", "b").collect()}
    assert got[1]["status"] == "ok" and got[1]["intercept"] == pytest.approx(5, abs=1e-5)
    assert got[2]["status"] == "slope" and got[3]["status"] == "short"


def test_asof_end_rule(spark):
    s = frame(spark, [0.0] * 6)
    m = spark.createDataFrame([(1, 1.5, "a"), (1, 3.0, "b")], "rec int, mt double, m string")
    out = lambda **k: [r["x"] for r in joins.asof_marker(s, m, K, "o", "t", "mt", "m", "x", **k).orderBy("o").collect()]
    assert out() == [None, None, "a", "b", "b", None]
    assert out(inclusive_end=True) == [None, None, "a", "b", "b", "b"]
    late = m.withColumn("mt", F.col("mt") + 2)
    assert [r["x"] for r in joins.asof_marker(s, late, K, "o", "t", "mt", "m", "x").orderBy("o").collect()] == [None] * 4 + ["a", None]
    assert all(r["x"] is None for r in joins.asof_marker(s, m.limit(0), K, "o", "t", "mt", "m", "x").collect())


def test_nearest_date_ties_nulls_and_clashing_names(spark):
    a = spark.createDataFrame([(1, "2020-01-10", "l"), (2, "2020-01-10", "l"), (3, None, "l")], "k int, d string, x string").withColumn("d", F.to_timestamp_ntz("d"))
    b = spark.createDataFrame([(1, "2020-01-08", "p"), (1, "2020-01-12", "q"), (1, "2020-02-01", "r"), (1, None, "n"), (3, "2020-01-01", "z")], "k int, d string, x string").withColumn("d", F.to_timestamp_ntz("d"))
    got = sorted((r["k"], r["x"], r["r_x"], r["off"]) for r in joins.nearest_date_join(a, b, ["k"], "d", "d", "off").collect() if r["k"] == 1)
    assert got == [(1, "l", "p", -2.0), (1, "l", "q", 2.0)]
    rest = [(r["k"], r["off"]) for r in joins.nearest_date_join(a, b, ["k"], "d", "d", "off").filter("k > 1").collect()]
    assert rest == [(2, None)]


def test_intervals_over_bucket_borders(spark):
    s = frame(spark, [0.0] * 30)
    iv = spark.createDataFrame([(1, 3.0, 17.0, 1), (1, 17.0, 18.0, 2), (1, 9.0, 8.0, 3), (2, 0.0, 30.0, 4)], "rec int, a double, b double, n int")
    flag = [r["o"] for r in joins.interval_flag(s, iv, K, "t", "a", "b", "f", 5.0).filter("f").orderBy("o").collect()]
    assert flag == list(range(3, 19))
    num = {r["o"]: r["f"] for r in joins.interval_number(s, iv, K, "t", "a", "b", "n", "f", 5.0).collect()}
    assert num[16] == 1 and num[17] == 2 and num[18] == 0 and num[2] == 0


def test_last_writer(spark):
    left = spark.createDataFrame([(1, 0, 0.0), (1, 1, 1.0), (1, 2, 2.0)], "rec int, no int, t double")
    right = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.9), (1, 12, 1.1), (1, 13, 5.0)], "rec int, f int, t double")
    got = {r["f"]: r["no"] for r in joins.nearest_last_writer(left, right, K, "no", "t", "f", "t").collect()}
    assert got == {10: 0, 11: None, 12: 1, 13: 2}


def test_saccades_paint_the_sample_after(spark):
    d = frame(spark, [0.0, 0.0, 9.0, 9.0, 0.0, 0.0, None, 9.0], "vx").withColumn("vy", F.lit(0.0))
    got = [r["saccade"] for r in gaze.detect_saccades(d, K, "o", "t", "vx", "vy", min_duration=2.0, fixed_radius=(1.0, 1.0)).orderBy("i").collect()]
    assert got == [False, False, True, True, True, False, False, False]


def test_lowpass(spark):
    sos = gaze.butterworth_sections(7, 100.0, 1000.0)
    z = lambda f: np.exp(-2j * np.pi * f / 1000)
    gain = lambda f: abs(np.prod([(s[0] + s[1] * z(f) + s[2] * z(f) ** 2) / (1 + s[4] * z(f) + s[5] * z(f) ** 2) for s in sos]))
    assert gain(0) == pytest.approx(1) and gain(100) == pytest.approx(2**-0.5, rel=1e-6) and gain(300) < 1e-3
    x = np.sin(2 * np.pi * 5 * np.arange(500) / 1000)
    assert np.abs(gaze.zero_phase(x, sos) - x)[50:-50].max() < 1e-3
    y = np.random.default_rng(4).normal(0, 1, 1500)
    whole, cut = ([r["v"] for r in gaze.zero_phase_lowpass(frame(spark, y.tolist()), K, "o", "v", **k).orderBy("o").collect()] for k in ({}, {"chunk": 500, "halo": 400}))
    assert len(cut) == 1500 and cut == pytest.approx(whole, abs=1e-6)
    d = gaze.zero_phase_lowpass(frame(spark, [1.0] * 30 + [None]), K, "o", "v").collect()
    assert len(d) == 30 and all(r["v"] == pytest.approx(1.0) for r in d)


def test_trials_and_boundaries(spark):
    m = [("a", 0), ("Trial_start_1", 1), ("n", 2), ("click", 3), ("Trial_end_1", 4), ("click", 5), ("PracticeTrial_start", 6), ("PracticeTrial_end", 7), ("Trial_start_2", 8)]
    d = spark.createDataFrame([(1, i, float(t), x) for i, (x, t) in enumerate(m)], "rec int, o int, t double, text string")
    x = F.col("text")
    got = events.trials(d, K, "o", "text", "t", x.contains("Trial_start"), x.contains("Trial_end"), x == "click", F.when(x == "n", 3)).orderBy("trial").collect()
    assert [(r["practice"], r["start_time"], r["end_time"], r["n_targets"], r["click_times"]) for r in got] == [(False, 1.0, 4.0, 3, [3.0]), (True, 6.0, 7.0, None, [])]
    b = events.boundaries(d, K, "o", "text", "t", *events.PREFIXES["trial"]).orderBy("k").collect()
    assert [(r["start"], r["end"]) for r in b] == [(6.0, 7.0), (1.0, 4.0), (8.0, None)]  # by prefix, then time
    assert events.boundary_status(events.boundaries(d, K, "o", "text", "t", *events.PREFIXES["trial"]), K).collect()[0]["status"] == "unequal"


def test_names(spark):
    rows = ["200000_2019-03-23_14h-40m-28s_timing_test_obs_2_R001-Eyelink_1.hdf5", "200000_2019-13-23_14h-40m-28s_mouse_obs_R001-Mouse.hdf5", "notes.txt", None, "1_2020-01-02_03h-04m-05s_passage_obs_1_R001-Mbient_LH_2.HDF5"]
    got = names.parse_file_names(spark.createDataFrame([(i, n) for i, n in enumerate(rows)], "i int, file string"), "file").orderBy("i").collect()
    assert got[0]["task_name"] == "timing_test_obs" and got[0]["ok"]  # the first prefix in order wins
    assert [r["ok"] for r in got] == [True, False, False, False, True]
    assert got[4]["device_which"] == "Left Hand" and got[4]["ext"] == ".hdf5"
    s = spark.createDataFrame([(["a\"b", "c"], "x.tar.gz")], "a array<string>, n string").select(names.array_literal(F.col("a")).alias("l"), names.change_extension(F.col("n"), ".csv").alias("e")).collect()[0]
    assert s["l"] == '{"a\\"b","c"}' and s["e"] == "x.tar.csv"


def test_geometry(spark):
    d = spark.createDataFrame([(1, 0.0, 0.0, 15000.0, 0.0)], "rec int, x double, y double, x2 double, y2 double")
    r = d.select(geometry.rotation_angle(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")).alias("a"), geometry.resolution(F.col("x"), F.col("y"))[0].alias("r")).collect()[0]
    assert r["a"] == pytest.approx(45) and r["r"] == pytest.approx(15000 * math.pi / 180)


def test_first_last_and_last_per_key(spark):
    d = frame(spark, [1, 1, 2, 3, 3], "f", "int")
    assert [r["o"] for r in events.first_last_once(d, K, "o", "f").orderBy("o").collect()] == [1, 2, 3]
    x = spark.createDataFrame([(1, 0, "a", None), (1, 1, None, "b"), (1, 2, None, None)], "k int, o int, x string, y string")
    assert joins.last_per_key(x, ["k"], "o").collect()[0].asDict() == {"k": 1, "o": 2, "x": "a", "y": "b"}


def test_partitions_change_nothing(spark):
    v = np.random.default_rng(1).normal(0, 1, 200) > 0
    d = frame(spark, [bool(x) for x in v], "m", "boolean")
    a = masks.islands(d, K, "o", "m", "t").collect()
    b = masks.islands(d.orderBy(F.rand(3)).repartition(7), K, "o", "m", "t").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
