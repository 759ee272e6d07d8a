import numpy as np
import pytest

from cadenza.operators.grid import regular_grid

R = "recording_id long, sample_idx int, t double, value double, g0 string"
G = "recording_id long, grid_start double, grid_end double, grid_step double"


def brute(ts, ys, g0, g1, gs, h, degree):
    out = []
    for k in range(int(np.ceil((g1 - g0) / gs))):
        d = (np.array(ts) - g0) / gs - (k + 0.5)
        w = np.where(np.abs(d) < h, (1 - (np.abs(d) / h) ** 3) ** 3, 0)
        n = sum(g0 + k * gs <= t < min(g0 + (k + 1) * gs, g1) for t in ts)
        fit = None
        if (w > 0).sum() > degree:
            a = np.vander(d, degree + 1, increasing=True) * np.sqrt(w)[:, None]
            fit = np.linalg.lstsq(a, np.array(ys) * np.sqrt(w), rcond=None)[0][0]
        out.append((k, n, fit))
    return out


@pytest.mark.parametrize("degree", [0, 1, 2])
def test_against_brute_force(spark, degree):
    rng = np.random.default_rng(1)
    ts = np.sort(rng.uniform(0, 950, 60)).tolist()
    ys = np.sin(np.array(ts) / 90).tolist()
    rows = [(1, i, t, y, "x") for i, (t, y) in enumerate(zip(ts, ys))]
    rows += rows[:5]  # delivered twice
    got = regular_grid(spark.createDataFrame(rows, R), spark.createDataFrame([(1, 0.0, 955.0, 20.0)], G), degree=degree).orderBy("slot").collect()
    want = brute(ts, ys, 0.0, 955.0, 20.0, 2.5, degree)
    assert [(r["slot"], r["readings"]) for r in got] == [(k, n) for k, n, _ in want]
    checked = 0
    for r, (_, n, fit) in zip(got, want):
        if r["value"] is not None and fit is not None and r["support"] > degree + 1:
            assert r["value"] == pytest.approx(fit, abs=1e-6)
            checked += 1
    assert checked > 30


def test_nulls_empty_and_bounds(spark):
    rows = [(1, 0, 0.0, 1.0, ""), (1, 1, 10.0, None, ""), (1, 2, 20.0, float("nan"), ""), (1, 3, None, 1.0, ""), (None, 4, 5.0, 1.0, ""), (1, 5, 45.0, 2.0, ""), (9, 6, 1.0, 1.0, "")]
    grids = [(1, 0.0, 45.0, 10.0), (2, 0.0, 25.0, 10.0), (3, None, 5.0, 1.0), (4, 5.0, 1.0, 1.0), (5, 0.0, 5.0, 0.0)]
    got = regular_grid(spark.createDataFrame(rows, R), spark.createDataFrame(grids, G)).orderBy("recording_id", "slot").collect()
    assert [(r["recording_id"], r["slot"], r["readings"], r["mark"]) for r in got if r["recording_id"] == 2] == [(2, k, 0, "missing") for k in range(3)]
    one = [(r["slot"], r["readings"]) for r in got if r["recording_id"] == 1]
    assert one == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 0)]  # 45 lies at the end, which is exclusive
    assert {r["recording_id"] for r in got} == {1, 2}
    empty = regular_grid(spark.createDataFrame([], R), spark.createDataFrame([(1, 0.0, 30.0, 10.0)], G)).collect()
    assert [r["mark"] for r in empty] == ["missing"] * 3 and all(r["value"] is None for r in empty)


def test_faulty_values_count_without_weight(spark):
    rows = [(1, i, 5.0 + 10 * i, 1.0 if i != 3 else 999.0, "") for i in range(7)]
    got = {r["slot"]: r for r in regular_grid(spark.createDataFrame(rows, R), spark.createDataFrame([(1, 0.0, 70.0, 10.0)], G), valid=(-16.0, 16.0)).collect()}
    assert got[3]["readings"] == 1 and got[3]["value"] == pytest.approx(1.0)


def test_chunks_and_wide_kernels(spark):
    rng = np.random.default_rng(4)
    ts = np.sort(rng.uniform(-900, 2000, 150)).tolist() + [1e300, -1e300]
    rows = [(1, i, t, float(np.cos(t / 200)), "x") for i, t in enumerate(ts)] + [(1, 3, ts[3], float(np.cos(ts[3] / 200)), "x")]
    r, g = spark.createDataFrame(rows, R), spark.createDataFrame([(1, 0.0, 955.0, 10.0)], G)
    for h in (2.5, 80.0):  # a bandwidth far beyond the grid's edges takes in all readings it reaches
        whole, cut = ({x["slot"]: x for x in regular_grid(r, g, bandwidth=h, chunk=c).collect()} for c in (4096, 7))
        assert whole.keys() == cut.keys() == set(range(96))
        for k, x in whole.items():
            assert (x["readings"], x["mark"]) == (cut[k]["readings"], cut[k]["mark"]) and x["support"] == pytest.approx(cut[k]["support"])
            assert x["value"] == pytest.approx(cut[k]["value"]) or x["value"] is None and cut[k]["value"] is None
    d = (np.array(ts[:150]) / 10) - 0.5
    w = np.where(np.abs(d) < 80, (1 - np.minimum(1, np.abs(d) / 80) ** 3) ** 3, 0)
    assert whole[0]["support"] == pytest.approx(w.sum() ** 2 / (w * w).sum())


def test_readings_close_together_are_not_led_far(spark):
    rows = [(1, 0, 14.0, 1.0, ""), (1, 1, 14.001, 2.0, "")]
    got = {x["slot"]: x for x in regular_grid(spark.createDataFrame(rows, R), spark.createDataFrame([(1, 0.0, 30.0, 10.0)], G)).collect()}
    assert got[1]["value"] == pytest.approx(1.5, abs=1e-3)
