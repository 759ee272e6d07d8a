"""Operators on long recordings give the same in small chunks as in one."""

import numpy as np
from pyspark.sql import functions as F

from cadenza.operators import masks, series

S = "rec string, pos long, t double, v double, m boolean, extra string"


def rows(n=157):
    rng = np.random.default_rng(3)
    out = []
    for rec in ("a", "b", None):
        at = np.cumsum(rng.integers(1, 40, n if rec == "a" else 3)) - 50
        for k, p in enumerate(at):
            out.append((rec, int(p), float(k) * 0.1 + rng.random() * 0.05, None if k % 17 == 5 else float(rng.normal()), None if k % 23 == 7 else bool(rng.random() < 0.6), "x"))
    order = rng.permutation(len(out))
    return [out[k] for k in order] + [("one", 5, 1.0, 2.0, True, "x")]


def same(a, b):
    key = lambda r: tuple(str(r[c]) for c in sorted(a.columns))
    x, y = sorted(map(key, a.collect())), sorted(map(key, b.collect()))
    assert x == y and x
    return x


def test_positions(spark):
    df = spark.createDataFrame(rows(), S)
    small = masks.with_position(df, ["rec"], "pos", 64)
    same(small, masks.with_position(df, ["rec"], "pos"))
    same(small, masks.with_position(df.withColumn("pos", F.col("pos").cast("double")), ["rec"], "pos").withColumn("pos", F.col("pos").cast("long")))
    got = [(r["pos"], r["i"], r["n"]) for r in small.filter("rec = 'a'").orderBy("pos").collect()]
    assert [i for _, i, _ in got] == list(range(157)) and {n for _, _, n in got} == {157}
    assert masks.with_position(df.limit(0), ["rec"], "pos").count() == 0


def test_edges_runs_paint_smooth_gradient(spark):
    df = spark.createDataFrame(rows(), S)
    k = ["rec"]
    for ends in (True, False):
        same(masks.mark_edges(df, k, "pos", "m", ends, size=16), masks.mark_edges(df, k, "pos", "m", ends))
    small, whole = masks.mark_runs(df, k, "pos", "m", size=16), masks.mark_runs(df, k, "pos", "m")
    same(small, whole)
    long = masks.runs(whole, k, "m", "t").filter("on and last - first >= 2")
    same(masks.paint(small, k, long, "hit", size=16), masks.paint(whole, k, long, "hit"))
    rounded = lambda d, c: d.withColumn(c, d[c].cast("decimal(18,9)"))
    same(rounded(series.smooth(df, k, "pos", "v", 5, "s", size=16), "s"), rounded(series.smooth(df, k, "pos", "v", 5, "s"), "s"))
    same(rounded(series.with_gradient(df, k, "pos", "t", {"g": "v"}, size=16), "g"), rounded(series.with_gradient(df, k, "pos", "t", {"g": "v"}), "g"))
