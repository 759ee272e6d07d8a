"""Exclusion around blinks against brute force, and with regions that last far longer than any bucket."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import joins
from cadenza.plans import reference_queries

S = "rec string, o long, t double, b boolean, s boolean"


def regions(mask):
    """(first, last) of true regions: edges are the first and the last sample and every change between."""
    n = len(mask)
    e = sorted({0, n - 1} | {k for k in range(1, n - 1) if mask[k] != mask[k - 1]})
    return [(a, b) for a, b in zip(e, e[1:]) if mask[a]]


def excluded(rows, margin):
    t, near = [r[2] for r in rows], [False] * len(rows)
    for a, b in regions([bool(r[3]) for r in rows]):
        if t[a] is not None and t[b] is not None:
            near = [x or (v is not None and t[a] - margin <= v <= t[b] + margin) for x, v in zip(near, t)]
    out = list(near)
    for a, b in regions([bool(r[4]) for r in rows]):
        if any(near[a:b]):
            out[a:b] = [True] * (b - a)
    return out


def recordings(seed):
    rng = np.random.default_rng(seed)
    maybe = lambda p, q: None if rng.random() < q else bool(rng.random() < p)
    every = {}
    for k in range(30):
        n, p, stay = int(rng.integers(1, 90)), rng.random() / 3, rng.random()
        o = np.cumsum(rng.integers(1, 12, n)) - 60
        t = np.cumsum(rng.integers(0, 4, n)).astype(float) - 20
        if k % 5 == 4:
            rng.shuffle(t)  # regions may end before they begin
        rows, b, s = [], None, None
        for i in range(n):
            if i == 0 or rng.random() > stay:
                b, s = maybe(p, 0.1), maybe(0.5, 0.1)
            rows.append((f"r{k}", int(o[i]), None if k % 3 == 1 and rng.random() < 0.1 else float(t[i]), b, s))
        every[f"r{k}"] = rows
    return every, rng


@pytest.mark.parametrize(("seed", "width", "size"), [(1, 7.0, 16), (2, 1.0, 8), (3, 1000.0, 65536)])
def test_exclusion_against_brute_force(spark, seed, width, size):
    every, rng = recordings(seed)
    want = {(r[0], r[1]): x for rows in every.values() for r, x in zip(rows, excluded(rows, 2.0))}
    flat = [r for rows in every.values() for r in rows]
    flat = [flat[k] for k in rng.permutation(len(flat))] + [(None, 1, 1.0, True, True), (None, 2, 2.0, False, True)]
    want |= {(None, 1): False, (None, 2): False}  # rows without a key match nothing
    df = spark.createDataFrame(flat, S).repartition(3)
    got = {(r["rec"], r["o"]): r["x"] for r in joins.overlap_expand(df, ["rec"], "o", "t", "b", "s", 2.0, "x", width, size).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)
    real = joins.overlap_expand(df.withColumn("o", F.col("o").cast("double")), ["rec"], "o", "t", "b", "s", 2.0, "x", width, size)
    assert {(r["rec"], int(r["o"])): r["x"] for r in real.collect()} == want
    assert joins.overlap_expand(df.limit(0), ["rec"], "o", "t", "b", "s", 2.0, "x").collect() == []


def test_work_does_not_grow_with_the_length_of_regions(spark, tmp_path):
    """A region over thousands of years; listed in buckets of a minute it would be billions of rows."""
    at = [dt.datetime(1, 1, 1), dt.datetime(2000, 1, 1), dt.datetime(9000, 1, 1), dt.datetime(9000, 1, 1, 0, 10), dt.datetime(9000, 1, 1, 0, 20), dt.datetime(9000, 1, 2)]
    kind, value = ["error", "error", "view", "view", "view", "view"], [0.0, 0.0, 0.0, 200.0, 200.0, 0.0]
    rows = [(k, 1, at[k], kind[k], value[k]) for k in range(6)] + [(9, 2, at[2], "view", 200.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r["excluded"] for r in reference_queries.QUERIES["blink_exclusion"](spark, str(tmp_path)).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: True, 5: False, 9: False}
