import random

import pytest

from cadenza.llm.mixing import largest_total, mix, route

T = "source string, target_share double, max_repeats int"
D = "doc_id long, source string, key string, n_tokens long, share double"


def test_route_repeats_last_and_caps():
    got, total = route({("a",): 100, ("b",): 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3}, 100)
    assert got == {(("a",), "a"): 50, (("b",), "b"): 30} and total == 80
    # an overlap goes where it saves repetitions
    got, total = route({("a",): 50, ("b",): 20, ("a", "b"): 30}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}, 100)
    assert total == 100 and got[("a", "b"), "b"] == 30 and got[("b",), "b"] == 20
    assert largest_total({("a",): 100, ("b",): 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3}) in (60, 61)  # a half token either way
    assert largest_total({}, {"a": 1.0}, {"a": 1}) == 0


def docs(spark, n=1500):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        s = rng.choice(["a"] * 6 + ["b"] * 2 + ["c"])
        rows.append((i, s, f"k{i}", rng.randint(1, 40), 0.0))
    rows += [(10_000 + i, "c", f"k{i}", rows[i][3], 0.0) for i in range(0, min(60, n)) if rows[i][1] != "c"]  # overlaps
    rows += [(20_000, "a", None, 5, 0.0), (20_001, None, "z", 5, 0.0), (20_002, "a", "y", 0, 0.0), (20_003, "other", "w", 9, 0.0)]
    return spark.createDataFrame(rows, D), rows


def test_shares_and_repeats(spark):
    d, rows = docs(spark)
    t = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("gone", 0.1, 3)], T)
    uses, report = mix(d, t, bucket_rows=64)
    u = uses.collect()
    key = {r[0]: (r[1], r[2], r[3]) for r in rows}
    limit = {"a": 1, "b": 2, "c": 4}
    member: dict = {}
    for _, s, k, n, _ in rows:
        if k and s in limit and n:
            member.setdefault(k, set()).add(s)
    total: dict = {}
    for r in u:
        s, k, n = key[r["doc_id"]]
        assert s == r["source"] and n == r["n_tokens"]
        total[k] = total.get(k, 0) + r["copies"]
    assert all(v <= min(limit[s] for s in member[k]) for k, v in total.items())
    rep = {r["source"]: r for r in report.collect()}
    assert rep["gone"]["actual_tokens"] == 0
    whole = sum(r["actual_tokens"] for r in rep.values())
    for s, share in (("a", 0.4), ("b", 0.3), ("c", 0.2)):
        assert rep[s]["actual_tokens"] / whole == pytest.approx(share / 0.9, abs=0.01)
    again, _ = mix(d.repartition(7), t, bucket_rows=64)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in u}
    other, _ = mix(d, t, seed=8, total=int(0.5 * whole))
    assert {tuple(r) for r in other.collect()} != {tuple(r) for r in u}


def test_empty(spark):
    d, _ = docs(spark, 10)
    t = spark.createDataFrame([("a", 1.0, 1)], T)
    uses, report = mix(d.limit(0), t)
    assert uses.count() == 0 and report.collect()[0]["actual_tokens"] == 0
    assert mix(d, t.limit(0))[0].count() == 0


def test_report_tells_what_was_folded(spark):
    d = spark.createDataFrame([(1, "a", "x", 5, 0.0), (2, "a", "x", 5, 0.0), (3, "a", "x", 5, 0.0), (4, "b", "x", 5, 0.0), (5, "b", "y", 7, 0.0), (6, "a", "z", 9, 0.0), (7, "a", "z", 0, 0.0)], D)
    _, report = mix(d, spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 1), ("gone", 0.1, 1)], T))
    got = {r["source"]: (r["folded_rows"], r["folded_tokens"], r["shared_records"], r["shared_tokens"]) for r in report.collect()}
    assert got == {"a": (2, 10, 1, 5), "b": (0, 0, 1, 5), "gone": (0, 0, 0, 0)}
