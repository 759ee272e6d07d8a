import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm.packing import best_fit, bin_completion, completions, lower_bound, pack, packing_report


def optimum(sizes, cap):
    """Smallest number of containers, by exhaustive search."""
    best = [len(sizes)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i]:
                go(i + 1, [r - sizes[i] if j == k else r for j, r in enumerate(rooms)])
        go(i + 1, [*rooms, cap - sizes[i]])

    go(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bounds_and_search(sizes):
    sizes = sorted(sizes, reverse=True)
    bins, proved = bin_completion(sizes, 20, None, None, None)
    assert proved
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 20 for b in bins)
    best = optimum(sizes, 20)
    assert lower_bound(sizes, 20) <= best <= len(bins) <= len(best_fit(sizes, 20))
    assert len(bins) == best
    short, sure = bin_completion(sizes, 20, 3, 1, 4)  # a search cut short stays whole and says so
    assert sorted(i for b in short for i in b) == list(range(len(sizes))) and len(short) >= best
    assert not sure or len(short) == best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8), st.integers(1, 20))
def test_undominated_fillings(sizes, room):
    sizes = sorted(sizes, reverse=True)
    free = list(range(len(sizes)))
    good, whole = completions(sizes, free, room, None, None)
    assert whole and (good or min(sizes) > room)

    def dominated(took):
        left, rest = room - sum(sizes[i] for i in took), [sizes[i] for i in free if i not in took]
        return any(s <= left or any(sizes[i] < s <= sizes[i] + left for i in took) for s in rest)

    every = [c for k in range(len(free) + 1) for c in itertools.combinations(free, k) if sum(sizes[i] for i in c) <= room]
    want = {tuple(sorted(sizes[i] for i in c)) for c in every if not dominated(c)}
    assert {tuple(sorted(sizes[i] for i in o)) for _, o in good} == want


def test_beats_best_fit():
    rng = random.Random(4)
    gain = 0
    for _ in range(60):
        sizes = sorted((rng.randint(20, 60) for _ in range(24)), reverse=True)
        gain += len(best_fit(sizes, 100)) - len(bin_completion(sizes, 100)[0])
    assert gain > 0


def check(got, want, cap):
    fill, per = {}, {}
    for r in got:
        fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
        per.setdefault(r["doc_id"], []).append((r["start"], r["size"], r["part"]))
    assert all(v <= cap for v in fill.values())
    assert all(fill[r["container"]] == r["fill"] for r in got)
    for d, n in want.items():
        parts = sorted(per.pop(d))
        assert sum(s for _, s, _ in parts) == n and parts[0][0] == 0
        assert all(a + s == b for (a, s, _), (b, _, _) in zip(parts, parts[1:]))
        assert len(parts) == -(-n // cap)
    assert not per


def test_pack(spark):
    rng = random.Random(1)
    want = {i: rng.choice([rng.randint(1, 60), rng.randint(60, 300), rng.randint(900, 2600)]) for i in range(900)}
    want[5000], want[5001] = 1000, 3000
    rows = [(k, n, "x") for k, n in want.items()] + [(8000, 0, "x"), (8001, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, container string")
    packed = pack(df, 1000, group_size=100)
    check(packed.collect(), want, 1000)
    exact = pack(df.filter("doc_id < 12"), 1000, nodes=None, width=None, effort=None)
    check(exact.collect(), {k: n for k, n in want.items() if k < 12}, 1000)
    assert exact.filter("not proved").count() == 0
    r = packing_report(packed, 1000).collect()[0]
    assert r["tokens"] == sum(want.values()) and r["containers"] <= 1.02 * r["fewest"] + 1


def test_empty_and_invalid(spark):
    df = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert pack(df, 10).count() == 0
    assert packing_report(pack(df, 10), 10).collect()[0]["containers"] == 0
    with pytest.raises(ValueError):
        pack(df, 0)
