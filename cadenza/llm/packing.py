"""Filling containers of fixed capacity: bin completion with branch and bound, group by group."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ship import by_value
from ..session import shared_dir


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indexes of `sizes` (sorted downwards) by container."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i, s in enumerate(sizes):
        k = bisect_left(room, (s, -1))
        if k == len(room):
            bins.append([i])
            insort(room, (capacity - s, len(bins) - 1))
        else:
            r, b = room.pop(k)
            bins[b].append(i)
            insort(room, (r - s, b))
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Fewest containers that waste bounds allow: total size, and for each k the containers that items over capacity-k fill alone (with what smaller items can't use)."""
    best = -(-sum(sizes) // capacity)
    big = [s for s in sizes if 2 * s > capacity]
    best = max(best, len(big))
    for k in sorted({s for s in sizes if 2 * s <= capacity}):
        n1 = sum(1 for s in sizes if s > capacity - k)
        two = [s for s in big if s <= capacity - k]
        small = sum(s for s in sizes if k <= s and 2 * s <= capacity)
        best = max(best, n1 + len(two) + max(0, -(-(small - (capacity * len(two) - sum(two))) // capacity)))
        if n1 == 0 and not two:
            break
    return best


def completions(sizes: list[int], free: list[int], room: int, width: int | None, effort: int | None) -> tuple[list[tuple[int, list[int]]], bool]:
    """Undominated fillings of `room` by free items (indexes, sizes downwards), least waste first, and whether these are all there are.

    A filling is dominated if another item still fits, or if one of its items could give way to a larger free one. The
    search goes from large to small; it ends after `effort` nodes, and at most `width` fillings come out; None sets no bound. The first leaf is
    the greedy filling, which nothing dominates, so there always is one."""
    out: list[tuple[int, tuple[int, ...]]] = []
    seen: set[tuple[int, ...]] = set()
    n, nodes, whole = len(free), 0, True
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    while stack:
        if effort is not None and nodes >= effort:
            whole = False
            break
        j, left, took = stack.pop()
        nodes += 1
        while j < n and sizes[free[j]] > left:
            j += 1
        if j == n or left == 0:
            key = tuple(sizes[free[t]] for t in took)
            if key not in seen:
                seen.add(key)
                out.append((left, took))
                if left == 0 and width is not None and len(out) >= width:
                    whole = whole and not stack
                    break
            continue
        nxt = j + 1
        while nxt < n and sizes[free[nxt]] == sizes[free[j]]:
            nxt += 1  # leaving an item out leaves out its equals too
        if nxt < n:
            stack.append((nxt, left, took))
        stack.append((j + 1, left - sizes[free[j]], (*took, j)))
    good = []
    for left, took in sorted(out, key=lambda x: x[0]):
        inside = set(took)
        rest = [sizes[free[k]] for k in range(n) if k not in inside]
        if any(s <= left or any(sizes[free[t]] < s <= sizes[free[t]] + left for t in took) for s in rest):
            continue
        if len(good) == width:
            return good, False
        good.append((left, [free[t] for t in took]))
    return good, whole


def bin_completion(sizes: list[int], capacity: int, nodes: int | None = 400, width: int | None = 4, effort: int | None = 300) -> tuple[list[list[int]], bool]:
    """Containers (lists of indexes into `sizes`, which must be sorted downwards) by branch and bound, and whether fewer are proved impossible.

    Each node fills the container of the largest item left with one of its undominated completions; branches whose waste
    rules out fewer containers than the incumbent are pruned. Best fit decreasing is the first incumbent. The search ends when the
    lower bound is met, when all branches are pruned, or after `nodes` nodes with the best solution so far, which is always whole. With nodes, width and
    effort None it is exact, and its time unbounded."""
    best = best_fit(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    if len(best) <= bound:
        return best, True
    slack = capacity * (len(best) - 1) - sum(sizes)  # waste that a solution with one container less may have
    count, exact = 0, True
    stack: list[tuple[list[int], list[list[int]], int]] = [(list(range(len(sizes))), [], 0)]
    while stack:
        if nodes is not None and count >= nodes:
            return best, False
        left, done, waste = stack.pop()
        count += 1
        while left:
            head, rest = left[0], left[1:]
            room = capacity - sizes[head]
            fits = [i for i in rest if sizes[i] <= room]
            options, all_ = completions(sizes, fits, room, width, effort) if fits else ([(room, [])], True)
            exact &= all_
            options = [(w, o) for w, o in options if waste + w <= slack]
            if not options or len(done) + 1 >= len(best):
                break
            for w, o in reversed(options[1:]):
                gone = set(o)
                stack.append(([i for i in rest if i not in gone], [*done, [head, *o]], waste + w))
            w, o = options[0]
            gone = set(o)
            left, done, waste = [i for i in rest if i not in gone], [*done, [head, *o]], waste + w
            count += 1
        if not left and len(done) < len(best):
            best = done
            if len(best) <= bound:
                return best, True
            slack = capacity * (len(best) - 1) - sum(sizes)
    return best, exact


def _pack_group(capacity: int, label: str, nodes: int | None, width: int | None, effort: int | None):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["size", "doc_id", "start"], ascending=[False, True, True], ignore_index=True)
        bins, proved = bin_completion([int(x) for x in f["size"]], capacity, nodes, width, effort)
        at, fill = np.zeros(len(f), "int64"), np.zeros(len(f), "int64")
        sizes = f["size"].to_numpy()
        for k, items in enumerate(bins):
            at[items] = k
            fill[items] = sizes[items].sum()
        g = int(f["grp"].iloc[0])
        return pd.DataFrame({"doc_id": f["doc_id"], "part": f["part"], "start": f["start"], "size": f["size"], "container": [f"{label}-{g}-{k}" for k in at], "fill": fill, "proved": proved})

    return run


def pack(items: DataFrame, capacity: int, *, group_size: int = 512, redo_below: float = 0.985, rounds: int = 2, nodes: int | None = 400, width: int | None = 4, effort: int | None = 300, task_rows: int = 400_000) -> DataFrame:
    """Containers for documents: (container, doc_id, part, start, size, fill, proved).

    `items` has doc_id and n_tokens. A document over the capacity is split into full containers and a rest, which
    is packed like any other; all others stay whole (part 0, start 0). Items are hashed into groups of about `group_size`, so that no task sees
    more whatever the corpus; each group is packed by bin completion. Containers filled less than `redo_below` of the
    capacity are opened again and their items packed in new groups, so that the groups' last containers don't add up.
    `nodes` (per group), `width` and `effort` (fillings tried and nodes looked at per container) bound the time of the search, not what is packed; with None for
    all three it is exact within a group. `proved` tells whether the container's group is known to need no container less.
    Documents with null or 0 tokens take no place and don't come out. Repeated doc_ids are items of their own. No rows give no containers.
    Every table cut (checkpoint) has one narrow row per document."""
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    spark = items.sparkSession
    shared_dir(spark)
    full = F.floor((F.col("n_tokens") - 1) / capacity).cast("long")
    d = items.filter("n_tokens > 0").select("doc_id", "n_tokens", full.alias("full"))
    cut = d.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), "full")).alias("part"), "n_tokens", "full")
    size = F.when(F.col("part") < F.col("full"), F.lit(capacity)).otherwise(F.col("n_tokens") - F.col("full") * capacity)
    cut = cut.select("doc_id", "part", (F.col("part") * capacity).alias("start"), size.cast("long").alias("size"))
    cut = cut.checkpoint()  # the sizes are needed several times, the texts behind them read once
    schema = "doc_id long, part long, start long, size long, container string, fill long, proved boolean"
    whole = cut.filter(F.col("size") == capacity).withColumn("container", F.concat_ws("-", F.lit("f"), "doc_id", "part", F.monotonically_increasing_id())).withColumn("fill", F.lit(capacity).cast("long")).withColumn("proved", F.lit(True))
    out = whole
    todo = cut.filter(F.col("size") < capacity)
    for r in range(rounds):
        n = todo.count()
        if n == 0:
            break
        groups = max(1, -(-n // group_size))
        tasks = max(2 * spark.sparkContext.defaultParallelism, -(-n // task_rows))  # few bytes, much work: by rows
        last = r == rounds - 1 or groups == 1
        packed = todo.withColumn("grp", F.pmod(F.xxhash64("doc_id", "part", F.lit(r)), F.lit(groups)).cast("long")).repartition(tasks, "grp").groupBy("grp").applyInPandas(_pack_group(capacity, f"r{r}", nodes, width, effort), schema)
        if last:
            out = out.unionByName(packed)
            break
        packed = packed.checkpoint()
        keep = F.col("fill") >= redo_below * capacity
        out = out.unionByName(packed.filter(keep))
        todo = packed.filter(~keep).select("doc_id", "part", "start", "size")
    return out.select("container", "doc_id", "part", "start", "size", "fill", "proved")


def packing_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, fewest (containers that the total needs at least), unused (share of all room), proved (containers of groups
    that are known to need no container less)."""
    c = packed.groupBy("container").agg(F.sum("size").alias("fill"), F.max("proved").alias("proved"))
    a = c.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("fill"), F.lit(0)).alias("tokens"), F.count(F.when(F.col("proved"), 1)).alias("proved"))
    return a.select("containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("fewest"), F.round(1 - F.try_divide(F.col("tokens"), F.col("containers") * capacity), 6).alias("unused"), "proved")


by_value(__name__)
