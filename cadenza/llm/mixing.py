"""Mixing overlapping sources to target shares: min-cost flow over membership patterns, then seeded selection."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir


class Flow:
    """Min-cost flow by successive shortest paths, for graphs of a few thousand arcs."""

    def __init__(self, n: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, cap: int, cost: int = 0) -> int:
        k = len(self.to)
        for u, v, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[u].append(len(self.to))
            self.to.append(v)
            self.cap.append(c)
            self.cost.append(w)
        return k

    def run(self, s: int, t: int) -> int:
        total = 0
        while True:
            dist: dict[int, int] = {s: 0}
            via: dict[int, int] = {}
            todo, queued = deque([s]), {s}
            while todo:
                u = todo.popleft()
                queued.discard(u)
                for k in self.out[u]:
                    if self.cap[k] > 0 and dist[u] + self.cost[k] < dist.get(self.to[k], 1 << 60):
                        dist[self.to[k]] = dist[u] + self.cost[k]
                        via[self.to[k]] = k
                        if self.to[k] not in queued:
                            queued.add(self.to[k])
                            todo.append(self.to[k])
            if t not in dist:
                return total
            path, v = [], t
            while v != s:
                path.append(via[v])
                v = self.to[via[v] ^ 1]
            push = min(self.cap[k] for k in path)
            for k in path:
                self.cap[k] -= push
                self.cap[k ^ 1] += push
            total += push


def route(patterns: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int], total: int) -> tuple[dict[tuple[tuple[str, ...], str], int], int]:
    """Tokens that each pattern (set of sources) gives to each source, and the sum.

    The k-th use of a pattern's tokens costs k*k, so that repetitions come last and evenly. A pattern's
    tokens are used at most as often as the strictest of its sources allows."""
    ps, ss = sorted(patterns), sorted(shares)
    f = Flow(2 + len(ps) + len(ss))
    src = {s: 2 + len(ps) + i for i, s in enumerate(ss)}
    arcs = {}
    for i, p in enumerate(ps):
        for k in range(1, min(repeats[s] for s in p) + 1):
            f.arc(0, 2 + i, patterns[p], k * k)
        for s in p:
            arcs[p, s] = f.arc(2 + i, src[s], 1 << 60)
    for s in ss:
        f.arc(src[s], 1, int(round(shares[s] * total)))
    got = f.run(0, 1)
    return {k: f.cap[a ^ 1] for k, a in arcs.items() if f.cap[a ^ 1]}, got


def largest_total(patterns: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int]) -> int:
    """Largest total at which every source that has any tokens reaches its quota in full."""
    there = {s for p in patterns for s in p}
    present = {s: v for s, v in shares.items() if s in there and v > 0}
    if not present:
        return 0
    lo, hi = 0, int(sum(t * min(repeats[s] for s in p) for p, t in patterns.items()) / sum(present.values())) + 1
    while hi - lo > max(1, lo // 10**6):
        mid = (lo + hi) // 2
        _, got = route(patterns, present, repeats, mid)
        lo, hi = (mid, hi) if got >= sum(int(round(v * mid)) for v in present.values()) else (lo, mid)
    return lo


def mix(docs: DataFrame, targets: DataFrame, *, total: int | None = None, seed: int = 7, bucket_rows: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(uses, report). `docs`: doc_id, source, key (equal for copies of one text), n_tokens. `targets`: source, target_share, max_repeats.

    uses: (doc_id, source, copies, n_tokens): how often a record is used for a source. A record is one text; its membership pattern
    is the set of target sources it occurs in, and doc_id is its smallest there. No record is used more often than the strictest
    of its sources allows. report: per target (source, target_share, actual_share, target_tokens, actual_tokens, records, most_uses,
    folded_rows, folded_tokens, shared_records, shared_tokens). Folded are the source's further copies of a record, which add no capacity; shared are records that also occur in another source.
    `total` in tokens; by default the largest at which every source that has texts reaches its share. Sources without any text stay at 0
    and show as such; documents of sources without a target are not used.

    Only patterns (at most 2 to the number of targets) come to the driver. Selection follows a seeded hash order within
    each pattern: running sums are taken over hash buckets of about `bucket_rows` records and then inside the buckets, so that a pattern with most of
    the corpus is never one task. Null or empty texts (0 tokens) and null sources are not used. Empty documents or targets give no uses."""
    spark = docs.sparkSession
    shared_dir(spark)
    t = [(r["source"], float(r["target_share"]), int(r["max_repeats"])) for r in targets.filter("source is not null").collect()]
    shares, repeats = {s: v for s, v, _ in t}, {s: max(1, k) for s, _, k in t}
    d = docs.filter("n_tokens > 0 and key is not null").join(F.broadcast(targets.select("source")), "source", "left_semi")
    own = d.groupBy("key", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("rows"))
    rec = own.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("source", "doc_id", "rows"))).alias("members"), F.max("n_tokens").alias("n_tokens"))
    rec = rec.withColumn("pattern", F.transform("members", lambda m: m["source"])).checkpoint()
    stat = rec.groupBy("pattern").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()
    patterns = {tuple(r["pattern"]): int(r["tokens"]) for r in stat}
    if total is None:
        total = largest_total(patterns, shares, repeats)
    flow, _ = route(patterns, shares, repeats, total) if patterns else ({}, 0)
    # the uses of a pattern form a line of epochs, on which each source has an interval
    lines, start = [], {}
    for (p, s), v in sorted(flow.items()):
        a = start.get(p, 0)
        lines.append((list(p), s, a, a + v))
        start[p] = a + v
    plan = spark.createDataFrame(lines, "pattern array<string>, to string, a long, b long")
    per = spark.createDataFrame([(list(p), v, patterns[p], -(-v // patterns[p])) for p, v in start.items()], "pattern array<string>, used long, epoch_tokens long, epochs long")
    buckets = max(1, -(-sum(int(r["n"]) for r in stat) // bucket_rows))
    h = F.xxhash64("key", F.lit(seed))
    r = rec.join(F.broadcast(per), "pattern").withColumn("h", h).withColumn("bucket", F.floor((F.shiftrightunsigned("h", 1) / F.lit(float(2**63))) * buckets))
    sums = r.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("bt"))
    sums = sums.withColumn("before", F.coalesce(F.sum("bt").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("bt")
    within = Window.partitionBy("pattern", "bucket").orderBy(F.shiftrightunsigned("h", 1), "key").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(sums, ["pattern", "bucket"])
    r = r.withColumn("e", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    mid = F.col("e") * F.col("epoch_tokens") + F.col("before") + F.col("inner") + F.col("n_tokens") / 2
    r = r.withColumn("mid", mid).filter("mid < used")
    u = r.alias("r").join(F.broadcast(plan).alias("p"), (F.col("r.pattern") == F.col("p.pattern")) & (F.col("mid") >= F.col("a")) & (F.col("mid") < F.col("b")))
    doc = F.filter("members", lambda m: m["source"] == F.col("to"))[0]["doc_id"]
    uses = u.groupBy("key", doc.alias("doc_id"), F.col("to").alias("source")).agg(F.count(F.lit(1)).alias("copies"), F.max("n_tokens").alias("n_tokens"))
    uses = uses.select("doc_id", "source", "copies", "n_tokens").checkpoint()
    got = uses.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("actual_tokens"), F.count(F.lit(1)).alias("records"), F.max("copies").alias("most_uses"))
    zero = F.lit(0).cast("long")
    m = rec.select(F.explode("members").alias("m"), "n_tokens", (F.size("members") > 1).cast("long").alias("more")).select("m.source", (F.col("m.rows") - 1).alias("again"), "n_tokens", "more")
    folds = {"folded_rows": F.col("again"), "folded_tokens": F.col("again") * F.col("n_tokens"), "shared_records": F.col("more"), "shared_tokens": F.col("more") * F.col("n_tokens")}
    folded = m.groupBy("source").agg(*[F.sum(c).alias(k) for k, c in folds.items()])
    report = targets.join(got, "source", "left").join(folded, "source", "left").select(
        "source", "target_share", F.round(F.try_divide(F.coalesce("actual_tokens", zero), F.sum("actual_tokens").over(Window.partitionBy())), 6).alias("actual_share"),
        F.round(F.col("target_share") * total).cast("long").alias("target_tokens"), F.coalesce("actual_tokens", zero).alias("actual_tokens"), F.coalesce("records", zero).alias("records"), F.coalesce("most_uses", zero).alias("most_uses"),
        *[F.coalesce(k, zero).alias(k) for k in folds],
    )
    return uses, report
