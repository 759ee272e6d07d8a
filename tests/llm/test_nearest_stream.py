import numpy as np

from cadenza.llm.nearest_stream import replay_nearest

ROWS = "entity long, is_left boolean, no long, t double, extra string"
TOL = {0: 0.015, 1: 0.005, 2: 0.0, 3: 0.0}


def brute(rows):
    out = {}
    for e, left, no, t, _ in rows:
        if not left or e is None or t is None or t != t:
            continue
        best = min(((abs(u - t), n) for f, l, n, u, _ in rows if f == e and not l and u is not None and u == u and abs(u - t) <= TOL[e % 4] + 1e-9), default=None)
        if best:
            out[e, no] = best[1]
    return out


def run(spark, rows, **kw):
    got = replay_nearest(spark, spark.createDataFrame(rows, ROWS), TOL, **kw).collect()
    assert len({(r["entity"], r["left_no"]) for r in got}) == len(got)
    return {(r["entity"], r["left_no"]): r["right_no"] for r in got}


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for e in (4, 5, 8):
        start = rng.uniform(0, 500)
        rows += [(e, False, i, float(x), "r") for i, x in enumerate(start + np.sort(rng.uniform(0, 45, 300)))]
        rows += [(e, True, i, float(x), "l") for i, x in enumerate(start + np.sort(rng.uniform(0, 45, 80)))]
    rows += rows[:40] + [(4, True, 999, None, "l"), (4, False, 998, float("nan"), "r"), (None, True, 1, 3.0, "l")]
    rng.shuffle(rows)
    rows = [tuple(r) for r in rows]
    rows = [(None if e is None else int(e), bool(l), int(n), None if t is None else float(t), x) for e, l, n, t, x in rows]
    want = brute(rows)
    assert len(want) > 30
    assert run(spark, rows, width=10.0) == want


def test_ties_borders_and_sharing(spark):
    rows = [
        (4, False, 7, 10.0, ""), (4, False, 3, 10.0, ""),  # equal times: the smaller number
        (4, True, 0, 10.001, ""),
        (4, False, 8, 20.0, ""), (4, False, 9, 20.015625, ""), (4, True, 1, 20.0078125, ""),  # equally far
        (4, False, 10, 30.001, ""), (4, True, 2, 29.999, ""), (4, True, 3, 30.0, ""),  # over a bucket's border, shared
        (5, True, 4, 10.0, ""),  # no right side
        (4, True, 5, 10.02, ""),  # out of tolerance
    ]
    assert run(spark, rows, width=10.0) == {(4, 0): 3, (4, 1): 8, (4, 2): 10, (4, 3): 10}


def test_empty(spark):
    assert run(spark, []) == {}


def test_state_stays_flat_and_folders_go(spark):
    """Ten times the rows: as many slices more, and no more state after a batch."""
    from cadenza.session import shared_dir

    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    before = {str(f.getPath().getName()) for f in fs.listStatus(path)} if fs.exists(path) else set()
    peak = []
    for seconds in (120, 1200):
        rows = [(4, False, i, i / 2, "") for i in range(seconds * 2)] + [(4, True, i, i + 0.001, "") for i in range(seconds)]
        seen = []
        got = run(spark, rows, width=5.0, core_rows=30, key_rows=20, progress=seen)
        assert got == {(4, i): 2 * i for i in range(seconds)}
        peak.append(max(seen))
    assert 0 < peak[1] <= 2 * peak[0]
    for name in {str(f.getPath().getName()) for f in fs.listStatus(path)} - before:
        if name.startswith("nearest-"):
            left = {str(f.getPath().getName()) for f in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}"))}
            assert left == {"pairs"}


def test_state_is_emitted_and_evicted_as_the_watermark_passes(spark, tmp_path):
    from cadenza.llm.nearest_stream import keyed, nearest_stream

    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "entity long, bucket long, is_left boolean, no long, t double, phase long, event timestamp"

    def arrive(rows):
        d = keyed(spark.createDataFrame(rows, ROWS).drop("extra"), 0.015, 10.0, 12)
        d.select("entity", "bucket", "is_left", "no", "t", "phase", "event").write.mode("append").parquet(src)

    arrive([(4, True, 1, 5.0, ""), (4, False, 10, 5.004, "")])
    q = nearest_stream(spark.readStream.schema(schema).parquet(src), TOL, width=10.0, phases=12, delay="2 seconds", groups=2).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).start()
    try:
        q.processAllAvailable()
        assert spark.read.parquet(out).count() == 0  # the horizon hasn't passed
        arrive([(4, False, 11, 5.001, ""), (4, False, 12, 30.0, "")])
        q.processAllAvailable()
        assert [(r["left_no"], r["right_no"]) for r in spark.read.parquet(out).collect()] == [(1, 11)]
        arrive([(4, False, 13, 60.0, "")])
        q.processAllAvailable()
        state = q.lastProgress["stateOperators"][0]["numRowsTotal"]
        assert state <= 2  # keys of the first buckets are gone
    finally:
        q.stop()
