"""Records of two streams paired with the nearest in time: a stateful streaming join."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import by_value
from ..session import shared_dir

SIDES = "entity long, bucket long, is_left boolean, no long, t double"
PAIRS = "entity long, left_no long, right_no long, gap double"
_ROW = np.dtype([("entity", "i8"), ("bucket", "i8"), ("is_left", "i8"), ("no", "i8"), ("t", "f8")])


def nearest(rows: np.ndarray, tolerance: dict[int, float]) -> pd.DataFrame:
    """Nearest right row of each left row of the same (entity, bucket), if within the tolerance of the entity's stream
    (entity mod 4). Of rights equally far the one with the smaller number counts."""
    rows = rows[np.lexsort((rows["no"], rows["t"], rows["is_left"], rows["bucket"], rows["entity"]))]
    right = rows[rows["is_left"] == 0]
    same = np.zeros(len(right), bool)
    if len(right):
        same[1:] = (right["entity"][1:] == right["entity"][:-1]) & (right["bucket"][1:] == right["bucket"][:-1]) & (right["t"][1:] == right["t"][:-1])
        right = right[~same]  # of rights at one time the first number is kept
    left = rows[rows["is_left"] == 1]
    both = np.concatenate([right, left])
    order = np.lexsort((both["is_left"], both["t"], both["bucket"], both["entity"]))
    s = both[order]
    n = len(s)
    at = np.where(s["is_left"] == 0, np.arange(n), -1)
    before = np.maximum.accumulate(at) if n else at
    after = np.where(s["is_left"] == 0, np.arange(n), n)
    after = np.minimum.accumulate(after[::-1])[::-1] if n else after
    k = np.flatnonzero(s["is_left"] == 1)

    def gap(j: np.ndarray) -> np.ndarray:
        jj = np.clip(j, 0, max(n - 1, 0))
        fits = (j >= 0) & (j < n) & (s["entity"][jj] == s["entity"][k]) & (s["bucket"][jj] == s["bucket"][k])
        return np.where(fits, np.abs(s["t"][jj] - s["t"][k]), np.inf)

    if not len(k):
        return pd.DataFrame({"entity": [], "left_no": [], "right_no": [], "gap": []}).astype({"entity": "int64", "left_no": "int64", "right_no": "int64", "gap": "float64"})
    b, a = before[k], after[k]
    gb, ga = gap(b), gap(a)
    nb, na = s["no"][np.clip(b, 0, n - 1)], s["no"][np.clip(a, 0, n - 1)]
    use_b = (gb < ga) | ((gb == ga) & (nb <= na))
    g, no = np.where(use_b, gb, ga), np.where(use_b, nb, na)
    tol = np.array([tolerance[int(x)] for x in range(4)])[s["entity"][k] % 4]
    ok = g <= tol + 1e-9
    return pd.DataFrame({"entity": s["entity"][k][ok], "left_no": s["no"][k][ok], "right_no": no[ok], "gap": g[ok]})


def matcher(tolerance: dict[int, float], width: float, phases: int):
    """The state function of one key: buffers both sides, emits lefts whose tolerance horizon the watermark has passed, evicts rights that no left to come can reach."""
    reach = max(tolerance.values())

    def event(rows: np.ndarray) -> np.ndarray:
        return ((rows["bucket"] % phases) * width + rows["t"] - rows["bucket"] * width) + reach

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = np.frombuffer(state.get[0], dtype=_ROW) if state.exists else np.empty(0, _ROW)
        parts = [kept]
        if not state.hasTimedOut:
            for f in frames:
                r = np.empty(len(f), _ROW)
                for c in _ROW.names:
                    r[c] = f[c].to_numpy()
                parts.append(r)
        rows = np.concatenate(parts)
        now = state.getCurrentWatermarkMs() / 1000.0
        e = event(rows)
        left = rows["is_left"] == 1
        ripe = left & (e + reach < now)
        out = nearest(np.concatenate([rows[ripe], rows[~left]]), tolerance) if ripe.any() else None
        stay = np.where(left, ~ripe, e + 2 * reach >= now)
        rows, e, left = rows[stay], e[stay], left[stay]
        if len(rows):
            state.update((rows.tobytes(),))
            horizon = (e[left].min() + reach) if left.any() else e.max() + 2 * reach
            state.setTimeoutTimestamp(max(int(math.ceil(horizon * 1000)) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out is not None:
            yield out

    return step


def keyed(rows: DataFrame, tolerance: float, width: float, phases: int) -> DataFrame:
    """Adds bucket, phase and event time; rights near the border of a time bucket also go to the bucket beyond it.

    Event time runs
    over a clock of phases*width seconds on which all recordings are replayed side by side; an (entity, bucket) never wraps."""
    b = F.floor(F.col("t") / width).cast("long")
    near: list[Column] = [F.floor((F.col("t") - tolerance) / width).cast("long"), F.floor((F.col("t") + tolerance) / width).cast("long")]
    d = rows.withColumn("bucket", F.explode(F.when(F.col("is_left"), F.array(b)).otherwise(F.array_distinct(F.array(*near)))))
    phase = F.pmod(F.col("bucket"), F.lit(phases))
    d = d.withColumn("phase", phase)
    ev = phase * width + F.col("t") - F.col("bucket") * width + tolerance
    return d.withColumn("event", F.timestamp_micros((ev * 1e6).cast("long")))


def nearest_stream(stream: DataFrame, tolerance: dict[int, float], *, width: float, phases: int, delay: str, groups: int = 64) -> DataFrame:
    """Pairs from a streaming frame of keyed() rows, in append mode: each left row once, with the nearest right within its stream's tolerance.

    A state key holds the (entity, bucket) pairs of one of `groups` hash groups within one phase of the clock, so that an entity
    with a third of all rows is spread over its buckets.

    Left rows without a right in reach give no row. Lefts of equal number count as often as they are delivered. Rows later than `delay` behind the watermark are
    dropped by Spark, so delay must cover the disorder of the source."""
    return (
        stream.withColumn("grp", F.pmod(F.xxhash64("entity", "bucket"), F.lit(groups)).cast("int"))
        .withWatermark("event", delay)
        .groupBy("grp", "phase")
        .applyInPandasWithState(matcher(tolerance, width, phases), PAIRS, "buffer binary", "append", "EventTimeTimeout")
    )


# Where the stream keeps its state; RocksDB's caches of one executor share a bounded memory.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def replay_nearest(
    spark: SparkSession,
    rows: DataFrame,
    tolerance: dict[int, float],
    *,
    width: float = 30.0,
    expected: int | None = None,
    core_rows: int = 200_000,
    key_rows: int = 20_000,
    file_rows: int = 1_000_000,
    progress: list | None = None,
) -> DataFrame:
    """Runs recorded rows (entity, is_left, no, t) through the streaming join in the order of the replay clock and returns the pairs.

    entity holds the stream's code in its last two bits (entity mod 4), which picks the tolerance. The clock is cut into slices, as many
    as leave about `core_rows` rows a core in a slice (3 at least; `expected` tells the rows, else they are counted), so that the state, which holds
    rows of one slice and the horizon of the one before, doesn't grow with the input. The keyed rows are written once to the shared folder by slice, in
    files of about `file_rows`; each slice is moved into the stream's source folder when its turn comes, so that the watermark
    advances and state is emitted and evicted between slices. State lies in RocksDB, on disk beyond its cache. A state
    key holds about `key_rows`. A last row moves the watermark past every horizon. `progress` gets the state rows after each batch. The
    folders of the run are removed, but for the pairs returned. Nulls or NaN in t, entity or no: the row takes no part. Lefts delivered twice come
    once. No rows give no pairs."""
    reach = max(tolerance.values())
    good = rows.filter("entity is not null and no is not null and t is not null and not isnan(t)").select("entity", "is_left", "no", "t")
    expected = good.count() if expected is None else expected
    slices = max(3, -(-expected // (core_rows * spark.sparkContext.defaultParallelism)))
    phases = 2 * slices
    files = max(1, -(-expected // (slices * file_rows)))
    groups = max(16, expected // (phases * key_rows))
    k = keyed(good, reach, width, phases).withColumn("slice", F.floor(F.col("phase") / 2).cast("int"))
    end = spark.sql(f"select {slices} slice, 0L entity, 0L bucket, false is_left, 0L no, 0D t, 0L phase, timestamp_micros({int((phases * width * 3 + 60) * 1e6)}L) event")
    cols = ["entity", "bucket", "is_left", "no", "t", "phase", "event", "slice"]
    base = f"{shared_dir(spark).rstrip('/')}/nearest-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        part = F.pmod(F.xxhash64("entity", "bucket"), F.lit(max(8, files)))
        k.select(*cols).unionByName(end.select(*cols).withColumn("phase", F.col("phase").cast("long"))).repartition("slice", part).write.partitionBy("slice").parquet(f"{base}/staged")
        fs.mkdirs(path(f"{base}/arrived"))
        schema = "entity long, bucket long, is_left boolean, no long, t double, phase long, event timestamp"
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/arrived")
        pairs = nearest_stream(stream, tolerance, width=width, phases=phases, groups=groups, delay=f"{int(2 * width + 2 * reach + 1)} seconds")
        with _settings(spark, STATE):
            run = pairs.writeStream.format("parquet").option("path", f"{base}/pairs").option("checkpointLocation", f"{base}/progress").outputMode("append").start()
            try:
                for s in range(slices + 1):
                    here = path(f"{base}/staged/slice={s}")
                    if fs.exists(here):
                        fs.rename(here, path(f"{base}/arrived/slice{s}"))
                        run.processAllAvailable()
                        if progress is not None and run.lastProgress:
                            progress += [o["numRowsTotal"] for o in run.lastProgress["stateOperators"]]
                run.processAllAvailable()
            finally:
                run.stop()
    finally:
        for x in ("staged", "arrived", "progress"):
            fs.delete(path(f"{base}/{x}"), True)
    return spark.read.schema(PAIRS).parquet(f"{base}/pairs").dropDuplicates(["entity", "left_no"])


by_value(__name__)
