"""Jobs over the file catalogue: slices, colour plans, split log, clinical downloads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import session_date
from ..operators.joins import nearest_date_join, prior_visit_join
from ..operators.series import rates


@dataclass(frozen=True)
class SliceOptions:
    """What a slice selects. Sessions or subjects narrow it; a list of sessions makes the dates irrelevant."""

    start_date: str | None = None
    end_date: str | None = None
    devices: tuple[str, ...] = ()
    tasks: tuple[str, ...] = ()
    hdf5_only: bool = False
    exclude: tuple[str, ...] = ()
    include_test_subjects: bool = False
    first_real_subject: int = 100100

    def __post_init__(self) -> None:
        if not self.devices:
            raise ValueError("name at least one device")
        if any(not x.startswith(".") for x in self.exclude):
            raise ValueError("excluded extensions start with a dot")


def slice_files(files: DataFrame, o: SliceOptions, test_subjects: DataFrame | None = None, sessions: DataFrame | None = None, subjects: DataFrame | None = None) -> DataFrame:
    """Rows of the catalogue (session_path, subject_id, device, task, extension, ...) that a slice asks for.

    `sessions` (session_path) and `subjects` (subject_id) are semi-joined, test subjects anti-joined. Files of unparsable sessions fall out when dates are given."""
    d = files.filter(F.col("device").isin(list(o.devices)))
    if o.tasks:
        d = d.filter(F.col("task").isin(list(o.tasks)))
    d = d.filter(F.col("extension") == ".hdf5") if o.hdf5_only else d.filter(~F.col("extension").isin(".bag", ".avi", ".xdf", *o.exclude))
    if sessions is not None:
        d = d.join(sessions, "session_path", "left_semi")
    else:
        day = session_date(F.regexp_extract("session_path", r"([^/]+)/?$", 1))
        if o.start_date:
            d = d.filter(day >= F.lit(o.start_date).cast("date"))
        if o.end_date:
            d = d.filter(day <= F.lit(o.end_date).cast("date"))
    if subjects is not None:
        d = d.join(subjects, "subject_id", "left_semi")
    if not o.include_test_subjects:
        d = d.filter(F.col("subject_id").try_cast("int") >= o.first_real_subject)
        if test_subjects is not None:
            d = d.join(test_subjects, "subject_id", "left_anti")
    return d


def manifest(files: DataFrame, dest: str) -> DataFrame:
    """(src, dest) of the files to copy; copying itself is left to the storage's own tools."""
    base = F.regexp_extract("session_path", r"([^/]+)/?$", 1)
    return files.select(F.concat_ws("/", "session_path", "file_name").alias("src"), F.concat(F.lit(f"{dest}/" if dest else ""), base, F.lit("/"), F.col("file_name")).alias("dest"))


def session_dirs(files: DataFrame, dest: str) -> DataFrame:
    return files.select(F.concat(F.lit(f"{dest}/"), F.regexp_extract("session_path", r"([^/]+)/?$", 1)).alias("dir")).distinct()


def colour_plan(files: DataFrame) -> DataFrame:
    """One row per recording file with the video it needs: a bag first, else another video, else status 'no video'."""
    key = ["subject_id", "file_datetime", "task", "device", "device_info"]
    h = files.filter(F.col("extension") == ".hdf5")
    rank = F.when(F.col("extension") == ".bag", 0).when(F.col("extension").isin(".avi", ".mov", ".mp4"), 1)
    v = files.withColumn("rank", rank).filter("rank is not null").groupBy(*key).agg(F.min_by(F.concat_ws("/", "session_path", "file_name"), F.struct("rank", "file_name")).alias("video"))
    return h.join(v, key, "left").withColumn("status", F.when(F.col("video").isNull(), "no video").otherwise("ready"))


def associated_files(files: DataFrame, others: DataFrame, *, extensions: tuple[str, ...] | None = None, use_device_info: bool = False) -> DataFrame:
    """(session_path, file_name, associated): for each file the files of `others` of the same session, subject, time, task and device (and device_info, if used), itself included if it
    is among them, in order of their names. Equality on all of these keeps a group to the files of one recording. Null parts match nothing."""
    key = ["session_path", "subject_id", "file_datetime", "task", "device"] + (["device_info"] if use_device_info else [])
    o = others.filter(F.col("extension").isin(list(extensions))) if extensions is not None else others
    o = o.groupBy(*key).agg(F.array_sort(F.collect_set("file_name")).alias("associated"))
    return files.join(o, key, "left").select("session_path", "file_name", F.coalesce("associated", F.array().cast("array<string>")).alias("associated"))


def pending(paths: DataFrame, ledger: DataFrame, path: str = "path") -> DataFrame:
    """Files that the ledger doesn't list yet."""
    return paths.join(ledger.select(path).distinct(), path, "left_anti")


def split_log(df: DataFrame, keys: list[str], order: str, time: str, sensors: Column, clock_offset: float) -> DataFrame:
    """(keys, sensor, rate, start_at, end_at): one row per recording and sensor; recordings with fewer than two samples fall out. The offset between the clocks (s) is given,
    so that a run can be repeated."""
    at = lambda c: F.date_format(F.timestamp_micros(((F.col(c) + clock_offset) * 1e6).cast("long")), "yyyy-MM-dd HH:mm:ss")
    r = rates(df, keys, order, time).filter("n >= 2")
    return r.select(*keys, F.explode(sensors).alias("sensor"), F.col("median_rate").alias("rate"), at("t_first").alias("start_at"), at("t_last").alias("end_at"))


def clinical(sessions: DataFrame, tables: dict[str, tuple[DataFrame, str]], on: list[str], session_date_col: str, visits: DataFrame | None = None, event: str = "redcap_event_name") -> dict[str, DataFrame]:
    """Each clinical table (frame, its date column) joined to the sessions by nearest date; `visits` by nearest prior visit. All stay lazy."""
    out = {name: nearest_date_join(sessions, t, on, session_date_col, date, f"{name}_offset", f"{name}_") for name, (t, date) in tables.items()}
    if visits is not None:
        out["visits"] = prior_visit_join(sessions, visits, on, event, "visit_offset")
    return out


def flagged_subjects(subjects: DataFrame, flags: DataFrame, on: str, flag: str) -> DataFrame:
    """Distinct subjects that are flagged or that `flags` doesn't know, in order."""
    return subjects.join(flags.select(on, F.col(flag).alias("__f"), F.lit(1).alias("__there")), on, "left").filter("__f or __there is null").select(on).distinct().orderBy(on)


def device_ids(recordings: DataFrame, log: DataFrame, task_map: dict[str, list[str]], since: str = "2024-05-10") -> DataFrame:
    """Adds device_ids: for recordings after `since` those in the log (task_id, date, device_ids), before it those of the task map; null where neither knows.

    The map is a fixed configuration of a few dozen tasks."""
    pairs = [x for k, v in sorted(task_map.items()) for x in (F.lit(k), F.array(*[F.lit(d) for d in v]))]
    known = F.try_element_at(F.create_map(*pairs), F.col("task_id")) if pairs else F.lit(None).cast("array<string>")
    j = recordings.join(log.select("task_id", "date", F.col("device_ids").alias("logged")), ["task_id", "date"], "left")
    return j.withColumn("device_ids", F.when(F.col("date") > F.lit(since).cast("date"), F.col("logged")).otherwise(known)).drop("logged")


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds batch: consecutive numbers for `size` rows each, in order. For ledgers and job lists of bounded length, as it numbers all rows in one window."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(order)) - 1) / size).cast("long"))


def trial_gaze(trials: DataFrame, series: DataFrame, keys: list[str], time: str, start: str, end: str, width: float = 60.0) -> DataFrame:
    """Samples with the trial they fall into, both ends included. Trials are listed in each time bucket of `width` seconds that they touch, and the join is on (recording, bucket)."""
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    t = trials.select(*keys, "trial", F.col(start).alias("__a"), F.col(end).alias("__z")).filter("__a <= __z")
    t = t.withColumn("__b", F.explode(F.sequence(cell("__a"), cell("__z"))))
    return series.withColumn("__b", cell(time)).join(t, [*keys, "__b"]).filter((F.col(time) >= F.col("__a")) & (F.col(time) <= F.col("__z"))).drop("__a", "__z", "__b")


def last_positions(positions: DataFrame, keys: list[str], target: str, order: str) -> DataFrame:
    """The last position of every target of a trial."""
    rest = [c for c in positions.columns if c not in (*keys, target)]
    return positions.groupBy(*keys, target).agg(*[F.max_by(c, order).alias(c) if c != order else F.max(c).alias(c) for c in rest])
