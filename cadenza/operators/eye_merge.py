"""Eye-tracker recordings merged from samples, exported gaze and head-referenced positions, and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .joins import interval_labels, interval_number, last_per_key
from .masks import last_long_island, with_position
from .series import with_gradient

KINDS = {"saccade": "Saccade", "fixation": "Fixation", "blink": "Blink"}


def align_files(series: DataFrame, exports: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Pairs of recording and export files that agree in `keys`; of repeated pairs the last by `order`. Export columns get the prefix export_. Files without partner fall out."""
    e = exports.select(*keys, *[F.col(c).alias(f"export_{c}") for c in exports.columns if c not in keys])
    return last_per_key(series.join(e, keys), keys, order)


def merge_eye_data(samples: DataFrame, gaze: DataFrame, href: DataFrame, spans: DataFrame, keys: list[str], *, task: DataFrame | None = None, min_task_samples: int = 5000) -> DataFrame:
    """Samples with exported positions, velocities, event flags and, with `task` spans, only the last long stretch of the task.

    samples: keys, sample_idx, Time_EDF (ms), Time_LSL, Target_Distance (mm). gaze: keys, Time_EDF, {L,R}_X, {L,R}_Y, X_Res, Y_Res. href: keys, Time_EDF,
    {L,R}_X_HREF, {L,R}_Y_HREF. spans: keys, eye ('L', 'R'), kind, start, end (ms, half-open). task: keys, start, end.
    Both exports are left-joined on the tracker's time, so samples without partner keep nulls and repeated times fan out. Velocities are
    gradients over LSL time divided by the resolution (deg/s). Times come out in s, distances in m. A recording whose task has no
    stretch of min_task_samples falls out."""
    on = [*keys, "Time_EDF"]
    d = samples.join(gaze, on, "left").join(href, on, "left")
    raw = {f"{e}_V{a}": f"{e}_{a}" for e in "LR" for a in "XY"}
    d = with_gradient(d, keys, "sample_idx", "Time_LSL", raw).withColumns({v: F.col(v) / F.col(f"{v[-1]}_Res") for v in raw})
    shared_dir(d.sparkSession)
    d = interval_labels(d, spans.withColumn("__what", F.concat_ws("_", "eye", "kind")), keys, "Time_EDF", "start", "end", "__what", "__events", 60_000.0)
    d = d.withColumns({f"{eye}_{name}": F.array_contains("__events", f"{eye}_{kind}") for eye in "LR" for kind, name in KINDS.items()}).drop("__events")
    if task is not None:
        d = interval_number(d, task.withColumn("no", F.lit(1)), keys, "Time_EDF", "start", "end", "no", "__in", 600_000.0).withColumn("__in", F.col("__in") > 0).checkpoint()
        island = last_long_island(d, keys, "sample_idx", "__in", "Time_EDF", min_task_samples).select(*keys, "first", "last")
        d = with_position(d, keys, "sample_idx").join(island, keys).filter("i >= first and i < last").drop("i", "n", "first", "last", "__in")
    return d.withColumn("Time_EDF", F.col("Time_EDF") / 1000).withColumn("Target_Distance", F.col("Target_Distance") / 1000)


def drop_blinks(df: DataFrame, x: str, y: str, blink: str | None = None) -> DataFrame:
    """Rows that are no blink; without a mask those with a positive x or y."""
    return df.filter(~F.coalesce(F.col(blink), F.lit(False))) if blink else df.filter((F.col(x) > 0) | (F.col(y) > 0))
