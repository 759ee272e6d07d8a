"""Marker streams: boundaries, positions, trials; decoders of device series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import MARKER_POSITION, part
from .masks import ordered

# Marker prefixes of the boundary kinds.
PREFIXES = {
    "task": (["Task_start"], ["Task_end"]),
    "instruction": (["Intructions_start"], ["Intructions_end"]),
    "practice": (["PracticeTrial_start"], ["PracticeTrial_end"]),
    "test": (["Trial_start"], ["Trial_end"]),
    "trial": (["PracticeTrial_start", "Trial_start"], ["PracticeTrial_end", "Trial_end"]),
}


def boundaries(markers: DataFrame, keys: list[str], order: str, text: str, time: str, starts: list[str], ends: list[str]) -> DataFrame:
    """(keys, k, start, end): starts and ends numbered by prefix, then by order, and paired by number; an unpaired one has null for its partner."""

    def side(prefixes: list[str], name: str) -> DataFrame:
        low = F.lower(text)
        which = F.lit(None).cast("int")
        for j, p in reversed(list(enumerate(prefixes))):
            which = F.when(low.startswith(p.lower()), j).otherwise(which)
        d = markers.withColumn("__p", which).filter("__p is not null")
        return d.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("__p", order)).alias("k"), F.col(time).alias(name))

    return side(starts, "start").join(side(ends, "end"), [*keys, "k"], "full")


def boundary_status(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pairs, status): 'ok', 'unequal' (counts differ) or 'order' (an end before its start). Recordings without any boundary don't come out."""
    g = pairs.groupBy(*keys).agg(F.count("start").alias("s"), F.count("end").alias("e"), F.max(F.col("end") < F.col("start")).alias("bad"))
    return g.select(*keys, F.greatest("s", "e").alias("pairs"), F.when(F.col("s") != F.col("e"), "unequal").when(F.col("bad"), "order").otherwise("ok").alias("status"))


def marker_positions(markers: DataFrame, text: str) -> DataFrame:
    """Markers that give a target's position: adds target (0 without a suffix), x, y, time_stm. Others fall out."""
    c = F.col(text)
    suffix = F.regexp_extract(c, MARKER_POSITION, 1)
    d = markers.filter(c.rlike(MARKER_POSITION))
    return d.withColumn("target", F.coalesce(F.regexp_replace(suffix, "_", "").try_cast("int"), F.lit(0))).withColumn("x", part(c, MARKER_POSITION, 2).cast("int")).withColumn("y", part(c, MARKER_POSITION, 3).cast("int")).withColumn("time_stm", part(c, MARKER_POSITION, 4).try_cast("double"))


def in_trials(markers: DataFrame, keys: list[str], order: str, starts: Column, ends: Column) -> DataFrame:
    """The markers from a start to the first end after it, both included, with trial (numbered from 1 by start), __s and __e (whether it is the start or the end)."""
    d = markers.withColumn("__s", F.coalesce(starts, F.lit(False))).withColumn("__e", F.coalesce(ends & ~starts, F.lit(False)))
    d = d.withColumn("trial", F.sum(F.col("__s").cast("int")).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0))).filter("trial > 0")
    past = F.coalesce(F.sum(F.col("__e").cast("int")).over(Window.partitionBy(*keys, "trial").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("__past", past).filter("__past = 0").drop("__past")


def circle_paths(markers: DataFrame, keys: list[str], order: str, text: str, time: str, starts: Column, ends: Column) -> DataFrame:
    """(keys, trial, target, order, time, x, y, time_stm): the path of every target of every trial, from the markers that give a position. Trials without an end count too."""
    d = marker_positions(in_trials(markers, keys, order, starts, ends), text)
    return d.select(*keys, "trial", "target", order, time, "x", "y", "time_stm")


def trials(markers: DataFrame, keys: list[str], order: str, text: str, time: str, starts: Column, ends: Column, click: Column, targets: Column, position: Column | None = None) -> DataFrame:
    """One row per trial: (keys, trial, practice, start_time, animation_end, end_time, n_targets, clicks, circles).

    A trial goes from a start marker to the first end after it; markers outside trials and trials without an end fall out.
    n_targets is the last given; circles counts position markers and animation_end is the last of them, or the start."""
    d = in_trials(markers, keys, order, starts, ends)
    pos = F.lit(False) if position is None else F.coalesce(position, F.lit(False))
    t = F.col(time)
    g = d.groupBy(*keys, "trial").agg(
        F.max(F.when(F.col("__s"), F.lower(text).contains("practice"))).alias("practice"), F.min(F.when(F.col("__s"), t)).alias("start_time"), F.max(F.when(pos | F.col("__s"), t)).alias("animation_end"),
        F.min(F.when(F.col("__e"), t)).alias("end_time"), F.max_by(targets, F.when(targets.isNotNull(), F.col(order))).alias("n_targets"),
        F.sort_array(F.collect_list(F.when(F.coalesce(click, F.lit(False)), t))).alias("click_times"), F.count(F.when(pos, 1)).alias("circles"),
    )
    return g.filter("end_time is not null")


def first_last_once(df: DataFrame, keys: list[str], order: str, frame: str) -> DataFrame:
    """Without the first row if the second has its frame number, and without the last if the one before has."""
    w = ordered(keys, order)
    d = df.withColumn("__p", F.lag(frame).over(w)).withColumn("__n", F.lead(frame).over(w)).withColumn("__first", F.lag(F.lit(1)).over(w).isNull()).withColumn("__last", F.lead(F.lit(1)).over(w).isNull())
    drop = (F.col("__first") & (F.col("__n") == F.col(frame))) | (F.col("__last") & (F.col("__p") == F.col(frame)))
    return d.filter(~F.coalesce(drop, F.lit(False))).drop("__p", "__n", "__first", "__last")


def mouse_state(code: Column) -> Column:
    """Release, Move or Click for -1, 0 or 1; null else."""
    return F.when(code == -1, "Release").when(code == 0, "Move").when(code == 1, "Click")
