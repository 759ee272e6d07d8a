"""Gaze events: saccades, fixations and blinks from positions and velocities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ship import by_value
from ..session import shared_dir
from .chunks import with_chunks
from .masks import mark_runs, ordered, paint, runs, with_position
from .series import linspace, smooth
from .stats import MAD_SCALE, detection_radius


def detect_saccades(df: DataFrame, keys: list[str], order: str, time: str, vx: str, vy: str, factor: float = 5.0, min_duration: float = 0.016, fixed_radius: tuple[float, float] | None = None) -> DataFrame:
    """Adds i, n, run and saccade: the velocity lies outside an ellipse of detection radii for at least min_duration. The sample after a saccade is painted too. Null velocities are inside."""
    if fixed_radius:
        d = df.withColumn("rx", F.lit(fixed_radius[0])).withColumn("ry", F.lit(fixed_radius[1]))
    else:
        rx = detection_radius(df, keys, vx, factor).withColumnRenamed("radius", "rx")
        ry = detection_radius(df, keys, vy, factor).withColumnRenamed("radius", "ry")
        d = df.join(rx, keys).join(ry, keys)
    out = F.pow(F.col(vx) / F.col("rx"), 2) + F.pow(F.col(vy) / F.col("ry"), 2) > 1
    d = d.withColumn("outside", F.coalesce(out, F.lit(False))).drop("rx", "ry")
    m = mark_runs(d, keys, order, "outside")
    long = runs(m, keys, "outside", time).filter(F.col("on") & (F.col("t_last") - F.col("t_first") >= min_duration))
    return paint(m, keys, long, "saccade").drop("outside")


def filter_small(df: DataFrame, keys: list[str], order: str, time: str, mask: str, min_duration: float = 0.006) -> DataFrame:
    """Clears runs of `mask` that last min_duration or less, the sample after them included."""
    m = mark_runs(df.drop("i", "n", "run"), keys, order, mask)
    short = runs(m, keys, mask, time).filter(F.col("on") & (F.col("t_last") - F.col("t_first") <= min_duration))
    return paint(m, keys, short, "__short").withColumn(mask, F.coalesce(F.col(mask), F.lit(False)) & ~F.col("__short")).drop("__short")


def detect_blinks(df: DataFrame, keys: list[str], order: str, time: str, x: str, y: str, fixation: str, factor: float = 4.0) -> DataFrame:
    """Adds blink: fixations whose dispersion on both axes lies `factor` median deviations of all fixations below their median (in log10). A null position in a fixation, its end
    included, makes the recording's threshold null, so that it has no blinks. The runs and their dispersions are checkpointed, as both are used several times."""
    shared_dir(df.sparkSession)
    m = mark_runs(df.drop("i", "n", "run"), keys, order, fixation).checkpoint()
    r = runs(m, keys, fixation, time).filter("on").select(*keys, "run", "first", "last")
    # a fixation's dispersion includes the sample after it: samples go to their run, and a run's first sample to the run before too
    w = ordered(keys, "i")
    own = m.select(*keys, "run", x, y)
    nxt = m.withColumn("prev_run", F.lag("run").over(w)).filter("prev_run <> run").select(*keys, F.col("prev_run").alias("run"), x, y)
    s = own.unionByName(nxt).join(r, [*keys, "run"], "left_semi")
    mid = s.groupBy(*keys, "run").agg(F.percentile(x, 0.5).alias("mx"), F.percentile(y, 0.5).alias("my"))
    dev = s.join(mid, [*keys, "run"]).groupBy(*keys, "run").agg(
        F.when(F.count(x) == F.count(F.lit(1)), F.percentile(F.abs(F.col(x) - F.col("mx")), 0.5)).alias("dx"), F.when(F.count(y) == F.count(F.lit(1)), F.percentile(F.abs(F.col(y) - F.col("my")), 0.5)).alias("dy"),
    )
    log = lambda c: F.log10(F.col(c) * MAD_SCALE + 1e-7)
    dev = dev.select(*keys, "run", log("dx").alias("lx"), log("dy").alias("ly")).checkpoint()
    med = dev.groupBy(*keys).agg(F.percentile("lx", 0.5).alias("cx"), F.percentile("ly", 0.5).alias("cy"), F.count("lx").alias("kx"), F.count("ly").alias("ky"), F.count(F.lit(1)).alias("k"))
    dm = dev.join(med, keys).groupBy(*keys, "cx", "cy", "kx", "ky", "k").agg(F.percentile(F.abs(F.col("lx") - F.col("cx")), 0.5).alias("sx"), F.percentile(F.abs(F.col("ly") - F.col("cy")), 0.5).alias("sy"))
    limit = dm.select(*keys, F.when(F.col("kx") == F.col("k"), F.col("cx") - factor * MAD_SCALE * F.col("sx")).alias("tx"), F.when(F.col("ky") == F.col("k"), F.col("cy") - factor * MAD_SCALE * F.col("sy")).alias("ty"))
    hit = dev.join(limit, keys).filter("lx < tx and ly < ty").select(*keys, "run")
    return paint(m, keys, hit, "blink")


def detect_gaze_events(df: DataFrame, keys: list[str], order: str, time: str, x: str, y: str, vx: str, vy: str, *, factor: float = 5.0, min_duration: float = 0.016, window: int = 5, blink_factor: float = 4.0) -> DataFrame:
    """Input columns and saccade, fixation, blink: smoothed velocities, adaptive radii, then blinks among the fixations. The input stays as it is.

    Each stage joins aggregates of its input back to it, so stages are cut by checkpoints in the shared folder (here and in detect_blinks); else every
    later stage would run the earlier ones again for each of its branches."""
    shared_dir(df.sparkSession)
    d = smooth(df, keys, order, vx, window, "__vx").drop("i", "n")
    d = smooth(d, keys, order, vy, window, "__vy").drop("i", "n").checkpoint()
    d = detect_saccades(d, keys, order, time, "__vx", "__vy", factor, min_duration).withColumn("__fix", ~F.col("saccade"))
    d = detect_blinks(d, keys, order, time, x, y, "__fix", blink_factor)
    return d.withColumn("fixation", F.col("__fix") & ~F.col("blink")).select(*df.columns, "saccade", "fixation", "blink")


def resample_uniform(df: DataFrame, keys: list[str], order: str, time: str, value: str) -> DataFrame:
    """(keys, i, t, value): times evenly spaced from first to last. Fourier resampling of a series to as many samples as it has is the identity on its
    values, so they stay as they are, nulls included; only their times change."""
    d = with_position(df.select(*keys, order, time, value), keys, order)
    every = Window.partitionBy(*keys)
    t = linspace(F.col("i"), F.col("n"), F.min_by(time, "i").over(every), F.max_by(time, "i").over(every))
    return d.select(*keys, "i", t.alias("t"), F.col(value).cast("double").alias("value"))


def butterworth_sections(order: int, cutoff: float, rate: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a low-pass Butterworth filter by the bilinear transform with prewarping."""
    wc = 2 * rate * np.tan(np.pi * cutoff / rate)
    out = []
    for k in range(order // 2):
        q = 2 * np.sin(np.pi * (2 * k + 1) / (2 * order))
        c = 2 * rate
        a = np.array([c * c + q * wc * c + wc * wc, 2 * wc * wc - 2 * c * c, c * c - q * wc * c + wc * wc])
        out.append(np.concatenate([wc * wc * np.array([1, 2, 1]) / a[0], a / a[0]]))
    if order % 2:
        c = 2 * rate
        a = np.array([c + wc, wc - c, 0])
        out.append(np.concatenate([wc * np.array([1, 1, 0]) / a[0], a / a[0]]))
    return np.array(out)


def _sections(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The cascade, started in the steady state of the first value."""
    for b0, b1, b2, _, a1, a2 in sos:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        z1, z2 = x[0] * (gain - b0), x[0] * (b2 - a2 * gain)
        y = np.empty_like(x)
        for i, v in enumerate(x):
            o = b0 * v + z1
            z1, z2 = b1 * v - a1 * o + z2, b2 * v - a2 * o
            y[i] = o
        x = y
    return x


def zero_phase(x: np.ndarray, sos: np.ndarray) -> np.ndarray:
    """Forward and backward filtering with odd extension at the ends."""
    pad = min(3 * (2 * len(sos) + 1), len(x) - 1)
    if pad < 1:
        return x
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    y = _sections(sos, _sections(sos, ext)[::-1])[::-1]
    return y[pad:-pad]


def zero_phase_lowpass(df: DataFrame, keys: list[str], order: str, value: str, *, poles: int = 7, cutoff: float = 100.0, rate: float = 1000.0, chunk: int = 32768, halo: int = 2048) -> DataFrame:
    """(keys, order, value): zero-phase Butterworth low-pass of each series; nulls are dropped first.

    The filter is recursive, but its memory fades: series are filtered in chunks with a halo, over which what lies before
    decays beyond double precision for cutoffs of a hundredth of the rate and more, so that no series is ever one group."""
    sos = butterworth_sections(poles, cutoff, rate)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    cols = [*keys, order, value]

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("i")
        f = f.assign(**{value: zero_phase(f[value].to_numpy(float), sos)})
        return f.loc[~f["__halo"], cols]

    d = df.select(*keys, order, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias(value)).dropna(subset=[value])
    d = with_chunks(with_position(d, keys, order).drop("n"), "i", chunk, halo, "chunk")
    return d.groupBy(*keys, "chunk").applyInPandas(one, ", ".join(f"`{c}` {'double' if c == value else kinds[c]}" for c in cols))


by_value(__name__)
