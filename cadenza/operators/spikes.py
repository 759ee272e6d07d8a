"""Implausible readings: impossible values, stuck values, and spikes by peaks over a threshold."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .chunks import with_chunks


def _with_level(df: DataFrame, near: list[str], out: str) -> DataFrame:
    """Adds `out`, the level that readings on one side, nearest first, let expect, and `out`_flat, their median; null without readings.

    The level is the median, led half the way on towards the reading along the side's slope. At a turning point of smooth movement a flat
    median falls short on both sides and a full line goes as far beyond it; half the way meets it. The slope is the value nearest to 0 in the range of the middle three among the differences over
    one and two readings, so that a spike's other readings, up to two of the side, don't tilt it."""
    c = [F.col(x) for x in near]
    steps = [c[k] - c[k + 1] for k in range(len(c) - 1)] + [(c[k] - c[k + 2]) / 2 for k in range(len(c) - 2)]
    count = lambda cols: sum((x.isNotNull().cast("int") for x in cols), F.lit(0))
    # nulls come first in a sorted array
    df = df.withColumn("__v", F.sort_array(F.array(*c))).withColumn("__d", F.sort_array(F.array(*steps))).withColumn("__n", count(c)).withColumn("__m", count(steps))
    n, m = F.col("__n"), F.col("__m")
    half = lambda x: F.floor(x / 2).cast("int")
    median = (F.get("__v", len(c) - n + half(n - 1)) + F.get("__v", len(c) - n + half(n))) / 2
    more = (m > 2).cast("int")
    low, high = F.get("__d", len(steps) - m + half(m - 1) - more), F.get("__d", len(steps) - m + half(m) + more)
    slope = F.when(m > 0, F.greatest(low, F.least(high, F.lit(0.0)))).otherwise(0.0)
    df = df.withColumn(f"{out}_flat", F.when(n > 0, median)).withColumn(out, F.col(f"{out}_flat") + slope * (n + 1) / 4)
    return df.drop("__v", "__d", "__n", "__m")


def _bends(theta: float, z: Column) -> Column:
    return F.log1p(theta * z) if theta else z


def pareto_cutoff(peaks: DataFrame, source: list[str], risk: float, *, over: float = 0.2, held: float = 0.1, prior: float = 0.1, levels: int = 40) -> DataFrame:
    """(source, cut): the height that a source's leaps exceed with probability `risk`, by a generalized Pareto law over a threshold.

    `peaks` has source, leap > 0, n (readings of the source, with or without a leap) and noise (least scale). The threshold is the leap that the share `over` of
    the source's readings exceeds, 0 if fewer leap at all. The law is fitted to the exceedances by maximum likelihood; the highest, a share
    `held` of the readings, count as 'at least that', so that spikes themselves, however high, can't bend it. Scale follows from the shape in
    closed form, and the shape is the best of a grid, under a normal prior of deviation `prior` around 0 (exponential tail), which some
    dozens of exceedances can't overrule and hundreds do. Quantiles (in `levels` steps) and sums are partial aggregates. Sources whose leaps are
    all equal get the noise as scale."""
    q = peaks.groupBy(*source).agg(F.percentile_approx("leap", [k / levels for k in range(levels)], 2000).alias("q"), F.count(F.lit(1)).alias("k"), F.max("n").alias("n"), F.max("noise").alias("noise"))
    step = lambda share: F.floor((1 - share * F.col("n") / F.col("k")) * levels).cast("int")
    level = lambda share: F.coalesce(F.get("q", step(share)), F.lit(0.0))
    q = q.select(*source, level(over).alias("u"), (level(held) - level(over)).alias("w"), "n", "noise")
    z = F.try_divide(F.col("leap") - F.col("u"), F.nullif("w", F.lit(0.0)))
    e = peaks.select(*source, "leap").join(q, source).filter("leap > u").withColumn("z", F.least(z, F.lit(1.0)))
    thetas = [0.0, -0.5, -0.25, 0.25, 0.5, 1.0, 2.0]
    g = e.groupBy(*source).agg(
        *[F.max(c).alias(c) for c in ("u", "w", "n", "noise")], F.count(F.when(F.col("z") < 1, 1)).alias("free"), F.count(F.lit(1)).alias("over"), *[F.sum(F.when(F.col("z") < 1, _bends(t, F.col("z")))).alias(f"b{j}") for j, t in enumerate(thetas)]
    )
    free, most = F.col("free"), F.col("over") - F.col("free")

    def fitted(x: Column) -> Column:
        """Gain, shape and scale of one point of the grid: theta = 0 is the exponential law."""
        t, sure = x["theta"], x["b"]
        total = sure + most * F.when(t == 0, 1.0).otherwise(F.log1p(t))
        mean = F.try_divide(total, free)  # the exponential's scale, or the shape
        scale = F.when(t == 0, mean).otherwise(F.try_divide(mean, t))
        gain = -free * F.log(scale) - F.when(t == 0, free).otherwise(sure + F.try_divide(total, mean) + F.pow(mean / prior, 2) / 2)
        return F.struct(gain.alias("gain"), F.when(t == 0, 0.0).otherwise(mean).alias("shape"), scale.alias("scale"))

    grid = F.array(*[F.struct(F.lit(t).alias("theta"), F.col(f"b{j}").alias("b")) for j, t in enumerate(thetas)])
    g = g.withColumn("best", F.array_max(F.transform(grid, fitted)))
    shape = F.coalesce("best.shape", F.lit(0.0))
    scale = F.greatest(F.coalesce(F.col("best.scale") * F.col("w"), F.lit(0.0)), F.col("noise"))
    growth = F.log(F.greatest(F.lit(1.0), F.col("over") / F.col("n") / risk))
    tail = F.when(F.abs(shape) < 1e-9, growth).otherwise((F.exp(shape * growth) - 1) / shape)
    return g.select(*source, (F.col("u") + scale * tail).alias("cut"))


# The seasons tried, in cycles per reading; periods of 12 to 125 readings.
FREQUENCIES = tuple(0.008 + 0.0032 * k for k in range(24))


def _season(sound: DataFrame, source: list[str], frequencies: tuple[float, ...], share: float, block: int = 4) -> DataFrame:
    """(source, freq, re, im): the sine over the index, of the frequencies given, that explains most of a source's variance, and at least `share` of it; other
    sources don't come out.

    Sums over blocks of `block` readings are taken first, so that the sines are evaluated once a block; a
    block's mean flattens a sine by a known factor, which is taken out again."""
    b = F.floor(F.coalesce(F.col("i"), F.lit(0)) / block)
    e = sound.groupBy(*source, "c", b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    e = e.withColumn("freq", F.explode(F.array(*[F.lit(f) for f in frequencies])))
    turn = 2 * math.pi * F.col("freq") * (F.col("b") * block + (block - 1) / 2)
    e = e.withColumn("cos", F.cos(turn)).withColumn("sin", F.sin(turn))
    n, s = F.col("n"), F.col("s")
    g = e.groupBy(*source, "freq").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(s * F.col("cos")).alias("vc"), F.sum(s * F.col("sin")).alias("vs"), F.sum(n * F.col("cos")).alias("oc"), F.sum(n * F.col("sin")).alias("os"),
    )
    mean = s / n
    flat = F.sin(math.pi * block * F.col("freq")) / (block * F.sin(math.pi * F.col("freq")))
    g = g.select(*source, "n", "freq", (F.col("ss") / n - mean * mean).alias("var"), (2 / n / flat * (F.col("vc") - mean * F.col("oc"))).alias("re"), (2 / n / flat * (F.col("vs") - mean * F.col("os"))).alias("im"))
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / 2
    g = g.filter((n >= 24) & (F.col("var") > 0) & (power >= share * F.col("var")) & (power <= 1.2 * F.col("var")))
    g = g.groupBy(*source).agg(F.max(F.struct(power.alias("power"), F.col("freq"), F.col("re"), F.col("im"))).alias("best"))
    return g.select(*source, "best.freq", "best.re", "best.im")


def _chunk_facts(sound: DataFrame, source: list[str], near: int, frequencies: tuple[float, ...], share: float) -> DataFrame:
    """One row per (source, c): prev and next (up to `near` sound readings before and after the chunk, nearest first), rows of the chunk, n of the source,
    noise (the median of its second differences), and freq, re, im of its season or nulls.

    All of it is aggregated map-side by chunk first; only these rows are then ordered by source."""
    key = [*source, "c"]
    w = Window.partitionBy(*key).orderBy(F.col("i").asc_nulls_first())
    at = F.struct("i", "v")
    d = sound.withColumn("head", F.when(F.lag("v", near).over(w).isNull(), at)).withColumn("tail", F.when(F.lead("v", near).over(w).isNull(), at))
    c = d.groupBy(*key).agg(F.array_sort(F.collect_list("head")).alias("head"), F.array_sort(F.collect_list("tail")).alias("tail"), F.count(F.lit(1)).alias("rows"), F.percentile_approx("step", 0.5, 500).alias("step"))
    every, o = Window.partitionBy(*source), Window.partitionBy(*source).orderBy(F.col("c").asc_nulls_first())
    c = c.withColumn("n", F.sum("rows").over(every)).withColumn("noise", F.sum(F.col("step") * F.col("rows")).over(every) / F.col("n"))
    c = c.withColumn("prev", F.flatten(F.collect_list("tail").over(o.rowsBetween(-near, -1)))).withColumn("next", F.flatten(F.collect_list("head").over(o.rowsBetween(1, near))))
    c = c.select(*key, "rows", "n", "noise", F.slice(F.reverse("prev"), 1, near).alias("prev"), F.slice("next", 1, near).alias("next"))
    return c.join(_season(sound, source, frequencies, share), source, "left")


def _residual(i: Column, v: Column) -> Column:
    turn = (2 * math.pi) * F.col("freq") * F.coalesce(i, F.lit(0)).cast("double")
    return F.when(F.col("freq") > 0, v - F.col("re") * F.cos(turn) - F.col("im") * F.sin(turn)).otherwise(v)


def faulty_readings(
    df: DataFrame,
    *,
    source: list[str],
    idx: str,
    value: str,
    impossible: Column,
    stuck: int = 12,
    near: int = 5,
    risk: float = 1e-6,
    edge: float = 0.6,
    seasons: tuple[float, ...] = FREQUENCIES,
    share: float = 0.5,
    chunk: int = 8192,
) -> DataFrame:
    """The faulty readings: source columns, idx, value, kind ('impossible', 'stuck' or 'spike', in this order of precedence), score.

    impossible: the given condition on the value. stuck: runs of `stuck` or more consecutive readings with the same
    value; a null or NaN ends a run. spike: a reading's seasonal residual leaps away from the levels of the `near` sound readings before and after it, which follow movement
    (`_with_level`), to the same side, by more than the cutoff that extreme-value fitting of the source's leaps sets at `risk` (`pareto_cutoff`), and the levels
    or the medians before and after differ by less than the leap, the medians by less than four times the leap (it comes back). Readings within two of a spike that leap over the share `edge`
    of the cutoff belong to it. The season is a sine over the index, of the frequency among `seasons` (cycles per reading) that explains most of the source's sound
    readings; it is taken off where that is `share` of their variance at least.

    A source is cut into chunks of the index with a halo for stuck runs; the sound readings at a chunk's ends are handed to its neighbours, however many faulty or
    null ones lie between, so that results don't change at the borders. Sums and quantiles are aggregated map-side, so a source
    with a third of all rows is spread over many tasks. Rows delivered twice count and come out once. Nulls and NaN are never
    faulty; a null index sorts first; readings of a null source have no spikes. Sources with fewer than two sound readings have no spikes. Empty input gives no rows. idx must count readings
    densely enough that `stuck` of them lie within 64."""
    halo = 64
    if halo < max(2 * near, stuck - 1):
        raise ValueError("the halo must hold the neighbours and a stuck run")
    d = df.select(*source, F.col(idx).alias("i"), F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("v"), F.coalesce(impossible, F.lit(False)).alias("bad"))
    d = with_chunks(d, "i", chunk, halo, "c")
    key = [*source, "c"]
    w = Window.partitionBy(*key).orderBy(F.col("i").asc_nulls_first())
    d = d.withColumn("again", F.coalesce(F.lag("i").over(w) == F.col("i"), F.lit(False))).filter("not again").drop("again")
    # place of a reading in its run of equal values; within the next stuck-1 readings only its own run can get as long as stuck
    d = d.withColumn("no", F.row_number().over(w)).withColumn("__v1", F.lag("v").over(w)).withColumn("step", F.abs(F.col("v") - 2 * F.col("__v1") + F.lag("v", 2).over(w)))
    d = d.withColumn("place", F.col("no") - F.last(F.when(~F.coalesce(F.col("v") == F.col("__v1"), F.lit(False)), F.col("no")), True).over(w) + 1)
    d = d.withColumn("stuck", (F.max("place").over(w.rowsBetween(0, stuck - 1)) >= stuck) & F.col("v").isNotNull())
    d = d.filter("v is not null and not __halo")
    fixed = d.filter("bad or stuck").select(*source, "i", "v", F.when(F.col("bad"), "impossible").otherwise("stuck").alias("kind"), F.lit(None).cast("double").alias("score"))

    s = d.filter("not bad and not stuck").select(*key, "i", "v", "step")
    facts = _chunk_facts(s, source, near, seasons, share)
    for side in ("prev", "next"):
        facts = facts.withColumn(side, F.transform(side, lambda r: _residual(r["i"], r["v"])))
    s = s.select(*key, "i", "v").join(facts, key).withColumn("y", _residual(F.col("i"), F.col("v")))
    before, after = [f"__p{k}" for k in range(1, near + 1)], [f"__f{k}" for k in range(1, near + 1)]
    s = s.withColumn("k", F.row_number().over(w)).withColumns({c: F.lag("y", k).over(w) for k, c in enumerate(before, 1)} | {c: F.lead("y", k).over(w) for k, c in enumerate(after, 1)})
    s = s.withColumns({c: F.coalesce(c, F.get("prev", F.lit(k) - F.col("k"))) for k, c in enumerate(before, 1)})
    s = s.withColumns({c: F.coalesce(c, F.get("next", F.col("k") + (k - 1) - F.col("rows").cast("int"))) for k, c in enumerate(after, 1)})
    s = _with_level(_with_level(s, before, "a"), after, "b")
    da, db = F.col("y") - F.col("a"), F.col("y") - F.col("b")
    s = s.withColumn("leap", F.least(F.abs(da), F.abs(db))).withColumn("shift", F.greatest(F.least(F.abs(F.col("a") - F.col("b")), F.abs(F.col("a_flat") - F.col("b_flat"))), F.abs(F.col("a_flat") - F.col("b_flat")) / 4))
    # 1.5 deviations of the noise, if second differences hold nothing else
    noise = F.coalesce(F.col("noise"), F.lit(0.0)) * 1.4826 / math.sqrt(6) * 1.5
    # inline() and not a filter, as the optimizer would repeat the levels' expressions in a filter wherever it names them
    row = F.struct("i", F.when(F.col("shift") < F.col("leap"), F.col("v")).alias("v"), "leap")
    peaks = s.select(*source, "n", noise.alias("noise"), F.inline(F.when((da * db > 0) & (F.col("leap") > 0), F.array(row))))
    # the leaps are needed several times; cut here, the windows above run once. Those that come back may be spikes, others only count for the law
    shared_dir(df.sparkSession)
    peaks = peaks.checkpoint()
    scored = peaks.filter("v is not null").join(pareto_cutoff(peaks, source, risk), source).select(*source, "i", "v", F.try_divide("leap", "cut").alias("score")).filter(F.col("score") > edge)
    if edge < 1:
        scored = scored.checkpoint()  # few rows
        around = scored.filter("score > 1").select(*source, F.explode(F.array(*[F.col("i") + k for k in (-2, -1, 1, 2)])).alias("i")).distinct()
        weak = scored.filter("score <= 1").join(around, [*source, "i"], "left_semi")
        scored = scored.filter("score > 1").unionByName(weak)
    spikes = scored.select(*source, "i", "v", F.lit("spike").alias("kind"), "score")
    return fixed.unionByName(spikes).select(*source, F.col("i").alias(idx), F.col("v").alias(value), "kind", "score")
