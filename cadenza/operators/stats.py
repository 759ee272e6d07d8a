"""Robust statistics per recording and clock regression."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAD_SCALE = 1.4826


def detection_radius(df: DataFrame, keys: list[str], value: str, factor: float, floor: float = 1e-10, strict: bool = False) -> DataFrame:
    """(keys, radius): factor times the median-based deviation sqrt(median((v - median v)^2)). Below `floor` the deviation falls back to sqrt(mean v^2) - (mean v)^2,
    and if that is below it too the radius is null, or an error if strict. Nulls are skipped."""
    df = df.select(*keys, F.col(value).alias("__v"))
    m = df.groupBy(*keys).agg(F.percentile("__v", 0.5).alias("__m"))
    v = F.col("__v")
    d = df.join(m, keys).groupBy(*keys).agg(
        F.sqrt(F.percentile((v - F.col("__m")) * (v - F.col("__m")), 0.5)).alias("sd"), (F.sqrt(F.avg(v * v)) - F.avg(v) * F.avg(v)).alias("alt"),
    )
    bad = F.raise_error(F.lit("the deviation of a series is degenerate")).cast("double") if strict else F.lit(None).cast("double")
    sd = F.when(F.col("sd") >= floor, F.col("sd")).when(F.col("alt") >= floor, F.col("alt")).otherwise(bad)
    return d.select(*keys, (sd * factor).alias("radius"))


def mad(df: DataFrame, keys: list[str], value: str, out: str = "mad", scale: float = MAD_SCALE) -> DataFrame:
    """(keys, out): scaled median absolute deviation. A null value makes its group's result null, as the outer median doesn't skip it."""
    df = df.select(*keys, F.col(value).alias("__v"))
    m = df.groupBy(*keys).agg(F.percentile("__v", 0.5).alias("__m"))
    d = df.join(m, keys).groupBy(*keys).agg(F.percentile(F.abs(F.col("__v") - F.col("__m")), 0.5).alias("__d"), F.max(F.col("__v").isNull()).alias("__gap"))
    return d.select(*keys, F.when(~F.col("__gap"), F.col("__d") * scale).alias(out))


def t_quantile(p: float, df: Column) -> Column:
    """Quantile of Student's t with df degrees of freedom: exact for 1 and 2, else a series in 1/df about the normal quantile (error under 1e-3 from df = 5 on)."""
    # normal quantile by bisection on erf, once, on the driver
    lo, hi = -10.0, 10.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < p else (lo, mid)
    z = (lo + hi) / 2
    g1, g2 = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    series = z + g1 / df + g2 / (df * df) + g3 / (df * df * df) + g4 / (df * df * df * df)
    a = 2 * p - 1
    return F.when(df < 1, None).when(df == 1, math.tan(math.pi * (p - 0.5))).when(df == 2, a * math.sqrt(2 / (1 - a * a))).otherwise(series)


def clock_offset(df: DataFrame, keys: list[str], t1: str, t2: str, slope_eps: float = 1e-3, confidence: float = 0.95, intercept_eps: float = 5e-4) -> DataFrame:
    """(keys, n, slope, intercept, half_width, status) of the regression of t2 on t1. status: 'ok', 'slope' (too far from 1), 'intercept' (too uncertain) or
    'short' (fewer than three pairs). All sums are partial aggregates."""
    x, y = F.col(t1).cast("double"), F.col(t2).cast("double")
    g = df.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.regr_avgx(y, x).alias("mx"),
    )
    n = F.col("n").cast("double")
    left = F.greatest(F.lit(0.0), F.col("syy") - F.try_divide(F.col("sxy") * F.col("sxy"), "sxx"))
    se = F.sqrt(F.try_divide(left, (n - 2) * F.col("sxx"))) * F.sqrt(F.col("sxx") / n + F.col("mx") * F.col("mx"))
    g = g.withColumn("half_width", F.when(n > 2, t_quantile((1 + confidence) / 2, n - 2) * se))
    status = F.when(n < 3, "short").when(F.abs(F.col("slope") - 1) > slope_eps, "slope").when(F.col("half_width") > intercept_eps, "intercept").otherwise("ok")
    return g.select(*keys, "n", "slope", "intercept", "half_width", status.alias("status"))
