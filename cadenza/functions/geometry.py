"""Angles and normalisations of gaze positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: distance of the HREF plane, in HREF units.
HREF_DISTANCE = 15000.0


def resolution(x: Column, y: Column) -> tuple[Column, Column]:
    """HREF units per degree across and down at a position."""
    f2 = F.lit(HREF_DISTANCE * HREF_DISTANCE)
    num = F.radians(f2 + x * x + y * y)
    return num / F.sqrt(f2 + y * y), num / F.sqrt(f2 + x * x)


def rotation_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees by which the eye turns between two HREF positions; not clamped, so rounding may give NaN for equal positions."""
    f2 = F.lit(HREF_DISTANCE * HREF_DISTANCE)
    return F.degrees(F.acos((f2 + x1 * x2 + y1 * y2) / F.sqrt((f2 + x1 * x1 + y1 * y1) * (f2 + x2 * x2 + y2 * y2))))


def px_to_screen(x: Column, y: Column, width: int, height: int) -> tuple[Column, Column]:
    half = max(width, height) / 2
    return (x - width / 2) / half, (y - height / 2) / half


def dva_to_screen(a: Column, distance_mm: Column, width: int, height: int, px_per_inch: float) -> Column:
    """Degrees of visual angle as a share of the larger half of the screen."""
    return a / F.degrees(F.atan2(F.lit(max(width, height) / 2 * 25.4 / px_per_inch), distance_mm))


def max_abs(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Adds nx, ny: both columns over the largest absolute value of either, at least 1. A null in either makes the recording's result null, as the maximum doesn't skip it."""
    top = df.groupBy(*keys).agg(F.greatest(F.max(F.abs(x)), F.max(F.abs(y)), F.lit(1.0)).alias("__top"), F.max(F.col(x).isNull() | F.col(y).isNull()).alias("__gap"))
    top = top.select(*keys, F.when(~F.col("__gap"), F.col("__top")).alias("__top"))
    d = df.alias("a").join(top.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return d.select("a.*", (F.col(f"a.{x}") / F.col("b.__top")).alias("nx"), (F.col(f"a.{y}") / F.col("b.__top")).alias("ny"))
