"""Registered queries of the numbered problems that belong to the core: 1, 2, 3 and 5."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.drift import alternatives, schema_changes, unified_records
from ..operators.grid import regular_grid
from ..operators.spikes import faulty_readings
from ..operators.units import clock_units, conversion_table, declared_unit, nearest_unit, plausible, to_common
from ..sources.tables import table

TIME_FIELDS = {"Time_EDF": "eyelink", "Time_FLIR": "flir", "Time_RealSense": "realsense"}


def p1_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every slot of every Mbient and Yeti file with its value, support and mark."""
    d = table(spark, sf, "device_data").filter(F.col("device").isin("Mbient", "Yeti"))
    m = table(spark, sf, "mbient").select("recording_id", "sample_idx", F.col("Time_Mbient").alias("t"), F.col("AccelX").alias("value"))
    y = table(spark, sf, "yeti").select("recording_id", "sample_idx", (F.col("Time_LSL") * 1000).alias("t"), F.col("Amplitude").alias("value"))
    names = {"start": "grid_start_ms", "end": "grid_end_ms", "step": "grid_step_ms"}
    a = regular_grid(m, d.filter("device = 'Mbient'"), valid=(-16.0, 16.0), **names)
    b = regular_grid(y, d.filter("device = 'Yeti'"), **names)
    return a.unionByName(b).withColumn("value", F.round("value", 4)).withColumn("support", F.round("support", 4))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The slots that the regression marks as filled or missing, with a check on its values: a filled slot must have one and a missing one none."""
    d = p1_grid(spark, sf).filter(F.col("mark").isin("filled", "missing"))
    sound = F.when(F.col("mark") == "filled", F.col("value").isNotNull() & ~F.isnan("value")).otherwise(F.col("value").isNull())
    d = d.filter(F.coalesce(sound, F.lit(False)) | F.raise_error(F.concat(F.lit("mark and value disagree at slot "), F.col("slot"))).cast("boolean"))
    return d.select("recording_id", F.col("slot").cast("long").alias("slot"))


P1_FOUND = """
with r as (
  select recording_id, Time_Mbient t from mbient where AccelX is not null and not isnan(AccelX)
  union all select recording_id, Time_LSL * 1000 from yeti where Amplitude is not null and not isnan(Amplitude)
), g as (
  select recording_id, grid_start_ms::double g0, grid_end_ms::double g1, grid_step_ms::double gs, unnest(range(0, ceil((grid_end_ms - grid_start_ms) / grid_step_ms)::bigint)) slot
  from device_data where device in ('Mbient', 'Yeti') and grid_step_ms > 0
), h as (
  select distinct g.recording_id, g.slot from g join r on r.recording_id = g.recording_id
    and r.t >= g0 + slot * gs and r.t < least(g0 + (slot + 1) * gs, g1)
)
select recording_id, slot from g where not exists (select 1 from h where h.recording_id = g.recording_id and h.slot = g.slot)
"""

P1_GRID = """
with r as (
  select distinct recording_id, sample_idx, Time_Mbient t, AccelX y, abs(AccelX) <= 16 ok from mbient where Time_Mbient is not null and AccelX is not null and not isnan(AccelX)
  union all select distinct recording_id, sample_idx, Time_LSL * 1000, Amplitude, true from yeti where Time_LSL is not null and Amplitude is not null and not isnan(Amplitude)
), g as (
  select recording_id, grid_start_ms::double g0, grid_end_ms::double g1, grid_step_ms::double gs, unnest(range(0, ceil((grid_end_ms - grid_start_ms) / grid_step_ms)::bigint)) slot
  from device_data where device in ('Mbient', 'Yeti') and grid_step_ms > 0
), w as (
  select g.recording_id, slot, any_value(g0 + (slot + 0.5) * gs) t, count(*) filter (r.t >= g0 + slot * gs and r.t < least(g0 + (slot + 1) * gs, g1)) readings,
    sum(w) s0, sum(w * d) s1, sum(w * d * d) s2, sum(w * y) t0, sum(w * d * y) t1, sum(w * w) ww, bool_or(w > 0 and d <= 0) below, bool_or(w > 0 and d >= 0) above
  from g left join lateral (
    select x.t, x.y, (x.t - g0) / gs - (slot + 0.5) as d, case when x.ok and abs((x.t - g0) / gs - (slot + 0.5)) < 2.5 then pow(1 - pow(abs((x.t - g0) / gs - (slot + 0.5)) / 2.5, 3), 3) else 0 end as w
    from r x where x.recording_id = g.recording_id and x.t between g0 + (slot - 2.5) * gs and g0 + (slot + 3.5) * gs) r on true
  group by g.recording_id, slot
), m as (select *, coalesce(s0 * s0 / nullif(ww, 0), 0) support, case when s0 * s2 - s1 * s1 > 0.01 * s0 * s0 then (t0 * s2 - t1 * s1) / (s0 * s2 - s1 * s1) when s0 > 0 then t0 / s0 end fit from w),
k as (select *, case when readings > 0 then 'observed' when support >= 1.5 and below and above then 'filled' else 'missing' end mark from m)
select recording_id, slot, t, round(case when mark <> 'missing' then fit end, 4) as value, round(support, 4) as support, readings, mark from k
"""


def clock_readings(spark: SparkSession, sf: str, field: str) -> DataFrame:
    """(recording_id, sample_idx, value, unit, Time_LSL, extra columns of the table) of a clock field, each reading once, with the unit it is really given in."""
    t = table(spark, sf, TIME_FIELDS[field])
    extra = ["FrameNum"] if "FrameNum" in t.columns else []
    t = t.select("recording_id", "sample_idx", F.col(field).alias("value"), "Time_LSL", *extra)
    return clock_units(t, source="recording_id", idx="sample_idx", value="value", clock="Time_LSL", out="unit")


def _units(spark: SparkSession, sf: str) -> DataFrame:
    """(recording_id, field, sample_idx, value, unit, common, target) of all four fields: the unit found and the value in the field's common unit. A distance
    is proposed in the unit that brings it nearest to 600 mm; the proposal stands if, converted, it lies where the target can be."""
    cols = ["recording_id", "field", "sample_idx", "value", "unit", "target"]
    u = table(spark, sf, "eyelink").select("recording_id", F.lit("Target_Distance").alias("field"), "sample_idx", F.col("Target_Distance").alias("value"))
    u = u.withColumn("unit", nearest_unit(F.col("value"), 600.0, "mm")).withColumn("target", F.lit("mm")).select(*cols)
    for f in TIME_FIELDS:
        u = u.unionByName(clock_readings(spark, sf, f).withColumn("field", F.lit(f)).withColumn("target", F.lit("s")).select(*cols))
    u = to_common(u, "value", "unit", F.col("target"), "common", conversion_table(spark))
    fits = (F.col("field") != "Target_Distance") | plausible(F.col("common"), 400.0, 800.0)
    return u.withColumn("unit", F.when(fits, F.col("unit"))).withColumn("common", F.when(fits, F.col("common")))


def p2_values(spark: SparkSession, sf: str) -> DataFrame:
    """All distances in mm and all times in s, with the unit found in the data and the one that the header or a note declares."""
    u = _units(spark, sf).filter("value is not null and not isnan(value)").filter("field <> 'Target_Distance' or value > 0").dropDuplicates(["recording_id", "field", "sample_idx"])
    d = table(spark, sf, "device_data").withColumn("m", F.from_json("column_descriptions", "map<string,string>"))
    said = [F.struct(F.lit(f).alias("field"), declared_unit(f, F.col("m")[f], F.col("info_text")).alias("declared")) for f in [*TIME_FIELDS, "Target_Distance"]]
    d = d.filter(F.col("device").isin("EyeLink", "FLIR", "RealSense")).select("recording_id", F.explode(F.array(*said)).alias("x")).select("recording_id", "x.field", "x.declared").filter("declared is not null")
    return u.join(d, ["recording_id", "field"], "left").select("recording_id", "field", "sample_idx", "value", "unit", "declared", "common", "target")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The units whose conversion to the field's common unit makes sense of some of a recording's values, but for the usual one."""
    u = _units(spark, sf).filter("common is not null").select("recording_id", "field", "unit").distinct()
    usual = table(spark, sf, "sensor_fields").filter(F.col("device").isin("EyeLink", "FLIR", "RealSense")).select(F.col("column_name").alias("field"), "usual_unit")
    return u.join(F.broadcast(usual), "field").filter("unit <> usual_unit").select("recording_id", "field", "unit")


def p3_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Every faulty reading of AccelX, R_GazeX and R_PupilSize with its kind and score."""
    m = table(spark, sf, "mbient").select(F.lit("AccelX").alias("field"), "recording_id", "sample_idx", F.col("AccelX").alias("value"))
    e = table(spark, sf, "eyelink").select("recording_id", "sample_idx", F.explode(F.create_map(F.lit("R_GazeX"), F.col("R_GazeX"), F.lit("R_PupilSize"), F.col("R_PupilSize"))).alias("field", "value"))
    v, f = F.col("value"), F.col("field")
    bad = F.when(f == "AccelX", F.abs(v) > 16).when(f == "R_GazeX", (v < -5000) | (v > 10000)).otherwise((v <= 0) | (v > 30000))
    return faulty_readings(m.unionByName(e.select("field", "recording_id", "sample_idx", "value")), source=["field", "recording_id"], idx="sample_idx", value="value", impossible=bad & ~F.isnan(v))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_faults(spark, sf).select("field", "recording_id", F.col("sample_idx").cast("long").alias("sample_idx"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return schema_changes(table(spark, sf, "device_data"), table(spark, sf, "raw_records"))


def p5_unified(spark: SparkSession, sf: str) -> DataFrame:
    return unified_records(table(spark, sf, "device_data"), table(spark, sf, "raw_records"), table(spark, sf, "sensor_fields"))


def p5_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    return alternatives(table(spark, sf, "device_data"), table(spark, sf, "raw_records"), table(spark, sf, "sensor_fields"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_grid, p2_found, p2_values, p3_found, p3_faults, p5_found, p5_unified, p5_alternatives)}
ORACLES: dict[str, str] = {"p1_found": P1_FOUND, "p1_grid": P1_GRID}
