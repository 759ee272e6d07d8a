"""Names of files, sessions, tasks, devices and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tasks in the order in which they are tried as a prefix.
TASKS = [
    "intro_sess_obs_1", "intro_occulo_obs_1", "intro_cog_obs_1", "intro_speech_obs_1", "coord_pause_obs_1", "coord_pause_obs_2", "progress_bar_obs_1", "progress_bar_obs_2",
    "progress_bar_obs_3", "progress_bar_obs_4", "ahh_obs_1", "lalala_obs_1", "mememe_obs_1", "gogogo_obs_1", "pataka_obs_1", "passage_obs_1", "noIMU_ahh_obs_1", "noIMU_gogogo_obs_1",
    "DSC_obs", "MOT_obs_1", "sdmt_obs_1", "mouse_obs", "hevelius_obs", "calibration_obs_1", "fixation_no_target_obs_1", "gaze_holding_obs_1", "fixation_target_obs_1",
    "saccades_horizontal_obs_1", "saccades_vertical_obs_1", "pursuit_obs", "finger_nose_obs_1", "foot_tapping_obs_1", "altern_hand_mov_obs_1", "sit_to_stand_obs", "timing_test_obs",
    "timing_test_obs_2", "clapping_test", "clapping_test_2", "passage_demo_obs_1", "pursuit_test_obs_test", "mouse_demo_obs", "saccades_horizontal_obs_test", "pursuit_test_obs_1",
    "finger_nose_demo_obs_1", "task_obs_1",
]

# Patterns of session and file names.
SESSION = r"^(\d+)_(\d\d\d\d)[_-](\d\d)[_-](\d\d).*$"
DATA_FILE = r"^(\d+)_(\d\d\d\d)-(\d\d)-(\d\d)_(\d\d)h-(\d\d)m-(\d\d)s_(.*)(\..+)$"
CSV_FILE = r"^(\d+)_(\d\d\d\d)-(\d\d)-(\d\d)_(\d\d)h-(\d\d)m-(\d\d)s_(DSC|MOT)_(results|outcomes)(?:_v2)?\.csv$"
MARKER_POSITION = r"^!V TARGET_POS target(_\d+)? (\d+), (\d+) \d+ \d+_([\d.]+)"
DEVICE_WORDS = ["eyelink", "iphone", "flir", "intel", "yeti", "mbient", "mouse", "webcam"]
DEVICE_NAMES = ["EyeLink", "IPhone", "FLIR", "RealSense", "Yeti", "Mbient", "Mouse", "Webcam"]
LIMBS = {"_BK_": "Back", "_LF_": "Left Foot", "_RF_": "Right Foot", "_LH_": "Left Hand", "_RH_": "Right Hand"}


def part(text: Column, pattern: str, k: int) -> Column:
    """Group k of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def session_date(name: Column) -> Column:
    return F.when(name.rlike(SESSION), F.make_date(*[part(name, SESSION, k).cast("int") for k in (2, 3, 4)]))


def device_of(device_text: Column, extension: Column) -> Column:
    """Device named in the rest of a file name; asc and edf files are the eye tracker's."""
    low = F.lower(device_text)
    out = F.lit(None).cast("string")
    for w, n in reversed(list(zip(DEVICE_WORDS, DEVICE_NAMES))):
        out = F.when(low.contains(w), n).otherwise(out)
    return F.when(F.lower(extension).isin(".asc", ".edf"), "EyeLink").otherwise(out)


def device_info_of(device: Column, device_text: Column, extension: Column) -> Column:
    """Which camera or limb; empty for other devices, null where it should be said but isn't. Case counts."""
    video = F.lower(extension).isin(".mov", ".avi", ".bag", ".mp4")
    cam = F.lit(None).cast("string")
    limb = F.lit(None).cast("string")
    for k in (3, 2, 1):
        cam = F.when(F.when(video, device_text.contains(f"intel{k}")).otherwise(device_text.contains(f"Intel_D455_{k}")), f"RealSense {k}").otherwise(cam)
    for w, n in reversed(LIMBS.items()):
        limb = F.when(device_text.contains(w), n).otherwise(limb)
    return F.when(device == "RealSense", cam).when(device == "Mbient", limb).otherwise("")


def parse_file_names(df: DataFrame, name: str) -> DataFrame:
    """Adds subject, at, task, device_name, device_which, ext and ok. A name that doesn't fit keeps its row with nulls and ok = false.
    The first task in TASKS that the rest starts with wins."""
    n = F.col(name)
    task = r"^(" + "|".join(TASKS) + r")_?(.*)$"
    rest, ext = part(n, DATA_FILE, 8), F.lower(part(n, DATA_FILE, 9))
    at = F.try_make_timestamp_ntz(*[part(n, DATA_FILE, k).cast("int") for k in range(2, 8)])
    d = df.withColumn("subject", part(n, DATA_FILE, 1)).withColumn("at", at).withColumn("ext", ext).withColumn("task_name", part(rest, task, 1)).withColumn("dev_text", F.regexp_extract(rest, task, 2))
    d = d.withColumn("device_name", device_of(F.col("dev_text"), F.col("ext")))
    d = d.withColumn("device_which", device_info_of(F.col("device_name"), F.col("dev_text"), F.col("ext")))
    ok = F.col("subject").isNotNull() & F.col("at").isNotNull() & F.col("task_name").isNotNull() & F.col("device_name").isNotNull() & F.col("device_which").isNotNull()
    return d.withColumn("ok", ok).drop("dev_text")


# Tasks that the result files name.
CSV_TASKS = {"DSC": "DSC_obs", "MOT": "MOT_obs_1"}


def parse_csv_names(df: DataFrame, name: str) -> DataFrame:
    """Adds subject, at, task_name, result (results or outcomes) and ok of a task's result files; other names keep their row with nulls and ok = false."""
    n = F.col(name)
    at = F.try_make_timestamp_ntz(*[part(n, CSV_FILE, k).cast("int") for k in range(2, 8)])
    task = part(n, CSV_FILE, 8)
    d = df.withColumn("subject", part(n, CSV_FILE, 1)).withColumn("at", at)
    known = F.lit(None).cast("string")
    for k, v in CSV_TASKS.items():
        known = F.when(task == k, v).otherwise(known)
    return d.withColumn("task_name", known).withColumn("result", part(n, CSV_FILE, 9)).withColumn("ok", F.col("at").isNotNull() & known.isNotNull())


def make_session_id(subject: Column, date: Column) -> Column:
    """Name of a session: subject_yyyy_mm_dd; null if either is."""
    return F.concat(subject, F.lit("_"), F.date_format(date, "yyyy_MM_dd"))


def session_subject(name: Column) -> Column:
    return part(name, SESSION, 1)


def extension_of(name: Column) -> Column:
    """Last extension in lower case with its dot, empty without one."""
    return F.lower(F.regexp_extract(name, r"[^./](\.[^./]*)$", 1))


def change_extension(name: Column, ext: str) -> Column:
    return F.regexp_replace(name, r"\.[^./]*$", ext)


def version_struct(text: Column) -> Column:
    """struct(major, minor); 0.0 where none is given."""
    return F.struct(F.coalesce(part(text, r"(\d+)\.(\d+)", 1).cast("int"), F.lit(0)).alias("major"), F.coalesce(part(text, r"(\d+)\.(\d+)", 2).cast("int"), F.lit(0)).alias("minor"))


def array_literal(a: Column) -> Column:
    """A PostgreSQL array literal of strings, quoted and escaped."""
    q = F.transform(a, lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(q, ","), F.lit("}"))


def sensor_file_name(stem: Column, device: Column, sensors: Column) -> Column:
    return F.concat(F.concat_ws("-", stem, device, F.array_join(sensors, "-")), F.lit(".hdf5"))
