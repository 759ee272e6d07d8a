"""Decoders of files as written, result files, and operators beside them."""

import json

from pyspark.sql import functions as F

from cadenza.functions import names
from cadenza.operators import joins, series
from cadenza.operators.devices import decode_records, mean_colours
from cadenza.plans.jobs import associated_files
from cadenza.sources.phone_json import phone_metadata

FILES = "recording_id long, booth_id int, device_id string, device string, file_datetime timestamp, column_names string, column_descriptions string"
FIELDS = [
    ("Mouse", 0, "PosX", "int", "px", "Pointer position across"), ("Mouse", 1, "PosY", "int", "px", "Pointer position down"), ("Mouse", 2, "MouseState", "int", None, "Button state of the pointer"),
    ("Webcam", 0, "FrameNum", "int", None, "Frame counter of the webcam"), ("Webcam", 1, "Time_ACQ", "float", "s", "Acquisition computer clock"),
]


def test_decode_records(spark):
    said = json.dumps({"PosX": "Pointer position across (px)", "X": "Pointer position across, in px", "PosY": "Pointer position down (px)", "MouseState": "Button state of the pointer", "Time_ACQ": "Acquisition computer clock (s)", "FrameNum": "Frame counter of the webcam"})
    files = [
        (1, 1, "a", "Mouse", None, "['PosX', 'PosY', 'MouseState']", said),
        (2, 1, "a", "Mouse", None, "MouseState; X", said),  # another order, a renamed column, one missing
        (3, 1, "w", "Webcam", None, '["FrameNum", "Time_ACQ"]', said),
        (4, 1, "w", "Webcam", None, None, None),  # states no columns
    ]
    recs = [(1, 0, "10,20,1"), (1, 1, "11,NA,-1"), (1, 1, "11,NA,-1"), (1, 2, "only one"), (2, 0, "0;12.7"), (3, 0, '["f000007", 3.5]'), (4, 0, "1,2"), (None, 0, "1,2,0")]
    f, r = spark.createDataFrame(files, FILES), spark.createDataFrame(recs, "recording_id long, row_no int, payload string")
    d = spark.createDataFrame(FIELDS, "device string, position_no int, column_name string, value_type string, usual_unit string, description string")
    got = sorted(map(tuple, decode_records(f, r, d, "Mouse").collect()))
    assert got == [(1, 0, 10, 20, "Click"), (1, 1, 11, None, "Release"), (2, 0, 12, None, "Move")]
    assert [tuple(x) for x in decode_records(f, r, d, "Webcam").collect()] == [(3, 0, 7, 3.5)]
    assert decode_records(f, r.limit(0), d, "Mouse").count() == 0


def test_csv_and_session_names(spark):
    rows = [("100123_2021-05-06_10h-11m-12s_DSC_results.csv",), ("100123_2021-05-06_10h-11m-12s_MOT_outcomes_v2.csv",), ("100123_2021-13-06_10h-11m-12s_DSC_results.csv",), ("notes.csv",), (None,)]
    d = names.parse_csv_names(spark.createDataFrame(rows, "n string"), "n")
    got = [(r["subject"], str(r["at"]), r["task_name"], r["result"], r["ok"]) for r in d.collect()]
    assert got[0] == ("100123", "2021-05-06 10:11:12", "DSC_obs", "results", True) and got[1][2:] == ("MOT_obs_1", "outcomes", True)
    assert [g[4] for g in got[2:]] == [False, False, False]
    s = spark.createDataFrame([("100123_2021-05-06_x",), ("x",), (None,)], "n string")
    out = [r[0] for r in s.select(names.make_session_id(names.session_subject(F.col("n")), names.session_date(F.col("n")))).collect()]
    assert out == ["100123_2021_05_06", None, None]


def test_last_interval(spark):
    s = spark.createDataFrame([(k, float(t)) for k in (1, None) for t in range(6)], "k int, t double")
    iv = spark.createDataFrame([(1, 0.0, 1.0, 1), (1, 3.0, 4.0, 2), (1, 9.0, 9.5, None)], "k int, a double, b double, no int")
    got = joins.interval_flag(s, iv, ["k"], "t", "a", "b", "inside", 2.0, last_by="no")
    assert sorted(r["t"] for r in got.filter("inside").collect()) == [3.0, 4.0] and got.count() == 12


def test_mono_zip_and_colours(spark):
    d = spark.createDataFrame([([1.0, 3.0],), ([2.0, None],), ([],), (None,)], "c array<double>")
    assert [r[0] for r in d.select(series.mono(F.col("c"))).collect()] == [2.0, None, None, None]
    a = spark.createDataFrame([(1, 5, "x"), (1, 2, "y"), (2, 1, "z")], "k int, o int, v string")
    b = spark.createDataFrame([(1, 70, "p"), (1, 60, "q"), (1, 80, "r")], "k int, o int, v string")
    z = series.positional_zip(a, b, ["k"], "o", "o")
    assert sorted((r["o"], r["v"], r["i"], r["r_o"], r["r_v"]) for r in z.collect()) == [(2, "y", 0, 60, "q"), (5, "x", 1, 70, "p")]
    at = [0.0, 0.35] + [0.5 + 0.1 * k for k in range(61)]
    m = spark.createDataFrame([(1, k, t, 1.0, 2.0, float("nan")) for k, t in enumerate(at)], "k int, f int, t double, R double, G double, B double")
    whole, later = mean_colours(m, ["k"], "f", "t"), mean_colours(m, ["k"], "f", "t", exclude_beginning=True)
    assert whole.count() == 63 and 0 < later.count() < 63 and {"MeanColor_R", "MeanColor_G", "MeanColor_B"} <= set(later.columns)
    assert whole.filter("MeanColor_B is not null").count() == 0


def test_associated_files(spark):
    rows = [("s", "1", "t0", "MOT", "FLIR", "i", "a.hdf5", ".hdf5"), ("s", "1", "t0", "MOT", "FLIR", "j", "a.avi", ".avi"), ("s", "1", "t1", "MOT", "FLIR", "i", "b.hdf5", ".hdf5"), ("s", None, "t0", "MOT", "FLIR", "i", "c.hdf5", ".hdf5")]
    d = spark.createDataFrame(rows, "session_path string, subject_id string, file_datetime string, task string, device string, device_info string, file_name string, extension string")
    get = lambda **kw: {r["file_name"]: r["associated"] for r in associated_files(d, d, **kw).collect()}
    assert get()["a.hdf5"] == ["a.avi", "a.hdf5"] and get()["c.hdf5"] == []
    assert get(extensions=(".avi",))["a.hdf5"] == ["a.avi"] and get(use_device_info=True)["a.hdf5"] == ["a.hdf5"]


def test_phone_metadata(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"iOSVersionNumber": "17", "appVersionNumber": "2.1", "deviceID": "d", "Framedata": []}))
    got = phone_metadata(spark, str(tmp_path)).collect()[0]
    assert (got["ios_version"], got["app_version"], got["device_id"], got["device_type"]) == ("17", "2.1", "d", None)
