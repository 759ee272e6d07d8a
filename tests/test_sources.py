import json

from pyspark.sql import functions as F

from cadenza.operators.corrections import correct
from cadenza.operators.chunks import previous_row
from cadenza.operators.eye_merge import align_files, drop_blinks, merge_eye_data
from cadenza.plans.jobs import SliceOptions, batches, clinical, colour_plan, device_ids, flagged_subjects, last_positions, pending, slice_files, trial_gaze
from cadenza.sources import catalogue, eye_ascii, phone_json, sinks
from cadenza.streaming.ingest import ingest


def test_phone_json(spark, tmp_path):
    frames = [{"FrameNumber": "2", "TimestampVideo": "0.2", "TimestampVideoUnix": "10.2"}, {"FrameNumber": "1", "TimestampVideo": "0.1", "TimestampVideoUnix": "10.1"}, {"DroppedFrameNumber": "3", "DroppedTimestamp": "0.3", "DroppedReason": "late"}]
    frames.append({"AudioSampleTimeReceived": json.dumps({"NumberOfSamples": 512, "Timestamp": 1.5})})
    texts = [json.dumps(f) for f in frames]
    (tmp_path / "a.json").write_text(json.dumps({"Metadata": {}, "Framedata": texts}))
    (tmp_path / "b.json").write_text(json.dumps(texts[:1]))
    f = phone_json.phone_frames(spark, str(tmp_path))
    assert [r["FrameNum"] for r in phone_json.video_frames(f).filter("path like '%a.json'").collect()] == [1, 2]
    assert phone_json.video_frames(f).count() == 3 and phone_json.dropped_frames(f).count() == 1
    assert phone_json.audio_batches(f).collect()[0]["samples"] == 512


def test_eye_ascii(spark, tmp_path):
    (tmp_path / "e.asc").write_text("MSG 100 5 task_start\nESACC L 101 105 4\nEFIX  R  106 110 4\nmsg 200 TASK_END\nMSG 300 TASK_START\n")
    (tmp_path / "g.txt").write_text("1\t2.0\t   .\t9\t4\t5\n\n2\t...\t1\t9\t4\t5\n")
    lines = eye_ascii.event_lines(spark, str(tmp_path / "e.asc"))
    assert [(r["kind"], r["eye"], r["start"], r["end"]) for r in eye_ascii.eye_spans(lines).orderBy("start").collect()] == [("saccade", "L", 101, 105), ("fixation", "R", 106, 110)]
    s = eye_ascii.task_spans(lines).collect()[0]
    assert (s["start"], s["end"], s["status"]) == (95.0, 200.0, "ok")
    h = eye_ascii.href_samples(spark, str(tmp_path / "g.txt")).orderBy("Time_EDF").collect()
    assert [(r["Time_EDF"], r["L_X_HREF"], r["L_Y_HREF"], r["R_Y_HREF"]) for r in h] == [(1.0, 2.0, None, 5.0), (2.0, None, 1.0, 5.0)]


def test_catalogue(spark, tmp_path):
    s = tmp_path / "100200_2020_01_02"
    s.mkdir()
    for n in ("100200_2020-01-02_03h-04m-05s_mouse_obs_R001-Mouse.hdf5", "x.log", "odd.bin"):
        (s / n).write_text("x")
    got = {r["file_name"]: r["ok"] for r in catalogue.catalogue(catalogue.list_files(spark, [str(tmp_path)])).collect()}
    assert got == {"100200_2020-01-02_03h-04m-05s_mouse_obs_R001-Mouse.hdf5": True, "odd.bin": False}


def test_jobs(spark):
    d = spark.createDataFrame([("/a/100200_2020_01_02", "100200", "Mouse", "t", ".hdf5", "f1"), ("/a/100050_2021_01_02", "100050", "Mouse", "t", ".hdf5", "f2"), ("/a/100300_2022_01_02", "100300", "Mouse", "t", ".bag", "f3")], "session_path string, subject_id string, device string, task string, extension string, file_name string")
    assert [r["file_name"] for r in slice_files(d, SliceOptions(devices=("Mouse",), start_date="2019-01-01")).collect()] == ["f1"]
    assert slice_files(d, SliceOptions(devices=("Mouse",), include_test_subjects=True)).count() == 2
    p = colour_plan(d.withColumn("file_datetime", F.lit(1)).withColumn("device_info", F.lit("")))
    assert {r["status"] for r in p.collect()} == {"no video"}
    assert pending(d.select(F.col("file_name").alias("path")), spark.createDataFrame([("f1",)], "path string")).count() == 2
    flags = spark.createDataFrame([("100200", False), ("100050", True)], "subject_id string, f boolean")
    assert [r[0] for r in flagged_subjects(d, flags, "subject_id", "f").collect()] == ["100050", "100300"]
    x = clinical(d.withColumn("d", F.lit("2020-01-01").cast("timestamp_ntz")), {"t": (d.select("subject_id", F.lit("2020-01-03").cast("timestamp_ntz").alias("d")), "d")}, ["subject_id"], "d")
    assert {r["t_offset"] for r in x["t"].collect()} == {2.0}
    c = correct(d, "device", {"Mouse": lambda x: x.withColumn("task", F.lit("new"))})
    assert {r["task"] for r in c.collect()} == {"new"} and correct(d, "device", {}).count() == 3


def test_previous_row_over_buckets(spark):
    d = spark.createDataFrame([(1, i, i * 10, f"n{i}") for i in (3, 1, 2, 7, 9)] + [(2, 5, 50, "other")], "k int, id int, at int, x string")
    got = {r["id"]: r["prev_x"] for r in previous_row(d, ["k"], "at", "id", ["x"], F.floor(F.col("at") / 25)).collect()}
    assert got == {1: None, 2: "n1", 3: "n2", 7: "n3", 9: "n7", 5: None}


def test_ingest_takes_each_file_once(spark, tmp_path):
    src, out, log, cp = (str(tmp_path / x) for x in ("src", "out", "log", "cp"))
    run = lambda: ingest(spark, src, "a int", out, log, cp, lambda d: d.withColumn("b", F.col("a") * 2)).awaitTermination()
    spark.createDataFrame([(1,), (2,)], "a int").coalesce(1).write.parquet(src)
    run()
    spark.createDataFrame([(3,)], "a int").coalesce(1).write.mode("append").parquet(src)
    run()
    run()
    assert sorted(r["b"] for r in spark.read.parquet(out).collect()) == [2, 4, 6]
    assert spark.read.parquet(log).count() == 2


def test_eye_merge(spark):
    n = 40
    s = spark.createDataFrame([(1, i, 100.0 + i, i / 10, 500.0) for i in range(n)], "rec int, sample_idx int, Time_EDF double, Time_LSL double, Target_Distance double")
    g = spark.createDataFrame([(1, 100.0 + i, 2.0 * i, 0.0, 3.0 * i, 0.0, 2.0, 1.0) for i in range(n) if i != 7], "rec int, Time_EDF double, L_X double, L_Y double, R_X double, R_Y double, X_Res double, Y_Res double")
    h = spark.createDataFrame([(1, 100.0 + i, 1.0, 1.0, 1.0, 1.0) for i in range(n)], "rec int, Time_EDF double, L_X_HREF double, L_Y_HREF double, R_X_HREF double, R_Y_HREF double")
    spans = spark.createDataFrame([(1, "L", "blink", 103.0, 105.0), (1, "R", "saccade", 110.0, 112.0)], "rec int, eye string, kind string, start double, end double")
    task = spark.createDataFrame([(1, 102.0, 110.0), (1, 115.0, 130.0)], "rec int, start double, end double")
    d = {r["sample_idx"]: r for r in merge_eye_data(s, g, h, spans, ["rec"]).collect()}
    assert len(d) == n and abs(d[20]["L_VX"] - 10) < 1e-9 and abs(d[20]["R_VX"] - 15) < 1e-9 and d[7]["L_X"] is None
    assert [i for i in d if d[i]["L_Blink"]] == [3, 4] and [i for i in d if d[i]["R_Saccade"]] == [10, 11]
    assert d[0]["Time_EDF"] == 0.1 and d[0]["Target_Distance"] == 0.5
    only = merge_eye_data(s, g, h, spans, ["rec"], task=task, min_task_samples=5)
    assert sorted(r["sample_idx"] for r in only.collect()) == list(range(15, 30))
    assert merge_eye_data(s, g, h, spans, ["rec"], task=task, min_task_samples=50).count() == 0
    assert drop_blinks(s.withColumn("b", F.col("sample_idx") < 3), "Time_LSL", "Time_LSL", "b").count() == n - 3


def test_align_ids_sinks_and_streams(spark, tmp_path):
    a = spark.createDataFrame([("s", 1, "x1"), ("s", 2, "x2"), ("t", 1, "x3")], "k string, at int, file string")
    got = align_files(a, a.filter("k = 's'").select("k", "file"), ["k"], "at").collect()
    assert [(r["k"], r["file"]) for r in got] == [("s", "x2")]
    (tmp_path / "ids.txt").write_text(" a \n\nb\n")
    assert sorted(r[0] for r in catalogue.read_ids(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b"]
    sinks.write_series(a, str(tmp_path / "out"), ["k"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    st = spark.createDataFrame([("p", "Marker", "d"), ("p", "Cam", "d"), ("p", "Mic", None), ("p", "Eye", "d")], "path string, name string, description string")
    v = spark.createDataFrame([("p", "Cam,a,b.avi"), ("p", "Cam,c.avi"), ("p", "odd")], "path string, text string")
    assert {r["name"]: r["videos"] for r in sinks.attach_videos(st, v).collect()} == {"Cam": ["a,b.avi", "c.avi"], "Eye": []}
    rec = spark.sql("select * from values ('t', date '2024-06-01'), ('t', date '2023-01-01'), ('u', date '2023-01-01') as x(task_id, date)")
    log = spark.sql("select 't' task_id, date '2024-06-01' date, array('new') device_ids")
    assert [r["device_ids"] for r in device_ids(rec, log, {"t": ["old"]}).orderBy("task_id", "date").collect()] == [["old"], ["new"], None]
    assert [r["batch"] for r in batches(a, "file", 2).orderBy("file").collect()] == [0, 0, 1]
    tr = spark.createDataFrame([("s", 1, 0, 1)], "k string, trial int, a int, b int")
    assert trial_gaze(tr, a, ["k"], "at", "a", "b").count() == 1
    assert last_positions(a.withColumn("target", F.lit(1)), ["k"], "target", "at").count() == 2
