import datetime as dt

from pyspark.sql import functions as F

from cadenza.operators.drift import alternatives, parse_names, parse_payload, schema_changes, tag, unified_records

FILES = "recording_id long, booth_id int, device_id string, device string, file_datetime timestamp, column_names string, column_descriptions string"
REC = "recording_id long, row_no int, payload string"
FIELDS = "device string, position_no int, column_name string, value_type string, usual_unit string, description string"


def test_notations(spark):
    texts = ['["a", " b"]', "['a', 'b']", '["[\\"a\\", \\"b\\"]"]', "a; b ", "[]", "", None, '["lvl (10 samples)", "b"]', "a\tb", "a|b", "['it is \"x\"', 'b']"]
    got = [r["n"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", parse_names(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [["a", "b"]] * 4 + [None, None, None] + [["lvl (10 samples)", "b"], ["a", "b"], ["a", "b"], ['it is "x"', "b"]]


def test_payloads_and_tags(spark):
    rows = [("[1, 2.50, null]", 3), ("1;2.50;x", 3), ("1,2", 2), ("\t\t3", 3), ("alone", 1), ("1,2", 3), (None, 2), ('["a,b", 2]', 2)]
    got = [r["p"] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, n int").select("i", parse_payload(F.col("t"), F.col("n")).alias("p")).orderBy("i").collect()]
    assert got == [["1", "2.5", None], ["1", "2.50", "x"], ["1", "2"], ["", "", "3"], ["alone"], None, None, ["a,b", "2"]]
    vals = ["1", "-4", "2.5", "1e3", "f01", "NA", "", None, "2020-01-01T00:00:00"]
    tags = [r["g"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string").select("i", tag(F.col("v")).alias("g")).orderBy("i").collect()]
    assert tags == ["whole", "whole", "decimal", "decimal", "text", None, None, None, "text"]


def _day(k):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=40 * k)


def _data(spark):
    d1 = '{"PosX": "Across (px)", "PosY": "Down [px]"}'
    d2 = '{"pos_x": "Across, in px", "PosY": "Down"}'
    files = [
        (1, 1, "m", "Mouse", _day(0), "PosX;PosY", d1),
        (2, 1, "m", "Mouse", _day(1), None, None),
        (3, 1, "m", "Mouse", _day(2), '["PosY", " pos_x"]', d2),
        (4, 1, "m", "Mouse", _day(3), "['pos_x', 'PosY', 'Gain']", None),
        (5, 1, "m", "Mouse", _day(4), "PosY;Gain", None),
        (6, 2, "m", "Mouse", _day(5), "PosY", None),
        (7, None, "m", "Mouse", _day(6), "PosY", None),
    ]
    recs = [(1, 0, "1,2"), (1, 0, "1,2"), (3, 0, "2.0;7"), (4, 0, "5,f01,1"), (4, 1, "5,NA,1"), (5, 0, "NA\tNA"), (2, 0, "9")]
    fields = [("Mouse", 0, "PosX", "int", "px", "Across"), ("Mouse", 1, "PosY", "int", "px", "Down")]
    return spark.createDataFrame(files, FILES), spark.createDataFrame(recs, REC), spark.createDataFrame(fields, FIELDS)


def test_changes(spark):
    f, r, _ = _data(spark)
    got = {tuple(x) for x in schema_changes(f.unionByName(f.limit(1)), r).select("recording_id", "column_name", "change").collect()}
    assert got == {(3, "pos_x", "renamed"), (3, "PosY", "retyped"), (4, "Gain", "added"), (4, "PosY", "retyped"), (5, "pos_x", "removed")}


def test_unified(spark):
    f, r, d = _data(spark)
    rows = {(x["recording_id"], x["row_no"], x["column_name"]): x for x in unified_records(f, r, d).collect()}
    assert rows[3, 0, "PosX"]["written_as"] == "pos_x" and rows[3, 0, "PosX"]["as_whole"] == 7
    assert rows[4, 0, "PosY"]["as_text"] == "f01" and rows[4, 0, "PosY"]["canonical"] == 1.0
    assert rows[5, 0, "PosY"]["type"] is None and (2, 0, "PosX") not in rows
    alt = {(x["column_name"], x["type"]) for x in alternatives(f, r, d).collect()}
    assert ("PosY", "text") in alt and ("PosY", "decimal") in alt


def test_empty(spark):
    f, r, d = _data(spark)
    assert schema_changes(f.limit(0), r.limit(0)).count() == 0
    assert unified_records(f.limit(0), r, d).count() == 0
