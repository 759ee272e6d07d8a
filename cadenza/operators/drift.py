"""Schemas that drift between files: tagged-union inference, one consistent table, a report of every change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .chunks import previous_row

# How an absent value is written in payloads.
ABSENT = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "none", "-", "?"]


def parse_names(col: Column) -> Column:
    """Column names of a file as an array of trimmed strings, from any notation: a JSON list, a Python list, a list within
    a one-element list, or names with ; , | or tab between. Null, blank or empty lists give null; blank names are dropped."""
    text = F.trim(col)
    as_json = lambda c: F.from_json(c, "array<string>")
    outer = as_json(text)
    inner = F.get(outer, F.lit(0))
    python = as_json(F.regexp_replace(F.regexp_replace(text, '"', '\\\\"'), "'", '"'))
    names = (
        F.when((F.size(outer) == 1) & F.ltrim(inner).startswith("["), F.coalesce(as_json(inner), as_json(F.regexp_replace(inner, "'", '"'))))
        .when(F.size(outer) > 0, outer)
        .when(text.startswith("["), python)
        .when(text.contains(";"), F.split(text, ";"))
        .when(text.contains("\t"), F.split(text, "\t"))
        .when(text.contains("|"), F.split(text, r"\|"))
        .otherwise(F.split(text, ","))
    )
    names = F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(names) > 0, names)


def parse_payload(payload: Column, n: Column) -> Column:
    """The values of a row as written, as many as n: a JSON list, or ; tab | or comma between, whichever gives n values. Numbers of a JSON list come in their shortest form, decimals still as decimals."""
    text = payload
    trimmed = F.trim(text)
    out = F.from_json(trimmed, "array<string>")
    cut = F.lit(None).cast("array<string>")
    for sep in [",", r"\|", ";", "\t"]:
        parts = F.split(text, sep, -1)
        cut = F.when(F.size(parts) == n, parts).otherwise(cut)
    vals = F.when(trimmed.startswith("[") & (F.size(out) == n), out).otherwise(cut)
    return F.transform(vals, lambda x: F.trim(x))


def tag(value: Column) -> Column:
    """Alternative a written value belongs to: whole, decimal or text; null if it is a mark of an absent value."""
    return (
        F.when(value.isNull() | value.isin(ABSENT), None)
        .when(value.rlike(r"^[+-]?[0-9]+$"), "whole")
        .when(value.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$") | value.rlike(r"^[+-]?[0-9]+[eE][+-]?[0-9]+$"), "decimal")
        .otherwise("text")
    )


def stated_files(files: DataFrame) -> DataFrame:
    """Files that state their columns, with `names`."""
    return files.withColumn("names", parse_names(F.col("column_names"))).filter("names is not null")


def quantities(files: DataFrame) -> DataFrame:
    """(device, name, quantity): what each written name stands for, as most files of the device describe it, without units.

    One row per distinct name of a device, however many files there are; counted map-side first. Names
    that no file describes don't come out."""
    d = files.select("device", F.explode(F.from_json("column_descriptions", "map<string,string>")).alias("name", "text"))
    d = d.withColumn("name", F.trim("name")).withColumn("quantity", F.lower(F.trim(F.regexp_replace("text", r"\s*(\([^()]*\)|\[[^\]]*\]|, in [^,]+)\s*$", ""))))
    n = d.filter("quantity <> ''").groupBy("device", "name", "quantity").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("device", "name").agg(F.max_by("quantity", F.struct(F.col("n"), F.col("quantity"))).alias("quantity"))


def written_values(files: DataFrame, records: DataFrame) -> DataFrame:
    """(recording_id, row_no, position, name, value, tag): the payloads taken apart by their file's columns. Repeated rows come once;
    payloads that don't hold one value per column are left out."""
    f = stated_files(files).select("recording_id", "device", "names")
    r = records.select("recording_id", "row_no", "payload").dropDuplicates(["recording_id", "row_no"])
    j = r.join(f, "recording_id").withColumn("vals", parse_payload(F.col("payload"), F.size("names"))).filter("vals is not null")
    e = j.select("recording_id", "device", "row_no", F.explode(F.arrays_zip("names", "vals")).alias("x"))
    return e.select("recording_id", "device", "row_no", F.col("x.names").alias("name"), F.col("x.vals").alias("value"), tag(F.col("x.vals")).alias("tag"))


def file_types(values: DataFrame) -> DataFrame:
    """(recording_id, name, type): the fused alternative of each column of each file: text over decimal over whole. Columns
    without any value have none."""
    rank = F.create_map(*[F.lit(x) for x in ("whole", 1, "decimal", 2, "text", 3)])
    t = values.filter("tag is not null").groupBy("recording_id", "name").agg(F.max(F.element_at(rank, F.col("tag"))).alias("r"))
    return t.select("recording_id", "name", F.element_at(F.array(*[F.lit(x) for x in ("whole", "decimal", "text")]), F.col("r")).alias("type"))


def schema_changes(files: DataFrame, records: DataFrame) -> DataFrame:
    """(recording_id, column_name, change): 'added', 'removed', 'renamed' and 'retyped' against the file before it.

    Files are ordered by file_datetime within (booth_id, device_id), ties by recording_id; files that state no columns are
    passed over; the first has no changes. A column gone and a new one that stand for the same quantity are one rename;
    names nobody describes are compared by their letters and digits. A retyped column has values in both files
    whose fused alternatives differ. Null booths or devices are keys of their own. Repeated file rows count once."""
    f = stated_files(files).dropDuplicates(["recording_id"]).select("recording_id", "booth_id", "device_id", "device", "file_datetime", "names")
    pairs = previous_row(f, ["booth_id", "device_id"], "file_datetime", "recording_id", ["recording_id", "names"], F.date_trunc("month", F.col("file_datetime").cast("timestamp")))
    pairs = pairs.filter("prev_names is not null").select("recording_id", "device", "names", "prev_names", F.col("prev_recording_id").alias("prev_id"))
    new = pairs.select("recording_id", "device", F.explode(F.array_except("names", "prev_names")).alias("name"), F.lit("added").alias("side"))
    gone = pairs.select("recording_id", "device", F.explode(F.array_except("prev_names", "names")).alias("name"), F.lit("removed").alias("side"))
    letters = F.lower(F.regexp_replace("name", "[^A-Za-z0-9]", ""))
    both = new.unionByName(gone).join(quantities(files), ["device", "name"], "left").withColumn("quantity", F.coalesce("quantity", letters))
    m = both.groupBy("recording_id", "quantity").agg(
        F.array_sort(F.collect_set(F.when(F.col("side") == "added", F.col("name")))).alias("a"), F.array_sort(F.collect_set(F.when(F.col("side") == "removed", F.col("name")))).alias("r")
    )
    # as many renames as both sides have names; what is left over is added or removed
    k = F.least(F.size("a"), F.size("r"))
    parts = F.concat(
        F.transform("a", lambda x, i: F.struct(x.alias("column_name"), F.when(i < k, "renamed").otherwise("added").alias("change"))),
        F.transform("r", lambda x, i: F.struct(x.alias("column_name"), F.when(i < k, F.lit(None).cast("string")).otherwise("removed").alias("change"))),
    )
    named = m.select("recording_id", F.explode(parts).alias("x")).select("recording_id", "x.column_name", "x.change").filter("change is not null")
    shared_dir(files.sparkSession)
    types = file_types(written_values(files, records)).checkpoint()  # a row per file and column, needed for both files of a pair; payloads are taken apart once
    kept = pairs.select("recording_id", "prev_id", F.explode(F.array_intersect("names", "prev_names")).alias("name"))
    now = types.select("recording_id", "name", F.col("type").alias("now"))
    then = types.select(F.col("recording_id").alias("prev_id"), "name", F.col("type").alias("then"))
    retyped = kept.join(now, ["recording_id", "name"]).join(then, ["prev_id", "name"]).filter("now <> then")
    return named.unionByName(retyped.select("recording_id", F.col("name").alias("column_name"), F.lit("retyped").alias("change")))


def unified_records(files: DataFrame, records: DataFrame, fields: DataFrame) -> DataFrame:
    """All payloads as one table under the usual names: (recording_id, row_no, device, column_name, written_as, type, as_whole,
    as_decimal, as_text, canonical).

    Conflicting alternatives of a column are split into the typed branches as_whole, as_decimal and as_text, of which one is set;
    `canonical` is the value in the column's usual type: a number, for text its digits at the end (a frame written 'f000002') or, for
    an ISO time, its epoch seconds. Absent values have null branches. Columns without a usual name keep their own, with
    the canonical value of their own type. Files that state no columns give no rows."""
    v = written_values(files, records)
    q = quantities(files)
    usual = fields.select("device", F.lower("description").alias("quantity"), F.col("column_name").alias("usual"))
    v = v.join(q, ["device", "name"], "left").join(usual, ["device", "quantity"], "left")
    text = F.when(F.col("tag") == "text", F.col("value"))
    iso = F.try_to_timestamp(text)
    digits = F.nullif(F.regexp_extract(text, r"([0-9]+)$", 1), F.lit("")).try_cast("double")
    number = F.when(F.col("tag") != "text", F.col("value").try_cast("double"))
    stamp = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.unix_micros(iso) / 1e6)
    return v.select(
        "recording_id", "row_no", "device", F.coalesce("usual", "name").alias("column_name"), F.col("name").alias("written_as"), F.col("tag").alias("type"),
        F.when(F.col("tag") == "whole", F.col("value").try_cast("long")).alias("as_whole"), F.when(F.col("tag") == "decimal", F.col("value").try_cast("double")).alias("as_decimal"),
        text.alias("as_text"), F.coalesce(number, stamp, digits).alias("canonical"),
    )


def alternatives(files: DataFrame, records: DataFrame, fields: DataFrame) -> DataFrame:
    """(device, column_name, type, first_seen, files, rows): each typed alternative of each column with the time of the file in which it first appears."""
    u = unified_records(files, records, fields).filter("type is not null").groupBy("recording_id", "device", "column_name", "type").agg(F.count(F.lit(1)).alias("rows"))
    f = files.select("recording_id", "file_datetime").dropDuplicates(["recording_id"])
    return u.join(f, "recording_id").groupBy("device", "column_name", "type").agg(F.min("file_datetime").alias("first_seen"), F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"))
