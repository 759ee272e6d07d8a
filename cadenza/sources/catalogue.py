"""File catalogues from listings, and waiting for tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import SESSION, extension_of, parse_file_names


def list_files(spark: SparkSession, roots: list[str], glob: str = "*") -> DataFrame:
    """(path, session, file_name, size, modified) of the files in session folders under the roots; contents aren't read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(roots)
    d = d.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("session"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return d.filter(F.col("session").rlike(SESSION))


def catalogue(files: DataFrame, strict: bool = False) -> DataFrame:
    """Parsed names; notes, csv, xdf, logs, jittered and temporary files are left out. Unparsable names stay with ok = false, or are an error if strict."""
    ext = extension_of(F.col("file_name"))
    d = files.filter(~ext.isin(".csv", ".xdf", ".log", ".tmp", ".swp", ".txt") & ~F.col("file_name").contains("_jittered"))
    d = parse_file_names(d, "file_name")
    return d.withColumn("ok", F.when(F.col("ok"), True).otherwise(F.raise_error(F.concat(F.lit("can't parse "), F.col("file_name"))).cast("boolean"))) if strict else d


def wait_for_tables(spark: SparkSession, names: list[str], polls: int = 6, interval_s: float = 5.0) -> None:
    """Returns once all tables exist; TimeoutError after the last poll."""
    for k in range(polls):
        if all(spark.catalog.tableExists(n) for n in names):
            return
        if k < polls - 1:
            time.sleep(interval_s)
    raise TimeoutError(f"tables not there: {[n for n in names if not spark.catalog.tableExists(n)]}")


def jdbc_options(host: str, port: int, database: str, user: str, password: str) -> dict[str, str]:
    return {"url": f"jdbc:postgresql://{host}:{port}/{database}", "user": user, "password": password, "driver": "org.postgresql.Driver"}


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id) of a text file with one id per line; blank lines are dropped."""
    return spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''")
