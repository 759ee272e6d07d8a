"""Session builder and the few settings the library itself needs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "cadenza", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, UTC and Arrow. On a cluster the submitter's settings win: only unset keys are given here."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: spark.checkpoint.dir. Where that is unset (tests, a single machine) a temporary one is set."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = known.get() if known.isDefined() else None
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="cadenza-", dir=os.environ.get("TMPDIR"))
        spark.sparkContext.setCheckpointDir(d)
    return d


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """The rows of a scan dealt out anew for work that is dear per row, but only where the scan has fewer tasks than the session has cores:
    large inputs have many splits and are read where they lie, without a shuffle. `df` must not hold a shuffle itself."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() > per_core * cores else df.repartition(per_core * cores)
