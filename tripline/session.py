"""Session defaults and the two places where a plan touches the cluster's setup."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Settings every plan relies on; all of them may be changed at run time.

    Timestamps are UTC.  Python workers get batches of bounded size: texts and vectors of thousands of terms grow many times as Python objects.  AQE re-plans joins from measured sizes and splits skewed
    shuffle partitions.
    """
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }.items():
        spark.conf.set(key, value)
    return spark


def build(app: str = "tripline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back.

    Scans read their input twice and reports use one frame many times; a settled frame is
    read again instead of computed again, also after an executor is lost.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only a session
    without that setting and without a folder of its own (a test on one machine) gets a
    temporary one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def _shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return tempfile.mkdtemp(prefix="tripline-")


def scratch(spark: SparkSession) -> str:
    """A new folder all executors can reach, for tables a job writes and reads again."""
    return f"{_shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
