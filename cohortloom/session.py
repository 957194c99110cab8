"""Session helpers shared by the entry point, the bench and the tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "cohortloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution and a UTC clock; cluster settings win where they exist."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; all executors must share it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def local_checkpoint_dir(spark: SparkSession) -> None:
    """For tests, benches and smoke runs in one process: a private folder where the session names none."""
    if spark.conf.get("spark.checkpoint.dir", None) or not spark.sparkContext.master.startswith("local["):
        return
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet below the shared checkpoint folder and read it back.

    Several readers then share one result that survives lost executors. Unlike an RDD checkpoint the
    table keeps its columns prunable and its size known, so joins are planned by measured size."""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
