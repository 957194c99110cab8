"""Byte files through Spark: each row of a binary column becomes one file below a shared folder.

Spark's text writer puts a string's bytes out unchanged and adds its line separator, so a binary column cast to string
is written as it is, with the separator as the file's last bytes. Writes go through Spark's committer and any
file system that Spark knows; a lost executor's files are written again by the retried task."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def write_files(df: DataFrame, content: str, folder: str, tail: bytes) -> None:
    """One file per row of ``content``, each followed by the bytes ``tail`` (at least one)."""
    (df.select(F.col(content).cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
     .option("encoding", "ISO-8859-1").option("lineSep", tail.decode("latin-1")).text(folder))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Column ``content`` with the bytes of every file."""
    return spark.read.format("binaryFile").load(folder).select("content")
