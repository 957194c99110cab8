"""Scans and sinks: pruned reads, key-filtered scans, derived-data caches, reports and case files."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import schema_of


def read_table(spark: SparkSession, base: str, name: str, cols: Sequence[str] | None = None,
               fmt: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """Table ``name`` under ``base`` with only the wanted columns in the scan.

    CSV needs a schema: the given one or the one known for the clinical tables. NaN in float and
    double columns becomes NULL, whatever the format, so that min/max/sort skip it."""
    reader = spark.read
    if fmt == "csv":
        want = schema if schema is not None else schema_of(name)
        df = reader.schema(want).option("header", True).option("enforceSchema", False).csv(f"{base}/{name}.csv")
    else:
        if schema is not None:
            reader = reader.schema(schema)
        df = reader.format(fmt).load(f"{base}/{name}.{fmt}")
    if cols is not None:
        df = df.select(*cols)
    measures = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in measures}) if measures else df


def read_codes(df: DataFrame, code: str, version: str | None = None) -> DataFrame:
    """Codes as trimmed upper-case strings, NULL as ''; leading zeros survive."""
    out = df.withColumn(code, F.upper(F.trim(F.coalesce(F.col(code).cast("string"), F.lit("")))))
    if version is not None:
        out = out.withColumn(version, F.trim(F.coalesce(F.col(version).cast("string"), F.lit(""))))
    return out


def scan_for_keys(big: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``big`` whose key occurs in ``keys``; the key side is de-duplicated by the semi join."""
    cols = [on] if isinstance(on, str) else list(on)
    return big.join(keys.select(*cols), cols, "left_semi")


def _exists(spark: SparkSession, path: str) -> bool:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath)


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, none if it is absent."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(hpath)] if fs.exists(hpath) else []


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet") -> DataFrame:
    """The table at ``path``, or no rows of ``schema`` when it is absent."""
    if _exists(spark, path):
        return spark.read.schema(schema).options(header=True).format(fmt).load(path)
    return spark.createDataFrame([], schema)


def cached_features(spark: SparkSession, path: str, keys: DataFrame, on: Sequence[str],
                    build: Callable[[], DataFrame]) -> DataFrame:
    """Stored features of the wanted keys; built and stored first when a wanted key is missing.

    Versions are folders below ``path``; the newest finished one (with ``_SUCCESS``) counts. A new version goes to a
    folder of its own, so a reader of an older one is not disturbed. Hit and miss return the same rows."""
    wanted = keys.select(*on)
    finished = sorted(v for v in _children(spark, path) if _exists(spark, f"{path}/{v}/_SUCCESS"))
    if finished:
        stored = spark.read.parquet(f"{path}/{finished[-1]}")
        if wanted.join(stored, list(on), "left_anti").isEmpty():
            return stored.join(wanted, list(on), "left_semi")
    version = f"{path}/v{len(finished):06d}-{uuid.uuid4().hex}"
    build().write.parquet(version)
    return spark.read.parquet(version).join(wanted, list(on), "left_semi")


def _listing_digest(spark: SparkSession, sources: Sequence[str], version: str) -> str:
    """SHA-256 over the version and, per source, the number of files and the sum of a hash of (path, size, modification
    time). Only the sums reach the driver, whatever the number of files; an absent source counts as such."""
    lines = [f"version={version}"]
    for src in sorted(sources):
        if not _exists(spark, src):
            lines.append(f"{src}|absent")
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(src)
        each = F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)")
        n, total = files.agg(F.count("*"), F.sum(each)).first()
        lines.append(f"{src}|{n}|{total}")
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def materialize(spark: SparkSession, path: str, sources: Sequence[str], version: str,
                build: Callable[[], DataFrame]) -> DataFrame:
    """Parquet result that is rebuilt only when a source file or the version changed.

    The digest names the data folder, so a rebuild never overwrites what a reader still uses."""
    data = f"{path}/{_listing_digest(spark, sources, version)[:32]}"
    if not _exists(spark, f"{data}/_SUCCESS"):
        build().write.mode("overwrite").parquet(data)
    return spark.read.parquet(data)


def write_report(df: DataFrame, path: str) -> None:
    """Small report table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_cases(df: DataFrame, path: str) -> None:
    """Nested records as JSON lines, one record per line, written by all tasks."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_cases(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


