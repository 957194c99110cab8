"""Registered queries: each is a plan over the driver tables, most with an equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str, *cols: str) -> DataFrame:
    return read_table(spark, sf, name, cols or None)


def r6(col: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """The frame with its listed double columns rounded, all others unchanged."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def R(expr: str, digits: int = 6) -> str:
    """Same rounding in SQL; adding zero turns -0.0 into 0.0."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


# Orders seen as visits: acuity from the priority, admission from the status, scores from amounts.
def visits(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice",
        F.substring("o_orderpriority", 1, 1).cast("int").alias("acuity"),
        (F.col("o_orderkey") % 5 + 1).cast("int").alias("acuity_pred"),
        (F.col("o_orderstatus") == "F").cast("int").alias("admitted"),
        F.least(F.greatest(F.col("o_totalprice") / 500000, F.lit(0.0)), F.lit(1.0)).alias("score"),
        (((F.col("o_orderkey") * 7919) % 1000) / 1000.0).alias("base_score"))


VISITS = """v AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority, o_orderstatus, o_totalprice,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS acuity,
  CAST(o_orderkey % 5 + 1 AS INTEGER) AS acuity_pred,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS admitted,
  least(greatest(o_totalprice / 500000, CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) AS score,
  ((o_orderkey * 7919) % 1000) / CAST(1000 AS DOUBLE) AS base_score
FROM orders)"""
