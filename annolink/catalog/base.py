"""Registered queries: every operator on the driver's tables, with an independent SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import micros

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DAY = 86_400_000_000


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def t(spark, d, name) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark, d) -> DataFrame:
    """events with integer time (us) and value (cents)."""
    return t(spark, d, "events").select(
        "event_id", "user_id", "event_type", micros("ts").alias("us"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"), "props",
    )


def lines(spark, d) -> DataFrame:
    """lineitem with integer ship day and money in cents."""
    return t(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.col("l_quantity").cast("bigint").alias("qty"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("disc"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("tax"),
        "l_returnflag", "l_linestatus",
        F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint").alias("day"),
    )


def orders(spark, d) -> DataFrame:
    return t(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint").alias("day"),
    )


# The same shapes for the oracle.
EV = """ev AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us,
  CAST(round(value*100) AS BIGINT) AS cents, props FROM events)"""
LI = """li AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT) AS qty,
  CAST(round(l_extendedprice*100) AS BIGINT) AS cents, CAST(round(l_discount*100) AS BIGINT) AS disc,
  CAST(round(l_tax*100) AS BIGINT) AS tax, l_returnflag, l_linestatus,
  CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS day FROM lineitem)"""
OD = """od AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
  CAST(round(o_totalprice*100) AS BIGINT) AS cents,
  CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day FROM orders)"""
