"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablegauge.session import read_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, folder, name)


def rounded(df: DataFrame, digits: int = 6, how: Callable[[Column, int], Column] = F.round) -> DataFrame:
    """Round doubles so that summation order does not show."""
    return df.select(
        *[
            how(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def dirty_events(spark: SparkSession, folder: str) -> DataFrame:
    """events with missing values, repeated rows and numbers stored as text, from fixed expressions."""
    e = table(spark, folder, "events").select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        F.expr("CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END").alias("value"),
        F.expr("CASE WHEN event_id % 40 = 0 THEN 'n/a' ELSE CAST(event_id % 97 AS STRING) END").alias("amount_text"),
    )
    return e.unionAll(e.where("event_id % 50 = 0"))


DIRTY_EVENTS = """dirty AS (
  WITH e AS (SELECT event_id, ts, user_id, event_type,
      CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value,
      CASE WHEN event_id % 40 = 0 THEN 'n/a' ELSE CAST(event_id % 97 AS VARCHAR) END AS amount_text
    FROM events)
  SELECT * FROM e UNION ALL SELECT * FROM e WHERE event_id % 50 = 0)"""


def dirty_part(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        "p_partkey",
        "p_brand",
        F.expr(
            "CASE p_partkey % 3 WHEN 0 THEN lower(p_type) WHEN 1 THEN p_type || ' ' ELSE p_type END"
        ).alias("p_type"),
        "p_size",
        "p_retailprice",
    )


DIRTY_PART = """dirty_part AS (
  SELECT p_partkey, p_brand,
    CASE p_partkey % 3 WHEN 0 THEN lower(p_type) WHEN 1 THEN p_type || ' ' ELSE p_type END AS p_type,
    p_size, p_retailprice FROM part)"""
