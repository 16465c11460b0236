"""Append-once registries (versions, experiments) kept as parquet tables, and read-only SQL over them."""

from __future__ import annotations

import datetime as dt
import re

from py4j.java_gateway import is_instance_of
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablegauge.operators import quality as Q, profile as P
from tablegauge.operators.versions import VERSION_SCHEMA, schema_snapshot

EXPERIMENT_SCHEMA = (
    "experiment_id string, source string, created_at timestamp_ntz, dataset_id string, metric string, "
    "direction string, score double, winner string, parameters string"
)
READ_ONLY = ("select", "with", "describe", "show")
PLANS = "org.apache.spark.sql.catalyst.plans.logical"


class RegistryConflict(ValueError):
    """A record that is already registered, or whose parent is not."""


def read_registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def _append_new(spark: SparkSession, path: str, rows: DataFrame, known: DataFrame, key: str) -> int:
    """Append rows whose key is not registered yet; refuses when a key repeats."""
    clash = rows.join(known.select(key), key, "left_semi").select(key).limit(5).collect()
    twice = rows.groupBy(key).count().where("count > 1").select(key).limit(5).collect()
    if clash or twice:
        raise RegistryConflict(f"already registered: {[r[key] for r in clash + twice]}")
    fresh = rows.join(known.select(key), key, "left_anti").select(*known.columns)
    fresh.coalesce(1).write.mode("append").parquet(path)  # registry rows: one per version or run
    return fresh.count()


def register_versions(spark: SparkSession, path: str, rows: DataFrame) -> int:
    """Append versions; every parent must be registered already or come in the same call."""
    known = read_registry(spark, path, VERSION_SCHEMA)
    ids = known.select("version_id").unionByName(rows.select("version_id")).select(
        F.col("version_id").alias("parent_version_id")
    )
    child = rows.where(F.col("parent_version_id").isNotNull())
    orphans = child.join(ids, "parent_version_id", "left_anti").select("version_id").limit(5).collect()
    if orphans:
        raise RegistryConflict(f"parent not registered for: {[r['version_id'] for r in orphans]}")
    return _append_new(spark, path, rows, known, "version_id")


def versions(spark: SparkSession, path: str, dataset_id: str | None = None) -> DataFrame:
    out = read_registry(spark, path, VERSION_SCHEMA)
    return out.where(F.col("dataset_id") == dataset_id) if dataset_id else out


def get_version(spark: SparkSession, path: str, version_id: str) -> DataFrame:
    return versions(spark, path).where(F.col("version_id") == version_id)


def children(spark: SparkSession, path: str, version_id: str) -> DataFrame:
    return versions(spark, path).where(F.col("parent_version_id") == version_id).orderBy("version_number", "version_id")


def version_row(
    df: DataFrame,
    dataset_id: str,
    version_id: str,
    kind: str,
    number: int,
    parent: str | None = None,
    execution_id: str | None = None,
    stored: dict | None = None,
    with_quality: bool = True,
) -> DataFrame:
    """One version record with schema and quality snapshots taken from the table."""
    stored = stored or {}
    spark = df.sparkSession
    quality = dict(score=None, total_findings=None)
    missing = None
    if with_quality:
        quality = Q.summarise(Q.run_checks(df)).select("score", "total_findings").first().asDict()
        missing = P.total_missing_cells(df).first()[0]
    rows = stored.get("row_count")
    row = (
        dataset_id, version_id, parent, kind, number, execution_id, stored.get("path"), stored.get("size_bytes"),
        stored.get("sha256"), rows if rows is not None else df.count(), len(df.columns), schema_snapshot(df),
        quality["score"], quality["total_findings"], missing, dt.datetime.now(dt.UTC).replace(tzinfo=None),
    )
    return spark.createDataFrame([row], VERSION_SCHEMA)


def register_experiments(spark: SparkSession, path: str, rows: DataFrame) -> int:
    return _append_new(spark, path, rows, read_registry(spark, path, EXPERIMENT_SCHEMA), "experiment_id")


def experiments(spark: SparkSession, path: str) -> DataFrame:
    return read_registry(spark, path, EXPERIMENT_SCHEMA)


class QueryRejected(ValueError):
    """A statement that is not read-only, or that Spark refused."""


def _writes(spark: SparkSession, sql: str) -> bool:
    """Whether Spark's parser reads the statement as a command or an insert, whatever words it holds."""
    session = spark._jsparkSession
    try:
        plan = session.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:
        raise QueryRejected(f"query cannot be parsed: {error}") from error
    is_kind = lambda kind: is_instance_of(spark.sparkContext._gateway, plan, f"{PLANS}.{kind}")
    while is_kind("UnresolvedWith"):
        plan = plan.child()
    return is_kind("Command") or is_kind("ParsedStatement")


def query_table(records: DataFrame, sql: str, name: str = "experiments") -> DataFrame:
    """Read-only Spark SQL over one table exposed under ``name``."""
    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S).strip().lower()
    if not bare.startswith(READ_ONLY) or (bare.startswith(("select", "with")) and _writes(records.sparkSession, sql)):
        raise QueryRejected(f"only read-only statements are allowed {READ_ONLY}: {sql!r}")
    records.createOrReplaceTempView(name)
    try:
        return records.sparkSession.sql(sql)
    except Exception as error:
        raise QueryRejected(f"query failed: {error}") from error
