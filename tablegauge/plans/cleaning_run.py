"""From a table to a registered, cleaned version: findings, plan, gated run, sinks, registry and lineage check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tablegauge.operators import cleaning as K, versions as V
from tablegauge.sources import landing, registry as R


@dataclass
class CleaningResult:
    cleaned: DataFrame
    log: DataFrame
    versions: DataFrame
    problems: DataFrame


def clean_and_register(df: DataFrame, dataset_id: str, workspace: str, options: K.RunOptions,
                       with_quality: bool = False) -> CleaningResult:
    """Plan and run the cleaning of one table, store raw and processed data, register both versions, verify them.

    The raw copy is written first and read back, so the plan, the run and the checks all see the stored bytes and a
    lost executor never re-reads a changed source.
    """
    spark = df.sparkSession
    raw = landing.save_processed(df, f"{workspace}/raw", dataset_id, "raw")
    stored = spark.read.parquet(raw["path"])
    operations = K.operation_rows(K.plan_for(stored, options.target))
    run = K.execution_id(operations, options)
    cleaned, log = K.run_plan(stored, operations, options)
    processed = landing.save_processed(cleaned, f"{workspace}/processed", dataset_id, run)
    cleaned = spark.read.parquet(processed["path"])
    path = f"{workspace}/registry/versions"
    first, second = f"{dataset_id}-raw", f"{dataset_id}-{run}"
    R.register_versions(
        spark, path, R.version_row(stored, dataset_id, first, "raw", 1, stored=raw, with_quality=with_quality)
    )
    R.register_versions(
        spark, path,
        R.version_row(cleaned, dataset_id, second, "processed", 2, first, run, processed, with_quality),
    )
    log = log.withColumn("execution_id", F.lit(run))
    log.write.mode("append").parquet(f"{workspace}/registry/operations")
    versions = R.versions(spark, path, dataset_id)
    problems = V.lineage_problems(versions).select("version_id", "problem").unionByName(
        V.log_consistency(versions, log.where("status = 'executed' AND rows_after IS NOT NULL")
                          .withColumn("step", F.row_number().over(_by_step())))
        .select("version_id", "problem")
    )
    return CleaningResult(cleaned, log, versions, problems)


def _by_step():
    from pyspark.sql import Window as W

    return W.partitionBy("execution_id").orderBy("step")  # a few operations per run
