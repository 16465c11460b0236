"""Fitted pipelines on shared storage with a metadata row beside each."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

METADATA_SCHEMA = (
    "name string, task string, target string, features array<string>, metrics string, saved_at timestamp_ntz, path string, settings string"
)


def save_model(model: PipelineModel, root: str, name: str, task: str, target: str | None, features: list[str],
               metrics: dict[str, float] | None = None, settings: dict | None = None) -> str:
    """Save the pipeline and then its metadata row, so a listed model is always complete. A name is saved once: a second
    save fails on the path that is there."""
    spark = SparkSession.getActiveSession()
    path = f"{root}/models/{name}"
    model.save(path)
    row = (name, task, target, features, json.dumps(metrics or {}, sort_keys=True),
           dt.datetime.now(dt.UTC).replace(tzinfo=None), path, json.dumps(settings or {}))
    spark.createDataFrame([row], METADATA_SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/metadata")
    return path


def list_models(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(METADATA_SCHEMA).parquet(f"{root}/metadata").orderBy("name")


def load_model(spark: SparkSession, root: str, name: str) -> tuple[PipelineModel, dict]:
    rows = list_models(spark, root).where(F.col("name") == name).collect()
    if not rows:
        raise KeyError(f"no saved model named {name!r}")
    about = rows[0].asDict()
    return PipelineModel.load(about["path"]), about | {"settings": json.loads(about["settings"] or "{}")}
