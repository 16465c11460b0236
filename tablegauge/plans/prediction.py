"""From ranked models to a saved one that predicts raw rows: refit the winner on all rows, save it whole, load, predict.

What is saved is one ``PipelineModel`` from raw columns to ``predicted`` on the target's own scale: fills, groups, encoding,
scaling, model, and the way back (class names, or out of the log). A neighbour model is its rows, written beside the
pipeline that ends in features.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablegauge.functions import columns as C
from tablegauge.operators import features as G, filters, models as K, screens as S
from tablegauge.plans.modeling_run import ModelingResult, model_table
from tablegauge.sources import artefacts


@dataclass
class Fitted:
    """A model fitted on raw rows; ``neighbours`` holds the searched rows where the model has no stages."""

    pipeline: PipelineModel
    task: str
    target: str
    features: list[str]
    candidate: str
    labels: list[str]
    neighbours: K.NeighbourModel | None = None
    log_target: bool = False
    max_categories: int = G.MAX_ONE_HOT


@dataclass
class Prediction:
    """``rows`` is None where columns are missing; ``missing`` (column, position) names them."""

    rows: DataFrame | None
    missing: DataFrame


def refit(df: DataFrame, target: str, task: str, candidate: K.Candidate, numeric: list[str], categorical: list[str], key: str | None = None,
          log_target: bool = False, robust: bool | None = None) -> Fitted:
    """Fit preprocessing and candidate on all rows that have a target. ``key`` is needed for neighbour models only."""
    if task not in (S.REGRESSION, S.BINARY, S.MULTICLASS):
        raise ValueError(f"a model of task {task!r} has no target to predict")
    rows = filters.with_target(df, target)
    stage = G.Preprocessor(numeric, categorical, robust=robust).fit(rows)
    labels: list[str] = []
    if task == S.REGRESSION:
        label = C.as_double(rows, target)
        labelled = rows.withColumn("__label", F.log1p(label) if log_target else label)
    else:
        text = rows.withColumn("__class", C.as_text(rows, target))
        coder = StringIndexer(inputCol="__class", outputCol="__label", stringOrderType="alphabetAsc").fit(text)
        labels, labelled = list(coder.labels), coder.transform(text)
    assembled = stage.transform(labelled).select(
        *([C.quote(key).alias("row_id")] if key else []), "features", F.col("__label").alias("label"))
    if labels:
        assembled = assembled.withMetadata("label", {"ml_attr": {"type": "nominal", "name": "label", "num_vals": len(labels)}})
        if candidate.estimator is not None and candidate.estimator.hasParam("weightCol") and candidate.estimator.isSet("weightCol"):
            assembled = K.class_weights(assembled)
    model = K.fit(candidate, assembled, bool(labels))
    back = [IndexToString(inputCol="prediction", outputCol="predicted", labels=labels)] if labels else [
        SQLTransformer(statement=f"SELECT *, {'EXPM1(prediction)' if log_target else 'prediction'} AS predicted FROM __THIS__")]
    neighbours = model if isinstance(model, K.NeighbourModel) else None
    stages = [*stage.model.stages, *([] if neighbours else [model, *back])]
    return Fitted(PipelineModel(stages), task, target, [*numeric, *categorical], candidate.name, labels, neighbours, log_target, stage.max_categories)


def save(fitted: Fitted, root: str, name: str, metrics: dict[str, float] | None = None) -> str:
    """Write the model and then its metadata row; rows of a neighbour model come before both."""
    found = fitted.neighbours
    if found is not None:
        found.train.select("row_id", "features", "label").write.parquet(f"{root}/models/{name}-rows")
    settings = {"candidate": fitted.candidate, "labels": fitted.labels, "log_target": fitted.log_target, "k": found.k if found else None,
                "max_categories": fitted.max_categories}
    return artefacts.save_model(fitted.pipeline, root, name, fitted.task, fitted.target, fitted.features, metrics, settings)


def load(spark: SparkSession, root: str, name: str) -> tuple[Fitted, dict]:
    """The saved model and its metadata; an unknown name is a ``KeyError``."""
    pipeline, about = artefacts.load_model(spark, root, name)
    settings = about["settings"]
    neighbours = None
    if settings.get("k"):
        neighbours = K.NeighbourModel(spark.read.parquet(f"{root}/models/{name}-rows"), settings["k"], bool(settings["labels"]))
    return Fitted(pipeline, about["task"], about["target"], about["features"], settings.get("candidate", ""), settings.get("labels", []),
                  neighbours, settings.get("log_target", False), settings.get("max_categories", G.MAX_ONE_HOT)), about


def missing_columns(df: DataFrame, features: list[str]) -> DataFrame:
    """(column, position) of the features that the rows do not have, in the model's order."""
    absent = filters.missing_columns(df, features)
    return df.sparkSession.createDataFrame([(c, features.index(c)) for c in absent], "column string, position int")


def predict(fitted: Fitted, df: DataFrame, key: str | None = None) -> Prediction:
    """Raw rows, with all their columns, and ``predicted``; for two classes also ``probability_1`` where the model has one.

    Only the model's features are read, so the target and other columns may be absent; a feature that is absent is
    reported instead of predicted without. Missing values and unseen categories are treated as in training. ``key`` is
    needed for neighbour models."""
    missing = missing_columns(df, fitted.features)
    if not missing.isEmpty():
        return Prediction(None, missing)
    # the rows travel in one column, so that no column of theirs meets a column of the stages
    inputs = df.select(F.struct(*map(C.quote, df.columns)).alias("__row"), *map(C.quote, fitted.features))
    out = fitted.pipeline.transform(inputs)
    if fitted.neighbours is not None:
        if key is None:
            raise ValueError("a neighbour model needs the key of the rows")
        asked = out.select("__row", F.col("__row")[key].alias("row_id"), "features")
        out = fitted.neighbours.transform(asked)
        names = F.array(*map(F.lit, fitted.labels)) if fitted.labels else None
        value = F.expm1("prediction") if fitted.log_target else F.col("prediction")
        out = out.withColumn("predicted", F.get(names, F.col("prediction").cast("int")) if names is not None else value)
    extra = [F.col("predicted")]
    if len(fitted.labels) == 2 and "probability" in out.columns:
        extra.append(F.get(vector_to_array("probability"), F.lit(1)).alias("probability_1"))
    return Prediction(out.select("__row.*", *extra), missing)


def predict_saved(spark: SparkSession, root: str, name: str, df: DataFrame, key: str | None = None) -> Prediction:
    return predict(load(spark, root, name)[0], df, key)


def train_and_save(df: DataFrame, target: str, key: str, root: str, name: str, **options) -> tuple[ModelingResult, Fitted | None]:
    """Run ``model_table``, refit its best candidate on all rows and save it; a run that is blocked or failed saves nothing."""
    result = model_table(df, target, key, **options)
    best = result.ranking.where("rank = 1").first() if result.status == "completed" else None
    if best is None or result.task == S.CLUSTERING:
        return result, None
    candidate = next(c for c in result.candidates if c.name == best["candidate"])
    fitted = refit(df, target, result.task, candidate, result.numeric, result.categorical, key, result.log_target)
    save(fitted, root, name, {best["metric"]: best["score"]})
    return result, fitted
