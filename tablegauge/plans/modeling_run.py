"""From a table and a target to ranked models: screens, features, split, candidates, training, ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame, functions as F

from tablegauge.functions import columns as C
from tablegauge.operators import features as G, metrics as M, models as K, profile as P, screens as S, splits as L
from tablegauge.session import staged


@dataclass
class ModelingResult:
    status: str
    task: str | None
    issues: DataFrame
    features: list[str]
    runs: DataFrame | None = None
    ranking: DataFrame | None = None
    summary: DataFrame | None = None
    models: dict | None = None
    preprocessor: G.Preprocessor | None = None
    candidates: list[K.Candidate] | None = None
    numeric: list[str] | None = None
    categorical: list[str] | None = None
    log_target: bool = False


def model_table(df: DataFrame, target: str | None, key: str, hint: str | None = None,
                families: list[str] | None = None, classes_declared: bool = False, parallelism: int = 4) -> ModelingResult:
    """Regression, classification or (without a target) clustering of one table; ``key`` identifies a row.

    The split comes from the key's hash, preprocessing is fitted on training rows only, and the assembled rows are
    persisted once for all candidates.
    """
    facts = C.settle(P.column_table(df))
    if target is None and hint:
        target = S.choose_target(S.target_scores(facts, hint)).first()["target"]
    task_row = S.task_type(facts, target, classes_declared).first()
    task = task_row["task"] if task_row else None
    if task is None:
        issues = df.sparkSession.createDataFrame([("blocking", "no_task", str(target))], S.ISSUE_SCHEMA)
        return ModelingResult("blocked", None, issues, [])
    chosen = G.select_features(df.drop(key), target, facts.where(F.col("column") != key))
    names = sorted(r["column"] for r in chosen.where("action <> 'drop'").select("column").collect())
    kinds = C.eda_kinds(df)
    flags = [f.name for f in df.schema.fields if f.dataType.simpleString() == "boolean"]
    numeric = [c for c in names if kinds[c] == C.NUMERIC or c in flags]
    categorical = [c for c in names if kinds[c] == C.CATEGORICAL and c not in flags]
    issues = S.feasibility(df, target, task)
    issues = issues.unionByName(S.readiness(df, target, task, len(numeric) + len(categorical), S.passes(issues)))
    if not S.passes(issues):
        return ModelingResult("blocked", task, issues, names)
    plan = L.split_plan(df, task, target).first()
    shares = (plan["train_fraction"], plan["validation_fraction"], plan["test_fraction"])
    rows = df if target is None else C.normalise_missing(df).where(C.quote(target).isNotNull())
    if task == S.CLUSTERING:
        split = rows.withColumn("split", F.lit("train"))
    elif plan["stratify"]:
        split = L.stratified_holdout(rows, key, target, shares)
    else:
        split = L.random_holdout(rows, key, shares)
    train_rows = split.where("split = 'train'")
    stage = G.Preprocessor(numeric, categorical).fit(train_rows)
    n_labels = 0
    if task in (S.BINARY, S.MULTICLASS):
        # all classes of the training rows, in order of their text; a class met only in test rows gets the code after the
        # last one, which no model predicts, so that its rows count as errors
        text = split.withColumn("__class", C.as_text(split, target))
        coder = StringIndexer(inputCol="__class", outputCol="__label", stringOrderType="alphabetAsc", handleInvalid="keep").fit(
            text.where("split = 'train'"))
        n_labels = len(coder.labels)
        labelled = coder.transform(text).drop("__class")
    else:
        labelled = split.withColumn("__label", C.as_double(split, target) if target else F.lit(0.0))
    assembled = staged(stage.transform(labelled).select(
        C.quote(key).alias("row_id"), "features", F.col("__label").alias("label"), "split"), "assembled")
    train, test = (assembled.where(F.col("split") == part).drop("split") for part in ("train", "test"))
    if n_labels:  # trees take the number of classes from here
        train = train.withMetadata("label", {"ml_attr": {"type": "nominal", "name": "label", "num_vals": n_labels}})
    use_log = task == S.REGRESSION and G.log_target(train, "label").first()["use_log"]
    width = len(train.select("features").first()["features"])
    wanted = families or K.families(task, df.count(), len(names), not categorical)
    candidates = [c for c in K.baselines(task, width, max(2, n_labels)) if c.family in wanted]
    runs, models = K.train_candidates(train, test, task, candidates, use_log, parallelism)
    status = "failed" if runs.where("status = 'completed'").isEmpty() else "completed"
    return ModelingResult(
        status, task, issues, names, runs, M.rank_runs(runs, task), M.summarise_runs(runs), models, stage, candidates, numeric,
        categorical, bool(use_log),
    )
