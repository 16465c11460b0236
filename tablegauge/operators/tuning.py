"""Random search over the parameters of one named estimator, by cross validation.

The exact way cross validates every draw on all rows. ``rungs`` shares the work out: draws are first compared on nested parts of
the rows (a row's part follows from the hash of its key), a share of the best goes on to the next part, and the finalists are cross
validated on all rows. Every draw keeps its row, with the rung it reached. Least squares with penalties needs neither: all
draws come from one Gram matrix per fold.
"""

from __future__ import annotations

import itertools
import json
import math
import random
import threading
import time
from multiprocessing.pool import ThreadPool

from pyspark.ml import classification as K, regression as R
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tablegauge.operators import forests as O, gram, metrics as M, models, screens as S
from tablegauge.operators.splits import UNITS, hash_unit
from tablegauge.session import staged

#: Draws, folds, shares of the rows of the rungs before the last, and the share of draws that goes on. Fixed values.
DRAWS, FOLDS, RUNGS, KEPT = 30, 5, (1 / 9, 1 / 3), 1 / 3
#: Rows of one partition of the fitted table: small tables do not pay for many tasks.
PARTITION_ROWS = 50_000

# fixed values: what a draw may take, per estimator; depth 30 stands for no limit
_DEPTHS = [30, 4, 6, 8, 10, 12, 16, 20, 24]
_ROUNDS = list(range(50, 401, 25))
_RATES = [0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2]
_LAYERS = [[16], [32], [64], [128], [32, 16], [64, 32], [128, 64], [64, 64, 32], [128, 64, 32]]
SPACES: dict[str, dict[str, list]] = {
    "random_forest": {"numTrees": _ROUNDS, "maxDepth": _DEPTHS, "minInstancesPerNode": [1, 2, 4]},
    "gradient_boosting": {"maxIter": _ROUNDS, "stepSize": _RATES, "maxDepth": [2, 3, 4, 5, 6], "subsamplingRate": [0.6, 0.7, 0.8, 0.9, 1.0]},
    "decision_tree": {"maxDepth": [30, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20], "minInstancesPerNode": [1, 2, 4, 8]},
    "knn": {"k": list(range(2, 41))},
    "ridge": {"alpha": [0.0001, 0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0]},
    "lasso": {"alpha": [0.0001, 0.001, 0.01, 0.1, 1.0, 10.0, 100.0]},
    "elastic_net": {"alpha": [0.001, 0.01, 0.1, 1.0, 10.0], "l1": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]},
    "logistic_regression": {"c": [0.0001, 0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0]},
    "linear_svc": {"c": [0.01, 0.1, 1.0, 10.0, 100.0]},
    "mlp": {"hidden": _LAYERS, "stepSize": [0.0005, 0.001, 0.005, 0.01]},
}
_CLASS_ONLY = {"logistic_regression", "linear_svc", "mlp"}
_GRAM = {"ridge", "lasso", "elastic_net"}
_FAMILY = {"random_forest": "ensemble", "gradient_boosting": "ensemble", "decision_tree": "tree_based", "knn": "distance_based", "mlp": "neural"}

RESULT_SCHEMA = (
    "candidate string, family string, parameters string, rung int, share double, folds long, mean double, std double, status string, "
    "reason string, seconds double"
)


def searchable(task: str) -> list[str]:
    """Names that ``search`` takes for a task."""
    if task in (S.BINARY, S.MULTICLASS):
        several = {"linear_svc", "gradient_boosting"} if task == S.MULTICLASS else set()
        return [n for n in SPACES if n not in _GRAM | several]
    return [n for n in SPACES if n not in _CLASS_ONLY] if task == S.REGRESSION else []


def draw(estimator: str, draws: int = DRAWS, seed: int = models.SEED) -> list[dict]:
    """Distinct settings of an estimator in a seeded order; the whole grid where it has no more than ``draws``."""
    space = SPACES[estimator]
    sizes = [len(v) for v in space.values()]
    total = math.prod(sizes)
    chosen = range(total) if total <= draws else random.Random(seed).sample(range(total), draws)
    grid = itertools.product(*space.values())
    if total <= draws:
        return [dict(zip(space, values, strict=True)) for values in grid]
    out = []
    for i in chosen:
        setting = {}
        for name, values in reversed(space.items()):
            i, k = divmod(i, len(values))
            setting[name] = values[k]
        out.append({n: setting[n] for n in space})
    return out


def candidate(estimator: str, task: str, setting: dict, n_rows: int, n_features: int, n_classes: int, number: int) -> models.Candidate:
    """The estimator with a setting, named by its number."""
    classes, name, family = task in (S.BINARY, S.MULTICLASS), f"{estimator}_{number}", _FAMILY.get(estimator, "linear")
    seeded = dict(seed=models.SEED)
    if estimator == "knn":
        return models.Candidate(name, family, None, setting["k"])
    if estimator == "random_forest":
        kept = models.keeps_nodes(n_rows, setting["numTrees"])
        made = (K.RandomForestClassifier if classes else R.RandomForestRegressor)(**setting, **seeded, **kept)
    elif estimator == "gradient_boosting":
        made = (K.GBTClassifier if classes else R.GBTRegressor)(**setting, **seeded)
    elif estimator == "decision_tree":
        made = (K.DecisionTreeClassifier if classes else R.DecisionTreeRegressor)(**setting, **seeded)
    elif estimator == "logistic_regression":
        made = K.LogisticRegression(regParam=1.0 / (setting["c"] * n_rows))
    elif estimator == "linear_svc":
        made = K.LinearSVC(regParam=1.0 / (setting["c"] * n_rows))
    elif estimator == "mlp":
        made = K.MultilayerPerceptronClassifier(
            layers=[n_features, *setting["hidden"], n_classes], stepSize=setting["stepSize"], solver="gd", maxIter=200, **seeded)
    else:
        raise ValueError(f"{estimator!r} has no settings to search")
    return models.Candidate(name, family, made)


def search(df: DataFrame, task: str, estimator: str, draws: int = DRAWS, folds: int = FOLDS, rungs: tuple[float, ...] = RUNGS,
           kept: float = KEPT, seconds: float | None = None, seed: int = models.SEED, parallelism: int = 4) -> DataFrame:
    """One row per draw: ``rank, candidate, family, parameters, rung, share, folds, mean, std, status, reason, seconds``.

    ``df`` holds row_id, features, label and an integer ``fold`` below ``folds``. Draws of the last rung rank first, each rung by its mean
    score; ``rungs=()`` is the exact way, in which all draws reach it. Before the last rung a draw is fitted on its
    share of the rows without fold 0 and scored on that of fold 0. A draw that fails, or takes more than ``seconds`` for a
    fit, keeps a row with the reason and no rank. Ties go to the first drawn.
    """
    if estimator not in searchable(task):
        raise ValueError(f"{estimator!r} cannot be searched for task {task!r}; there are {', '.join(searchable(task))}")
    settings = draw(estimator, draws, seed)
    metric, direction = M.SELECTION[task]
    if estimator in _GRAM:
        rows = _solved(df, estimator, settings)
    else:
        rows = _fitted(df, task, estimator, settings, folds, rungs, kept, seconds, parallelism)
    found = df.sparkSession.createDataFrame(rows, RESULT_SCHEMA)
    better = F.col("mean") if direction == "minimize" else -F.col("mean")
    number = F.element_at(F.split("candidate", "_"), -1).cast("int")
    # a row per draw
    order = W.partitionBy(F.col("mean").isNull()).orderBy(F.col("rung").desc(), better, number)
    return found.select(F.when(F.col("mean").isNotNull(), F.row_number().over(order)).alias("rank"), F.lit(metric).alias("metric"), *found.columns)


def _solved(df: DataFrame, estimator: str, settings: list[dict]) -> list[tuple]:
    started = time.perf_counter()
    made = {
        f"{estimator}_{i}": (s, gram.LinearCandidate(f"{estimator}_{i}", s["alpha"], {"ridge": None, "lasso": 1.0}.get(estimator, s.get("l1"))))
        for i, s in enumerate(settings)}
    scores: dict[str, list[float]] = {}
    for r in gram.cross_validated(df.sparkSession, gram.grams(df), [c for _, c in made.values()]).collect():  # draws x folds
        scores.setdefault(r["candidate"], []).append(r["rmse"])
    spent = (time.perf_counter() - started) / max(1, len(made))
    out = []
    for n, (s, _) in made.items():
        mean, std = _mean(scores.get(n, []))
        out.append((n, "linear", json.dumps(s), 0, 1.0, len(scores.get(n, [])), mean, std, "completed" if mean is not None else "failed",
                    None if mean is not None else "no fold to score on", spent))
    return out


def _mean(values: list[float]) -> tuple[float | None, float | None]:
    if not values or not all(map(math.isfinite, values)):
        return None, None
    mean = sum(values) / len(values)
    return mean, math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))


def _stop(spark: SparkSession, tag: str, seconds: float, done: threading.Event) -> None:
    """Cancel the jobs of a fit once its time is over; a fit runs many, so until it has ended."""
    wait = seconds
    while not done.wait(wait):
        spark.sparkContext.cancelJobsWithTag(tag)
        wait = 0.2


def _fitted(df: DataFrame, task: str, estimator: str, settings: list[dict], folds: int, rungs: tuple[float, ...], kept: float,
            seconds: float | None, parallelism: int) -> list[tuple]:
    spark, classify = df.sparkSession, task in (S.BINARY, S.MULTICLASS)
    n_rows = df.count()
    parts = max(1, math.ceil(n_rows / PARTITION_ROWS))
    # the same rows in the same order in every fit: seeds of sampling follow partitions
    rows = staged(df.select("row_id", "features", "label", "fold").repartition(parts, "row_id").sortWithinPartitions("row_id"), "searched")
    rows = rows.withColumn("__unit", hash_unit(F.col("row_id")))
    first = rows.agg(F.count_distinct("label").alias("classes")).first()
    width = len(rows.select("features").first()["features"]) if n_rows else 0
    if classify:
        rows = rows.withMetadata("label", {"ml_attr": {"type": "nominal", "name": "label", "num_vals": max(2, first["classes"])}})
    made = {i: candidate(estimator, task, s, n_rows, width, max(2, first["classes"]), i) for i, s in enumerate(settings)}
    spent = dict.fromkeys(made, 0.0)
    result: dict[int, tuple] = {}
    metric, direction = M.SELECTION[task]

    def fit_and_score(work: tuple[int, int, float]) -> tuple[int, float | None, str | None]:
        i, fold, share = work
        started, tag, done = time.perf_counter(), f"search-{threading.get_ident()}-{i}-{fold}", threading.Event()
        spark.sparkContext.addJobTag(tag)
        if seconds:
            threading.Thread(target=_stop, args=(spark, tag, seconds, done), daemon=True).start()
        try:
            part = rows.where(F.col("__unit") < share * UNITS)
            model = models.fit(made[i], part.where(F.col("fold") != fold), classify)
            value = models.score(models.predict_label(model, part.where(F.col("fold") == fold)), task).get(metric)
            return i, value, None if value is not None else f"no {metric} on fold {fold}"
        except Exception as error:  # a broken draw is a result
            late = seconds and time.perf_counter() - started >= seconds
            return i, None, f"stopped after {seconds:g} seconds" if late else str(error).splitlines()[0][:300]
        finally:
            done.set()
            spark.sparkContext.removeJobTag(tag)
            spent[i] += time.perf_counter() - started

    def grown(fold: int, share: float) -> dict[int, float | None]:
        """Scores of all trees or forests of a fold at once, where they grow from counts of cells; with a limit of time fits go one by one."""
        settings = {i: s for i in alive if made[i].estimator is not None and (s := O.Settings.of(made[i].estimator)) and s.rate is None}
        if seconds or not classes or not settings:
            return {}
        started = time.perf_counter()
        part = rows.where(F.col("__unit") < share * UNITS)
        train, test = part.where(F.col("fold") != fold), part.where(F.col("fold") == fold)
        cells = O.Cells.of(train, classes)
        asked = O.Cells.of(test, classes, cells.cuts) if cells else None
        if not cells or not asked:
            return {}
        found = {i: O.f1_macro(c) for i, c in zip(settings, O.confusions(cells, asked, list(settings.values())), strict=True)}
        for i in found:
            spent[i] += (time.perf_counter() - started) / len(found)
        return found

    classes = models.n_classes(rows) if classify else None
    alive = list(made)
    with ThreadPool(parallelism) as pool:
        for rung, share in enumerate([*rungs, 1.0]):
            last = rung == len(rungs)
            found: dict[int, list] = {i: [] for i in alive}
            wanted = list(range(folds)) if last else [0]
            together = dict(zip(wanted, pool.map(lambda f, share=share: grown(f, share), wanted, 1), strict=True))
            for i, value in ((i, v) for scores in together.values() for i, v in scores.items()):
                found[i].append((value, None))
            for i, value, reason in pool.map(fit_and_score, [(i, f, share) for i in alive for f in wanted if i not in together[f]], 1):
                found[i].append((value, reason))
            for i, scores in found.items():
                reason = next((r for v, r in scores if v is None), None)
                mean, std = (None, None) if reason else _mean([v for v, _ in scores])
                if mean is None:
                    reason = reason or f"no finite {metric}"
                result[i] = (rung, share, len(scores), mean, std, reason)
            good = [i for i in alive if result[i][3] is not None]
            good.sort(key=lambda i: (result[i][3] if direction == "minimize" else -result[i][3], i))
            if not last:
                alive = sorted(good[: max(1, math.ceil(len(made) * kept ** (rung + 1)))])
    out = []
    for i, (rung, share, n, mean, std, reason) in result.items():
        status = "failed" if mean is None else "completed" if rung == len(rungs) else "not advanced"
        out.append((made[i].name, made[i].family, json.dumps(settings[i]), rung, float(share), n, mean, std, status, reason, spent[i]))
    return out
