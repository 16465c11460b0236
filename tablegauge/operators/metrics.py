"""Evaluation from (label, prediction) rows: plain aggregates, exact ranks for the ROC area, centroids for clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tablegauge.functions import columns as C
from tablegauge.operators import ordered

# fixed values: selection metric and direction per task, family order for ties
SELECTION = {
    "regression": ("rmse", "minimize"),
    "time_series_forecasting": ("rmse", "minimize"),
    "binary_classification": ("f1_macro", "maximize"),
    "multiclass_classification": ("f1_macro", "maximize"),
    "clustering": ("silhouette", "maximize"),
}
FAMILIES = ["linear", "tree_based", "ensemble", "probabilistic", "distance_based", "neural"]


def regression_metrics(rows: DataFrame, label: str = "label", prediction: str = "prediction", digits: int = 6) -> DataFrame:
    """mse, rmse, mae and r2 (NULL when the label does not vary), one aggregate."""
    y, gap = F.col(label).cast("double"), F.col(label).cast("double") - F.col(prediction)
    one = rows.agg(
        F.count("*").alias("n"), F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae"), F.var_pop(y).alias("var")
    )
    return one.select(
        "n",
        F.round("mse", digits).alias("mse"),
        F.round(F.sqrt("mse"), digits).alias("rmse"),
        F.round("mae", digits).alias("mae"),
        C.signed_round(F.when(F.col("var") > 0, 1.0 - F.col("mse") / F.col("var")), digits).alias("r2"),
    )


def confusion(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return rows.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def classification_metrics(rows: DataFrame, label: str = "label", prediction: str = "prediction", digits: int = 6) -> DataFrame:
    """Accuracy and macro precision, recall and F1 over the classes seen on either side; empty classes count as 0."""
    cells = confusion(rows, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("label").cast("string").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("called"), hit.cast("long").alias("hit")),
                F.struct(F.col("prediction").cast("string").alias("class"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("called"), F.lit(0).cast("long").alias("hit")),
            )
        )
    )
    per_class = sides.groupBy("class").agg(F.sum("actual").alias("actual"), F.sum("called").alias("called"), F.sum("hit").alias("hit"))
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("hit"), F.col("called")), zero)
    recall = F.coalesce(F.try_divide(F.col("hit"), F.col("actual")), zero)
    f1 = F.coalesce(F.try_divide(2.0 * precision * recall, precision + recall), zero)
    return per_class.agg(
        F.sum("actual").alias("n"),
        F.round(F.sum("hit") / F.sum("actual"), digits).alias("accuracy"),
        F.round(F.avg(precision), digits).alias("precision_macro"),
        F.round(F.avg(recall), digits).alias("recall_macro"),
        F.round(F.avg(f1), digits).alias("f1_macro"),
    )


def roc_auc(rows: DataFrame, label: str = "label", score: str = "score", digits: int = 6) -> DataFrame:
    """Exact area under the ROC curve from the average ranks of the positive class (label 1)."""
    positive = F.col(label).cast("int") == 1
    value = {"score": F.col(score).cast("double")}
    long = ordered.long_values(rows, value, {"positive": positive}, ordered.sketch_edges(rows, value))
    counts = long.groupBy("column", "bucket", "x").agg(F.count("*").alias("n"), F.count_if("positive").alias("p"))
    one = ordered.average_ranks(counts, ["column"]).agg(
        F.sum("p").cast("double").alias("p"),
        F.sum(F.col("n") - F.col("p")).cast("double").alias("q"),
        F.sum(F.col("p") * F.col("avg_rank")).alias("ranks"),
    )
    u = F.col("ranks") - F.col("p") * (F.col("p") + 1.0) / 2.0
    return one.select(F.round(F.try_divide(u, F.col("p") * F.col("q")), digits).alias("roc_auc"))


def cluster_metrics(rows: DataFrame, features: str = "features", cluster: str = "prediction", digits: int = 6,
                    silhouette: bool = True) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin from centroids, and Spark's silhouette (squared Euclidean distance).

    Centroids are one row per cluster; distances to them are row-wise, so there are no pairs of rows.
    """
    points = rows.select(F.col(cluster).cast("int").alias("c"), vector_to_array(features).alias("v"))
    entries = points.select("c", F.posexplode("v").alias("i", "x"))
    means = entries.groupBy("c", "i").agg(F.avg("x").alias("m"))
    centroid = means.groupBy("c").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("center")
    )
    square = lambda a, b: F.aggregate(
        F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, d: acc + d
    )
    distances = points.join(F.broadcast(centroid), "c").withColumn("d2", square(F.col("v"), F.col("center")))
    spread = distances.groupBy("c").agg(
        F.count("*").alias("n"), F.avg(F.sqrt("d2")).alias("s"), F.sum("d2").alias("w"), F.first("center").alias("center")
    )
    whole = entries.groupBy("i").agg(F.avg("x").alias("m")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("grand")
    )
    totals = C.attach_row(spread, whole).agg(
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
        F.sum("w").alias("within"),
        F.sum(F.col("n") * square(F.col("center"), F.col("grand"))).alias("between"),
    )
    a = spread.select(F.col("c").alias("c1"), F.col("s").alias("s1"), F.col("center").alias("m1"))
    b = spread.select(F.col("c").alias("c2"), F.col("s").alias("s2"), F.col("center").alias("m2"))
    worst = (
        a.join(F.broadcast(b), F.col("c1") != F.col("c2"))  # one row per cluster on both sides
        .withColumn("r", F.try_divide(F.col("s1") + F.col("s2"), F.sqrt(square(F.col("m1"), F.col("m2")))))
        .groupBy("c1")
        .agg(F.max("r").alias("r"))
        .agg(F.avg("r").alias("db"))
    )
    k, n = F.col("k"), F.col("n")
    ch = F.try_divide(F.col("between") / (k - 1), F.col("within") / (n - k))
    out = C.attach_row(totals.where(k >= 2), worst).select(
        "k", "n", F.round(ch, digits).alias("calinski_harabasz"), F.round("db", digits).alias("davies_bouldin")
    )
    if not silhouette:
        return out
    value = ClusteringEvaluator(featuresCol=features, predictionCol=cluster).evaluate(rows)
    return out.withColumn("silhouette", F.round(F.lit(float(value)), digits))


def cluster_metrics_together(rows: DataFrame, digits: int = 6) -> dict[int, dict[str, float]]:
    """``cluster_metrics`` of many clusterings of the same rows, by number, in two passes over ``v array<double>, c array<int>`` (the cluster in
    each). (Clusterings x clusters) sums of rows reach the driver; a clustering of one cluster is left out."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for v, c in map(_arrays, batches):
            size = (v * v).sum(axis=1)
            for i in range(c.shape[1]):
                for j in np.unique(c[:, i]):
                    mine = c[:, i] == j
                    part = np.r_[mine.sum(), size[mine].sum(), v[mine].sum(axis=0)]
                    found[i, j] = found[i, j] + part if (i, j) in found else part
        yield _sums_batch(found)

    first = _added_up(rows.mapInArrow(sums, "i int, j int, part array<double>"))
    state: dict[int, tuple] = {}
    for i in sorted({i for i, _ in first}):
        names = sorted(j for a, j in first if a == i)
        parts = np.array([first[i, j] for j in names])
        if len(names) > 1:
            state[i] = np.array(names), parts[:, 0], parts[:, 1], parts[:, 2:] / parts[:, :1]
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for v, c in map(_arrays, batches):
            at = np.arange(len(v))
            for i, (names, n, squares, centres) in shared.value.items():
                own = np.searchsorted(names, c[:, i])
                # mean squared distance to the rows of each cluster, and to its centroid
                mean = (v * v).sum(axis=1)[:, None] + squares / n - 2.0 * (v @ centres.T)
                away = ((v - centres[own]) ** 2).sum(axis=1)
                inner = mean[at, own] * n[own] / np.maximum(n[own] - 1, 1)
                mean[at, own] = np.inf
                outer = mean.min(axis=1)
                value = np.where(n[own] > 1, (outer - inner) / np.maximum(np.maximum(outer, inner), 1e-300), 0.0)
                for k, j in enumerate(names):
                    mine = own == k
                    part = np.array([np.sqrt(away[mine]).sum(), away[mine].sum(), value[mine].sum()])
                    found[i, int(j)] = found[i, int(j)] + part if (i, int(j)) in found else part
        yield _sums_batch(found)

    second = _added_up(rows.mapInArrow(spread, "i int, j int, part array<double>"))
    out = {}
    for i, (names, n, _, centres) in state.items():
        apart, within, value = np.array([second[i, j] for j in names]).T
        k, total = len(names), n.sum()
        grand = (centres * n[:, None]).sum(axis=0) / total
        between = (n * ((centres - grand) ** 2).sum(axis=1)).sum()
        gaps = np.sqrt(((centres[:, None] - centres) ** 2).sum(axis=2))
        mean = apart / n
        ratio = np.divide(mean[:, None] + mean, gaps, out=np.full(gaps.shape, -np.inf), where=gaps > 0)
        worst = [r.max() for r in ratio if np.isfinite(r.max())]
        found = {"k": k, "n": total, "silhouette": value.sum() / total}
        if total > k and within.sum() > 0:
            found["calinski_harabasz"] = between / (k - 1) / (within.sum() / (total - k))
        if worst:
            found["davies_bouldin"] = np.mean(worst)
        out[i] = {name: round(float(x), digits) for name, x in found.items()}
    return out


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(v, c) of a batch as matrices."""
    return tuple(batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0)) for i in (0, 1))


def _sums_batch(found: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    keys = [pa.array([k[side] for k in found], pa.int32()) for side in (0, 1)]
    return pa.RecordBatch.from_arrays([*keys, pa.array(list(found.values()), pa.list_(pa.float64()))], names=["i", "j", "part"])


def _added_up(parts: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    added = parts.groupBy("i", "j").agg(Summarizer.sum(array_to_vector("part")).alias("part"))
    return {(r["i"], r["j"]): r["part"].toArray() for r in added.collect()}  # a row per cluster


def rank_runs(runs: DataFrame, task: str) -> DataFrame:
    """Rank candidates on the task's metric; ties by family order, then name; non-finite or failed runs get no rank.

    ``runs``: candidate, family, status, metrics (map<string,double>), and optionally the ``reason`` of a failure, which stays.
    """
    metric, direction = SELECTION[task]
    score = F.try_element_at("metrics", F.lit(metric))
    usable = (F.col("status") == "completed") & score.isNotNull() & ~F.isnan(score) & (F.abs(score) < F.lit(float("inf")))
    oriented = score if direction == "minimize" else -score
    family = F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family"))
    # runs of one training report: one window over at most a few hundred rows
    order = W.partitionBy("usable").orderBy(oriented, family, "candidate")
    marked = runs.withColumn("usable", F.coalesce(usable, F.lit(False)))
    return marked.select(
        F.when(F.col("usable"), F.row_number().over(order)).alias("rank"),
        "candidate",
        "family",
        F.lit(metric).alias("metric"),
        F.when(F.col("usable"), score).alias("score"),
        F.when(F.col("usable"), "eligible").otherwise("excluded").alias("selection"),
        *([F.coalesce("reason", F.when(~F.col("usable"), f"no finite {metric}")).alias("reason")] if "reason" in runs.columns else []),
    )


def summarise_runs(runs: DataFrame) -> DataFrame:
    """Counts of runs by outcome and the metric names any of them produced."""
    return runs.agg(
        F.count("*").alias("n_runs"),
        F.count_if(F.col("status") == "completed").alias("n_completed"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.array_join(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.map_keys(F.coalesce("metrics", F.create_map().cast("map<string,double>"))))))), ","
        ).alias("metric_names"),
    )
