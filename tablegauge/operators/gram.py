"""Linear models of a whole grid, cross validated from one scan.

What least squares, ridge, lasso and elastic net need of the rows is the Gram matrix of (1, features, label). Each task adds
up one matrix per fold; the matrices of all folds are one small table (folds x features squared). The training rows of a
fold are the total minus the fold's own matrix, and its held-out error is a quadratic form of that matrix, so every
candidate of every fold is solved without touching the rows again.

Penalties are on the scale of standardised features (mean 0, population deviation 1 in the training rows, which are
standardised anew for each fold): ridge minimises ``|y - b0 - Zb|^2 + a |b|^2``, the others
``|y - b0 - Zb|^2 / (2 n) + a r |b|_1 + a (1 - r) |b|^2 / 2``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tablegauge.operators import metrics as M, models as K

#: Features of a Gram matrix; a task holds one matrix per fold.
MAX_FEATURES = 4000


@dataclass
class LinearCandidate:
    """``ridge`` with penalty ``alpha`` (0: least squares), or an elastic net with ``l1`` share of the penalty."""

    name: str
    alpha: float
    l1: float | None = None


def linear_grid() -> list[LinearCandidate]:
    """Least squares and the fixed penalties of the linear family."""
    return [
        LinearCandidate("linear", 0.0), *[LinearCandidate(f"ridge_{a:g}", a) for a in K.RIDGE],
        *[LinearCandidate(f"lasso_{a:g}", a, 1.0) for a in K.LASSO], *[LinearCandidate(f"elastic_{a:g}_{r:g}", a, r) for a, r in K.ELASTIC],
    ]


@dataclass
class Grams:
    """Matrices of (1, features - shift, label - shift) by fold; ``shift`` keeps large offsets out of the sums."""

    folds: dict[int, np.ndarray]
    shift: np.ndarray

    @property
    def total(self) -> np.ndarray:
        return sum(self.folds.values())


def grams(df: DataFrame, features: str = "features", label: str = "label", fold: str = "fold") -> Grams:
    """One scan; rows without features, label or fold, or with a value that is not finite, take no part."""
    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"))
    rows = rows.where("x is not null and y is not null and fold is not null")
    first = rows.first()
    if first is None:
        return Grams({}, np.zeros(0))
    shift = np.nan_to_num(np.array([*first["x"], first["y"]]), posinf=0.0, neginf=0.0)
    width = len(shift)
    if width > MAX_FEATURES:
        raise ValueError(f"{width} columns exceed the {MAX_FEATURES} of one matrix; select features first")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width - 1)
            z = np.column_stack([x, batch.column(1).to_numpy(zero_copy_only=False)]) - shift
            z = np.column_stack([np.ones(len(z)), z])
            own, usable = batch.column(2).to_numpy(zero_copy_only=False), np.isfinite(z).all(1)
            for k in np.unique(own[usable]).tolist():
                part = z[usable & (own == k)]
                sums[k] = sums.get(k, 0) + part.T @ part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([round(g[0, 0]) for g in sums.values()], pa.int64()),
             pa.array([g.ravel() for g in sums.values()], pa.list_(pa.float64()))], names=["fold", "n", "gram"])

    parts = rows.mapInArrow(add_up, "fold int, n long, gram array<double>").select("fold", "n", array_to_vector("gram").alias("gram"))
    found = parts.groupBy("fold").agg(F.sum("n").alias("n"), Summarizer.sum(F.col("gram")).alias("gram")).collect()  # one row per fold
    folds = {r["fold"]: r["gram"].toArray().reshape(width + 1, width + 1) for r in found}
    for r in found:
        folds[r["fold"]][0, 0] = r["n"]  # the summarizer adds up by running means, which leaves a count a little beside a whole number
    return Grams(folds, shift)


def _standardised(gram: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray, np.ndarray]:
    """(n, feature means, label mean, deviations, Z'Z, Z'y) of the rows behind a matrix; a constant feature has deviation 0."""
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    scatter = gram[1:, 1:] - n * np.outer(mean, mean)
    size = np.sqrt(np.maximum(np.diag(gram)[1:], 0))  # rounding of a constant column does not count as spread
    dev = np.sqrt(np.maximum(np.diag(scatter), 0) / n)[:-1]
    dev = np.where(dev * np.sqrt(n) > 1e-10 * size[:-1], dev, 0.0)
    by = np.where(dev > 0, dev, np.inf)
    return n, mean[:-1], mean[-1], dev, scatter[:-1, :-1] / np.outer(by, by), scatter[:-1, -1] / by


def solve(gram: np.ndarray, candidate: LinearCandidate, tolerance: float = 1e-12, rounds: int = 20_000) -> np.ndarray:
    """(intercept, weights) on the shifted columns; constant features get 0."""
    n, mean, label_mean, dev, zz, zy = _standardised(gram)
    live = dev > 0
    b = np.zeros(len(dev))
    if live.any():
        a, c = zz[np.ix_(live, live)], zy[live]
        if candidate.l1 is None:
            found = np.linalg.solve(a + candidate.alpha * np.eye(len(c)), c) if candidate.alpha > 0 else np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ c
        else:
            found = _elastic(a / n, c / n, candidate.alpha * candidate.l1, candidate.alpha * (1 - candidate.l1), tolerance, rounds)
        b[live] = found / dev[live]
    return np.concatenate([[label_mean - mean @ b], b])


def _elastic(a: np.ndarray, c: np.ndarray, l1: float, l2: float, tolerance: float, rounds: int) -> np.ndarray:
    """Coordinate descent on the normal equations."""
    b, gap, scale = np.zeros(len(c)), c.copy(), max(1e-300, float(np.abs(c).max()))
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(c)):
            pull = gap[j] + a[j, j] * b[j]
            new = np.sign(pull) * max(abs(pull) - l1, 0.0) / (a[j, j] + l2)
            if new != b[j]:
                gap -= a[j] * (new - b[j])
                moved, b[j] = max(moved, abs(new - b[j])), new
        if moved <= tolerance * scale:
            break
    return b


def errors(gram: np.ndarray, weights: np.ndarray) -> tuple[float, float | None]:
    """(rmse, r2) of a solution on the rows behind a matrix; r2 is None where the label does not vary."""
    u = np.concatenate([-weights, [1.0]])
    n, spread = gram[0, 0], gram[-1, -1] - gram[0, -1] ** 2 / gram[0, 0]
    squares = max(0.0, float(u @ gram @ u))
    return float(np.sqrt(squares / n)), 1 - squares / float(spread) if spread > 1e-12 * gram[-1, -1] else None


def cross_validated(spark: SparkSession, found: Grams, candidates: list[LinearCandidate] | None = None) -> DataFrame:
    """``candidate, fold, n, rmse, r2``: each candidate solved without a fold and scored on it. With one fold there is none."""
    total, rows = found.total if found.folds else None, []
    for fold, own in sorted(found.folds.items()):
        rest = total - own
        if rest[0, 0] < 1:
            continue
        for c in candidates or linear_grid():
            rmse, r2 = errors(own, solve(rest, c))
            rows.append((c.name, fold, int(own[0, 0]), rmse, r2))
    return spark.createDataFrame(rows, "candidate string, fold int, n long, rmse double, r2 double")


def coefficients(found: Grams, candidate: LinearCandidate) -> tuple[float, np.ndarray]:
    """(intercept, weights) of the candidate on all rows, for the features as they are."""
    weights = solve(found.total, candidate)
    return float(weights[0] - weights[1:] @ found.shift[:-1] + found.shift[-1]), weights[1:]


def rank_cross_validated(scores: DataFrame, task: str) -> DataFrame:
    """``rank, candidate, family, metric, folds, mean, std, reason`` of rows as ``models.cross_validate`` gives them, best mean first; ties by
    family order, then name. Candidates without a finite mean have no rank and keep their reason."""
    _, direction = M.SELECTION[task]
    usable = F.col("mean").isNotNull() & ~F.isnan("mean") & (F.abs("mean") < F.lit(float("inf")))
    family = F.array_position(F.array(*map(F.lit, M.FAMILIES)), F.col("family"))
    marked = scores.withColumn("usable", F.coalesce(usable, F.lit(False)))
    # a row per candidate of a sweep
    order = W.partitionBy("usable").orderBy(F.col("mean") if direction == "minimize" else -F.col("mean"), family, "candidate")
    reason = F.col("reason") if "reason" in scores.columns else F.lit(None).cast("string")
    return marked.select(F.when(F.col("usable"), F.row_number().over(order)).alias("rank"), "candidate", "family", "metric", "folds", "mean", "std",
                         reason.alias("reason"))


def sweep_cross_validated(df: DataFrame, task: str, candidates: list[K.Candidate], linear: list[LinearCandidate] | None = None,
                          parallelism: int = 4) -> DataFrame:
    """Ranking of a regression sweep by cross validation over column ``fold``: the linear grid from one scan, other candidates
    (without those the grid holds) by fitting each fold."""
    linear = linear_grid() if linear is None else linear
    solved = cross_validated(df.sparkSession, grams(df), linear).groupBy("candidate").agg(
        F.lit("linear").alias("family"), F.lit("rmse").alias("metric"), F.count("rmse").alias("folds"), F.avg("rmse").alias("mean"),
        F.stddev_pop("rmse").alias("std"), F.lit(None).cast("string").alias("reason"))
    names = {c.name for c in linear}
    others = [c for c in candidates if c.name not in names]
    if others:
        solved = solved.unionByName(K.cross_validate(df, task, others, df.select(F.max("fold")).first()[0] + 1, parallelism))
    return rank_cross_validated(solved, task)
