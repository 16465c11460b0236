"""Gaussian mixtures of a sweep, fitted together: one pass over the rows per round serves all of them.

Each mixture starts from the state that Spark ML draws (a fit of no rounds) and takes the same rounds with the same end: until the log
likelihood moves by no more than the tolerance. In a pass each task adds up, per component, the weight, the sum and the squares of its
rows as matrix products; (components x features squared) numbers per round reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

EPSILON = float(np.finfo(float).eps)
#: Features up to which the squares of a component are added up here (8 bytes x features squared per component and task).
MAX_FEATURES = 256
BLOCK = 1024  # rows of one product


def _density(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, root of the inverse, log of the factor) of a normal density; directions without spread take no part."""
    size, axes = np.linalg.eigh(cov)
    live = size > EPSILON * size.max() * len(size)
    if not live.any():
        raise ValueError("covariance matrix has no spread")
    root = axes[:, live] / np.sqrt(size[live])
    return mean, root, -0.5 * (len(size) * np.log(2 * np.pi) + np.log(size[live]).sum())


def _shares(x: np.ndarray, weights: np.ndarray, densities: list) -> np.ndarray:
    """Weight times density of each component, row by row, never 0."""
    out = np.empty((len(x), len(weights)))
    for j, (mean, root, factor) in enumerate(densities):
        away = (x - mean) @ root
        out[:, j] = EPSILON + weights[j] * np.exp(factor - 0.5 * np.einsum("ij,ij->i", away, away))
    return out


class MixtureModel:
    """A fitted mixture: ``prediction`` is the likeliest component."""

    def __init__(self, weights: np.ndarray, means: np.ndarray, covs: np.ndarray, log_likelihood: float = -np.finfo(float).max,
                 rounds: int = 0, features: str = "features"):
        self.weights, self.means, self.covs, self.features = weights, means, covs, features
        self.log_likelihood, self.rounds = log_likelihood, rounds

    def densities(self) -> list:
        return [_density(m, c) for m, c in zip(self.means, self.covs, strict=True)]

    def transform(self, df: DataFrame) -> DataFrame:
        weights, densities = self.weights, self.densities()

        def likeliest(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype="int32")
            return pd.Series(_shares(np.array(vectors.tolist(), dtype=float), weights, densities).argmax(axis=1).astype(np.int32))

        return df.withColumn("prediction", F.pandas_udf(likeliest, "int")(vector_to_array(self.features)))


def _start(estimator: GaussianMixture, train: DataFrame) -> MixtureModel:
    drawn = estimator.copy({estimator.maxIter: 0}).fit(train)
    parts = drawn.gaussiansDF.collect()  # one row per component
    return MixtureModel(np.array(drawn.weights), np.array([r["mean"].toArray() for r in parts]), np.array([r["cov"].toArray() for r in parts]))


def _sums(rows: DataFrame, models: dict[str, MixtureModel]) -> dict[str, list[np.ndarray]]:
    """Per mixture and component: (log likelihood, weight, sum, squares) over all rows; the first component holds the likelihood."""
    state = rows.sparkSession.sparkContext.broadcast({n: (m.weights, m.densities()) for n, m in models.items()})

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for at in range(0, len(whole), BLOCK):
                x = whole[at:at + BLOCK]
                for name, (weights, densities) in state.value.items():
                    p = _shares(x, weights, densities)
                    total = p.sum(axis=1)
                    p /= total[:, None]
                    for j in range(len(weights)):
                        likelihood = np.log(total).sum() if j == 0 else 0.0
                        squares = (x * p[:, j, None]).T @ x
                        part = np.concatenate([[likelihood, p[:, j].sum()], p[:, j] @ x, squares[np.triu_indices(len(squares))]])
                        sums[name, j] = sums[name, j] + part if (name, j) in sums else part
        yield pa.RecordBatch.from_arrays(
            [pa.array([n for n, _ in sums], pa.string()), pa.array([j for _, j in sums], pa.int32()),
             pa.array(list(sums.values()), pa.list_(pa.float64()))], names=["name", "component", "part"])

    def whole(group: pa.Table) -> pa.Table:
        found = sum(c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1).sum(axis=0) for c in group.column("part").chunks if len(c))
        return pa.table({"name": group.column("name")[:1], "component": group.column("component")[:1], "part": pa.array([found.tobytes()], pa.binary())})

    parts = rows.mapInArrow(add_up, "name string, component int, part array<double>")
    found = parts.groupBy("name", "component").applyInArrow(whole, "name string, component int, part binary").collect()  # a row per component
    out: dict[str, list[np.ndarray]] = {}
    for r in sorted(found, key=lambda r: r["component"]):
        out.setdefault(r["name"], []).append(np.frombuffer(r["part"]))
    state.unpersist()
    return out


def _moved(old: MixtureModel, sums: list[np.ndarray]) -> MixtureModel:
    parts, d = np.array(sums), old.means.shape[1]
    weight = parts[:, 1]
    means = parts[:, 2:2 + d] / weight[:, None]
    squares, (a, b) = np.empty((len(parts), d, d)), np.triu_indices(d)
    squares[:, a, b] = squares[:, b, a] = parts[:, 2 + d:]
    covs = squares / weight[:, None, None] - means[:, :, None] * means[:, None, :]
    return MixtureModel(weight / weight.sum(), means, covs, float(parts[0, 0]), old.rounds + 1)


def fit_together(train: DataFrame, estimators: dict[str, GaussianMixture]) -> dict[str, MixtureModel | Exception]:
    """Each mixture fitted on all rows of ``train`` (``features``), or the error that ended it."""
    # each part sends the sums of all components every round
    rows = train.select(vector_to_array("features").alias("x")).coalesce(max(1, train.sparkSession.sparkContext.defaultParallelism)).persist()
    out: dict[str, MixtureModel | Exception] = {}
    before: dict[str, float] = {}
    try:
        for name, estimator in estimators.items():
            try:
                out[name], before[name] = _start(estimator, train), 0.0
            except Exception as error:  # of this mixture alone
                out[name] = error
        while True:
            open_ = {n: m for n, m in out.items() if isinstance(m, MixtureModel) and m.rounds < estimators[n].getMaxIter()
                     and abs(m.log_likelihood - before[n]) > estimators[n].getTol()}
            for name in list(open_):
                try:
                    open_[name].densities()
                except ValueError as error:
                    out[name] = error
                    del open_[name]
            if not open_:
                return out
            for name, sums in _sums(rows, open_).items():
                before[name], out[name] = open_[name].log_likelihood, _moved(open_[name], sums)
    finally:
        rows.unpersist()


def taken(estimators: dict[str, object], width: int) -> dict[str, GaussianMixture]:
    """The mixtures of a sweep that are worth a common pass."""
    found = {n: e for n, e in estimators.items() if isinstance(e, GaussianMixture) and not e.isSet("weightCol")}
    return found if len(found) > 1 and width <= MAX_FEATURES else {}
