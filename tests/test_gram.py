"""Linear grids from Gram matrices against fits on the rows themselves."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from conftest import by
from tablegauge.operators import gram, models as K, screens as S


@pytest.fixture(scope="module")
def table():
    rng = random.Random(4)
    rows = []
    for i in range(400):
        a, b = rng.gauss(1e6, 2), rng.gauss(0, 50)  # a large offset must not cost digits
        rows.append((i, a, b, 7.0, 3 * a - 0.2 * b + rng.gauss(0, 1), i % 5))
    return rows


@pytest.fixture(scope="module")
def rows(spark, table):
    df = spark.createDataFrame(table, "row_id long, a double, b double, c double, label double, fold int").repartition(3)
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)


def standardised(x):
    dev = x.std(0)
    return (x - x.mean(0)) / np.where(dev > 0, dev, 1), np.where(dev > 0, dev, 1)


def test_ridge_and_least_squares_on_every_fold(spark, table, rows):
    found = by(gram.cross_validated(spark, gram.grams(rows), [c for c in gram.linear_grid() if c.l1 is None]).withColumn(
        "id", F.concat_ws("/", "candidate", "fold")), "id")
    assert len(found) == 8 * 5
    t = np.array(table)
    x, y, fold = t[:, 1:4], t[:, 4], t[:, 5]
    for alpha, name in [(0.0, "linear"), (10.0, "ridge_10"), (1000.0, "ridge_1000")]:
        for k in range(5):
            fit, held = fold != k, fold == k
            z, dev = standardised(x[fit])
            w = np.linalg.pinv(z.T @ z + alpha * np.eye(3)) @ z.T @ (y[fit] - y[fit].mean()) / dev
            gap = y[held] - (y[fit].mean() + (x[held] - x[fit].mean(0)) @ w)
            got = found[f"{name}/{k}"]
            assert got["n"] == held.sum()
            assert got["rmse"] == pytest.approx(math.sqrt((gap**2).mean()), rel=1e-6)
            assert got["r2"] == pytest.approx(1 - (gap**2).mean() / y[held].var(), abs=1e-6)


@pytest.mark.parametrize("alpha, l1", [(0.01, 1.0), (0.5, 1.0), (0.1, 0.5), (50.0, 1.0)])
def test_elastic_net_meets_its_conditions(table, rows, alpha, l1):
    found = gram.grams(rows)
    intercept, w = gram.coefficients(found, gram.LinearCandidate("x", alpha, l1))
    t = np.array(table)
    z, dev = standardised(t[:, 1:4])
    b = w * dev
    slope = z.T @ (t[:, 4] - t[:, 4].mean() - z @ b) / len(t) - alpha * (1 - l1) * b
    for j in range(2):
        if abs(b[j]) > 1e-12:
            assert slope[j] == pytest.approx(alpha * l1 * np.sign(b[j]), abs=1e-6)
        else:
            assert abs(slope[j]) <= alpha * l1 + 1e-6
    assert w[2] == 0 and intercept == pytest.approx(t[:, 4].mean() - t[:, 1:4].mean(0) @ w, rel=1e-9)


def test_one_scan_whatever_the_grid(spark, rows):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("grams", "")
    found = gram.grams(rows)
    jobs = len(tracker.getJobIdsForGroup("grams"))
    gram.cross_validated(spark, found, gram.linear_grid() * 10)
    assert len(tracker.getJobIdsForGroup("grams")) == jobs
    spark.sparkContext.setJobGroup("", "")


def test_sweep_ranks_grid_and_fitted_candidates(rows):
    broken = K.Candidate("broken", "tree_based", LinearRegression(featuresCol="absent"))
    again = K.Candidate("refit", "linear", LinearRegression())
    ranked = by(gram.sweep_cross_validated(rows, S.REGRESSION, [broken, again]), "candidate")
    assert len(ranked) == 24 and sorted(r["rank"] for r in ranked.values() if r["rank"]) == list(range(1, 24))
    assert ranked["broken"]["rank"] is None and "absent" in ranked["broken"]["reason"]
    # the fitted one stops a little early, as one column is offset by a million
    assert ranked["refit"]["mean"] == pytest.approx(ranked["linear"]["mean"], rel=1e-4)
    assert ranked["lasso_10"]["rank"] > ranked["linear"]["rank"] and ranked["linear"]["folds"] == 5


def test_odd_rows(spark, rows):
    odd = rows.union(rows.limit(1).withColumn("label", F.lit(None).cast("double"))).union(
        rows.limit(1).withColumn("label", F.lit(math.nan))).union(rows.limit(1).withColumn("fold", F.lit(None).cast("int")))
    a, b = gram.grams(odd), gram.grams(rows)
    assert sum(g[0, 0] for g in a.folds.values()) == 400 and np.allclose(a.total[0, 0], b.total[0, 0])
    assert gram.cross_validated(spark, gram.grams(rows.limit(0))).count() == 0
    assert gram.cross_validated(spark, gram.grams(rows.withColumn("fold", F.lit(0)))).count() == 0
    flat = gram.cross_validated(spark, gram.grams(rows.withColumn("label", F.lit(3.0))), [gram.LinearCandidate("linear", 0.0)]).collect()
    assert all(r.rmse == 0 and r.r2 is None for r in flat)
