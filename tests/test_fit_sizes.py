"""Fits over tables of one file, and neighbours among points of which most dimensions are flags."""

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablegauge.operators import models as K, neighbours as N, screens as S


def flagged(rng, n):
    """One wide number, twelve months and two groups of flags, as a preprocessor gives them."""
    flags = [np.eye(width)[rng.integers(0, width, n)] for width in (3, 5)]
    return np.column_stack([rng.uniform(-1.7, 1.7, n), rng.integers(1, 13, n) / 3.45, *flags])


def test_flags_part_the_points():
    rng = np.random.default_rng(5)
    points, queries, ids = flagged(rng, 6000), flagged(rng, 400), rng.permutation(6000)
    found = N._nearest_in_leaves(queries, points, ids, 5, "euclidean", np.full(400, np.inf), N.READ)
    row, point, distance = found  # None if more than a quarter of the leaves were read
    away = np.sqrt(((queries[:, None] - points) ** 2).sum(axis=2))
    assert row.tolist() == np.repeat(np.arange(400), 5).tolist()
    assert np.array_equal(ids[point].reshape(400, 5), ids[np.array([np.lexsort((ids, d))[:5] for d in away])])
    assert np.allclose(distance.reshape(400, 5), np.sort(away, axis=1)[:, :5])


def test_round_clouds_are_left_to_products():
    rng = np.random.default_rng(6)
    points = rng.normal(size=(3000, 40))
    assert N._nearest_in_leaves(points[:300], points, np.arange(3000), 5, "euclidean", np.full(300, np.inf), N.READ) is None


def test_nearest_over_many_centres(spark):
    rng = np.random.default_rng(7)
    v = np.concatenate([flagged(rng, 900), flagged(rng, 100).repeat(3, axis=0)])
    data = spark.createDataFrame([(i, x.tolist(), float(i)) for i, x in enumerate(v)], "pid long, v array<double>, payload double")
    found = N.nearest(data.select(F.col("pid").alias("qid"), "v"), data, 4, centres=30).collect()
    assert len(found) == len(v)
    for r in found:
        away = np.sqrt(((v[r["qid"]] - v) ** 2).sum(axis=1))
        assert [s["pid"] for s in r["neighbours"]] == np.lexsort((np.arange(len(v)), away))[:4].tolist()


def test_rows_of_one_file_are_dealt(spark):
    rows = spark.range(0, 90_000, 1, 1).select(F.col("id").alias("row_id"), array_to_vector(F.array(F.col("id").cast("double"))).alias("features"),
                                               (F.col("id") % 7).cast("double").alias("label"))
    seen = []

    class Fit:
        def hasParam(self, name):
            return False

        def fit(self, train):
            seen.append(train.rdd.getNumPartitions())
            raise ValueError("seen")

    K.train_candidates(rows, rows.limit(10), S.REGRESSION, [K.Candidate("seen", "linear", Fit())])
    assert seen == [3]  # 40,000 numbers a part, from one part before
