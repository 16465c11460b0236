"""The search inside a task: leaves in few dimensions, matrix products in many, both equal to all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablegauge.operators import neighbours as N


def all_pairs(queries, points, ids, k, metric):
    d = N._distance(queries, points, metric)
    return [(i, ids[j], d[i, j]) for i in range(len(queries)) for j in np.lexsort((ids, d[i]))[:k]]


@pytest.mark.parametrize("dim, metric", [(1, "chebyshev"), (2, "chebyshev"), (2, "euclidean"), (5, "euclidean"), (64, "euclidean"), (64, "chebyshev")])
def test_local_search(dim, metric):
    rng = np.random.default_rng(dim)
    for n in (3, 50, 700):
        points = rng.normal(size=(n, dim)).round(1 if dim < 9 else 6)  # coarse values: many equal distances
        queries, ids = np.r_[points[:40], rng.normal(size=(60, dim)).round(1)], rng.permutation(n) + 5
        row, point, distance = N._local_nearest(queries, points, ids, 4, metric, np.full(len(queries), np.inf))
        assert list(zip(row, ids[point], distance, strict=True)) == all_pairs(queries, points, ids, 4, metric)


def test_work_of_a_point_does_not_grow(spark, monkeypatch):
    """Numbers compared per point: about the same in a table of four times the rows."""
    used = []
    monkeypatch.setattr(N, "_distance", lambda a, b, m, of=N._distance: used.append(len(a) * len(b)) or of(a, b, m))
    for n in (5_000, 20_000):
        points = np.random.default_rng(1).normal(size=(n, 2))
        used.append(-1)
        N._local_nearest(points, points, np.arange(n), 4, "chebyshev", np.full(n, np.inf))
    at = used.index(-1, 1)
    assert sum(used[1:at]) / 5_000 < 1_000 and sum(used[at + 1:]) / 20_000 < 1.3 * sum(used[1:at]) / 5_000


def test_few_visits_of_a_wide_table(spark):
    """Vectors of many dimensions: groups hold thousands of points, so a query is not sent to one group per hundred."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist(), float(i)) for i in range(3_000)]
    data = spark.createDataFrame(rows, "pid long, v array<double>, payload double")
    asked = data.where("pid < 30").select(F.col("pid").alias("qid"), "v")
    points = np.array([r[1] for r in rows])
    wanted = {i: p for i, *p in [(r, *[x for x in all_pairs(points[r:r + 1], points, np.arange(3_000), 3, "euclidean")]) for r in range(30)]}
    found = {r.qid: r.neighbours for r in N.nearest(asked, data, 3).collect()}
    assert {q: [(0, x.pid, x.distance) for x in found[q]] for q in found} == wanted
    many = {r.qid: r.neighbours for r in N.nearest(asked, data, 3, centres=40, block=50, chunk=7).collect()}
    assert many == found
