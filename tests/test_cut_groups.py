"""Groups of points in few dimensions: a row is compared with the cuts on its way, not with all groups."""

import numpy as np

from tablegauge.operators import neighbours as N


def test_cuts_reach_all_groups_in_the_limit():
    rng = np.random.default_rng(3)
    points = np.column_stack([rng.exponential(1, 4000), rng.integers(0, 3, 4000), rng.normal(size=4000)])
    cuts = N._Cuts(points[:900], 60)
    group = cuts.assign(points)
    assert 50 <= cuts.groups <= 60 and set(group) == set(range(cuts.groups)) and np.bincount(group).max() < 400
    known = np.unique(group)
    low, high = (np.array([f(points[group == g], axis=0) for g in known]) for f in (np.min, np.max))
    cuts.boxes(known, low, high)
    for metric in ("euclidean", "chebyshev"):
        limit = rng.uniform(0, 0.5, 200)
        row, found = cuts.near(points[:200], limit, metric)
        for i in range(200):
            away = N._box_distance(points[i:i + 1], low, high, metric)[0]
            assert sorted(found[row == i]) == known[away <= limit[i]].tolist()


def test_no_row_is_compared_with_all_groups(spark, monkeypatch):
    """Few dimensions: neither points nor queries are held against centres."""
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=(900, 2)), np.zeros((60, 2))])
    data = spark.createDataFrame([(i, x.tolist(), float(i)) for i, x in enumerate(v)], "pid long, v array<double>, payload double")
    for name in ("_own_centre", "_near_balls"):
        monkeypatch.setattr(N, name, None)
    found = N.nearest(data.selectExpr("pid AS qid", "v"), data, 3, "chebyshev", centres=25, block=40).collect()
    assert len(found) == len(v)
    for r in found:
        away = np.abs(v[r["qid"]] - v).max(axis=1)
        assert [s["pid"] for s in r["neighbours"]] == np.lexsort((np.arange(len(v)), away))[:3].tolist() and r["v"] == v[r["qid"]].tolist()


def test_copies_of_one_point_are_one_group():
    cuts = N._Cuts(np.zeros((5, 2)), 4)  # copies of one point
    assert cuts.groups == 1 and cuts.assign(np.ones((2, 2))).tolist() == [0, 0]
    cuts.boxes(np.array([0]), np.zeros((1, 2)), np.zeros((1, 2)))
    assert cuts.near(np.ones((2, 2)), np.array([1.5, np.inf]), "chebyshev")[1].tolist() == [0, 0]
