"""Random search: which draws are made, how they advance, and what each row says."""

import json
import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from conftest import by
from tablegauge.operators import screens as S, tuning as T


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(450):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        data.append((i, a, b, float(a * a + b > 0.7), 2 * a - b + rng.gauss(0, 0.1), i % 5))
    df = spark.createDataFrame(data, "row_id long, a double, b double, y double, z double, fold int")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)


def labelled(rows, label):
    return rows.select("row_id", "features", F.col(label).alias("label"), "fold")


def test_draws_are_distinct_and_repeatable():
    for name, space in T.SPACES.items():
        draws = T.draw(name)
        assert draws == T.draw(name) and len({json.dumps(d) for d in draws}) == len(draws)
        assert all(d[k] in space[k] for d in draws for k in space)
        whole = 1
        for values in space.values():
            whole *= len(values)
        assert len(draws) == min(30, whole)
    assert T.draw("random_forest", seed=1) != T.draw("random_forest", seed=2)


def test_halving_and_the_exact_way(spark, rows):
    data = labelled(rows, "y")
    found = T.search(data, S.BINARY, "decision_tree", draws=6, folds=2, rungs=(1 / 3,)).collect()
    assert sorted(r["rank"] for r in found) == list(range(1, 7))
    assert sorted(r.rung for r in found) == [0] * 4 + [1] * 2 and sum(r.status == "completed" for r in found) == 2
    best = next(r for r in found if r["rank"] == 1)
    assert best.folds == 2 and best.share == 1.0
    zeros, ones = (data.where(f"label = {k}").count() for k in (0, 1))
    share = max(zeros, ones) / (zeros + ones)
    assert best["mean"] > share / (1 + share)  # macro F1 of the majority class is half of 2 s / (1 + s)
    exact = by(T.search(data, S.BINARY, "decision_tree", draws=6, folds=2, rungs=()), "candidate")
    assert {r["rung"] for r in exact.values()} == {0} and all(r["folds"] == 2 and r["share"] == 1.0 for r in exact.values())
    # a finalist is scored alike both ways
    assert exact[best.candidate]["mean"] == pytest.approx(best["mean"], abs=1e-9)


def test_linear_spaces_are_solved_whole(rows):
    found = T.search(labelled(rows, "z"), S.REGRESSION, "elastic_net").collect()
    assert len(found) == 30 and all(r.status == "completed" and r.folds == 5 and r.share == 1.0 for r in found)
    best = next(r for r in found if r["rank"] == 1)
    assert json.loads(best.parameters)["alpha"] <= 0.01 and best["mean"] < 0.2


def test_broken_and_late_draws_are_rows(spark, rows, monkeypatch):
    data = labelled(rows, "y")
    slow = T.search(data, S.BINARY, "gradient_boosting", draws=2, folds=1, rungs=(), seconds=0.5).collect()
    assert all(r["rank"] is None and r.status == "failed" and "0.5 seconds" in r.reason and r.seconds < 30 for r in slow)
    monkeypatch.setitem(T.SPACES, "decision_tree", {"maxDepth": [2, 99], "minInstancesPerNode": [1]})
    found = by(T.search(data, S.BINARY, "decision_tree", folds=2, rungs=()), "candidate")
    assert found["decision_tree_0"]["rank"] == 1 and found["decision_tree_1"]["rank"] is None and "maxDepth" in found["decision_tree_1"]["reason"]
    with pytest.raises(ValueError, match="cannot be searched"):
        T.search(data, S.BINARY, "ridge")
    assert "ridge" in T.searchable(S.REGRESSION) and "linear_svc" not in T.searchable(S.MULTICLASS)


def test_random_search_query(spark):
    from tablegauge.queries import models as Q

    found = Q.random_search(spark, "/root/testdata/sf0.001").collect()
    assert len({r.candidate for r in found}) == 30 and sorted(r["rank"] for r in found if r["rank"]) == list(range(1, sum(r["rank"] is not None for r in found) + 1))
    best = next(r for r in found if r["rank"] == 1)
    assert best.folds == 5 and best.share == 1.0 and best.status == "completed"
