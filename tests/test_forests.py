"""Trees grown from cells are Spark ML's, and a search over forests needs no fit of its own per draw."""

import numpy as np
import pytest
from pyspark.ml import classification as KC, regression as KR
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablegauge.operators import forests as O, metrics as M, models as K, screens as S, tuning as T


@pytest.fixture(scope="module")
def rows(spark):
    i = F.col("id")
    digit = lambda salt, n: F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(n)).cast("double")
    df = spark.range(0, 6000, 1, 3).select(i.alias("row_id"), digit(1, 12).alias("a"), digit(2, 20).alias("b"), digit(3, 3).alias("c"), digit(4, 10).alias("noise"))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).cache()


def test_tree_of_classes(rows):
    df = rows.withColumn("label", ((F.col("a") * F.col("b") + 20 * F.col("c") > 80) != (F.col("noise") == 0)).cast("double"))
    df = K.class_weights(df)
    for depth, leaf in ((4, 1), (9, 25)):
        theirs = KC.DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=leaf, weightCol="weight", seed=42)
        mine = K.grown(df, [K.Candidate("tree", "tree_based", theirs)], True)["tree"]
        both = [m.transform(df).select("row_id", "prediction", vector_to_array("probability")[1].alias("p")).orderBy("row_id").toPandas() for m in (mine, theirs.fit(df))]
        assert (both[0].prediction == both[1].prediction).all() and np.allclose(both[0].p, both[1].p)


def test_tree_of_numbers(rows):
    df = rows.withColumn("label", F.col("a") * F.col("b") + 20 * F.col("c") + F.col("noise"))
    theirs = KR.DecisionTreeRegressor(maxDepth=6, minInstancesPerNode=5, seed=42)
    mine = K.grown(df, [K.Candidate("tree", "tree_based", theirs)], False)["tree"]
    both = [m.transform(df).select("row_id", "prediction").orderBy("row_id").toPandas() for m in (mine, theirs.fit(df))]
    assert np.allclose(both[0].prediction, both[1].prediction)


def test_forests_score_as_theirs(rows):
    df = rows.withColumn("label", F.col("a") * F.col("b") + 20 * F.col("c") + F.col("noise"))
    est = KR.RandomForestRegressor(numTrees=30, maxDepth=8, seed=42)
    train, test = df.where("row_id % 4 > 0"), df.where("row_id % 4 = 0")
    rmse = [M.regression_metrics(m.transform(test)).first()["rmse"] for m in (K.grown(train, [K.Candidate("f", "ensemble", est)], False)["f"], est.fit(train))]
    assert rmse[0] == pytest.approx(rmse[1], rel=0.15)


def test_bootstrap_weights():
    w = np.array([O.row_weights(np.arange(50_000), t, 42) for t in range(6)])
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and np.abs(np.corrcoef(w) - np.eye(6)).max() < 0.02


def test_too_many_cells_are_left_to_spark(spark, monkeypatch, rows):
    monkeypatch.setattr(O, "MOST_CELLS", 100)
    df = rows.withColumn("label", (F.col("a") > 5).cast("double"))
    assert K.grown(df, [K.Candidate("f", "ensemble", KC.RandomForestClassifier(numTrees=3, seed=1))], True) == {}
    assert O.Settings.of(KC.RandomForestClassifier(subsamplingRate=0.5)) is None and O.Settings.of(KC.GBTClassifier(subsamplingRate=0.5)) is None and O.Settings.of(KR.GBTRegressor()) is None


def test_a_search_fits_no_draw_alone(monkeypatch, rows):
    df = rows.withColumns({"label": ((F.col("a") * F.col("b") + 20 * F.col("c") > 80) != (F.col("noise") == 0)).cast("double"), "fold": (F.col("row_id") % 5).cast("int")})
    monkeypatch.setattr(K, "fit", lambda *a: 1 / 0)
    found = T.search(df, S.BINARY, "random_forest", draws=9).collect()
    assert len(found) == 9 and sorted(r["rank"] for r in found) == list(range(1, 10))
    assert {r["folds"] for r in found if r["status"] == "completed"} == {5} and max(r["mean"] for r in found) > 0.85


def test_scores_are_those_of_the_metrics(frame):
    rows = frame("label double, prediction double, n int", [(0.0, 0.0, 7), (0.0, 1.0, 2), (1.0, 0.0, 3), (1.0, 1.0, 5), (2.0, 1.0, 1)])
    theirs = M.classification_metrics(rows.select("label", "prediction", F.explode(F.sequence(F.lit(1), "n")))).first()["f1_macro"]
    assert O.f1_macro(np.array([[7, 2, 0, 0], [3, 5, 0, 0], [0, 1, 0, 0], [0, 0, 0, 0]])) == theirs


def test_regressors_of_a_table_are_not_fitted_over_its_rows(monkeypatch, rows):
    """Tree and forest of the candidate list come from one pass over the rows."""
    df = rows.withColumn("label", F.col("a") * F.col("b") + 20 * F.col("c") + F.col("noise")).select("row_id", "features", "label")
    for fitted in (KR.RandomForestRegressor, KR.DecisionTreeRegressor):
        monkeypatch.setattr(fitted, "_fit", lambda *a: 1 / 0)
    candidates = [c for c in K.baselines(S.REGRESSION, 3) if c.family in ("tree_based", "ensemble")]
    runs, models = K.train_candidates(df.where("row_id % 4 > 0"), df.where("row_id % 4 = 0"), S.REGRESSION, candidates)
    found = {r["candidate"]: r for r in runs.collect()}
    assert {r["status"] for r in found.values()} == {"completed"} and set(models) == {"decision_tree", "random_forest"}
    assert found["decision_tree"]["metrics"]["r2"] > 0.98 and found["random_forest"]["metrics"]["r2"] > 0.9


def test_boosted_trees(rows):
    df = K.class_weights(rows.withColumn("label", ((F.col("a") * F.col("b") + 20 * F.col("c") > 80) != (F.col("noise") == 0)).cast("double")))
    theirs = KC.GBTClassifier(maxIter=12, stepSize=0.1, maxDepth=3, seed=42, weightCol="weight")
    mine = K.grown(df, [K.Candidate("boost", "ensemble", theirs)], True)["boost"]
    both = [m.transform(df).select("row_id", "prediction", vector_to_array("probability")[1].alias("p")).orderBy("row_id").toPandas() for m in (mine, theirs.fit(df))]
    assert (both[0].prediction == both[1].prediction).all() and np.allclose(both[0].p, both[1].p)


def test_neighbours_of_a_sweep_are_searched_once(monkeypatch, rows):
    df = rows.where("row_id < 900").withColumn("label", (F.col("a") > 5).cast("double")).select("row_id", "features", "label")
    train, test = df.where("row_id % 4 > 0"), df.where("row_id % 4 = 0")
    calls, nearest = [], K.N.nearest
    monkeypatch.setattr(K.N, "nearest", lambda *a, **k: calls.append(a) or nearest(*a, **k))
    runs, models = K.train_candidates(train, test, S.BINARY, [K.Candidate(f"knn_{k}", "distance_based", None, k) for k in (2, 5, 9)])
    assert len(calls) == 1
    for r in runs.collect():
        alone = K.NeighbourModel(train, int(r["candidate"][4:]), True)
        assert models[r["candidate"]].found is None and r["metrics"]["f1_macro"] == M.classification_metrics(alone.transform(test)).first()["f1_macro"]
