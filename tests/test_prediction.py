"""Saved models on raw rows: what is fitted, saved, loaded and predicted must be one thing."""

import random

import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from conftest import by
from tablegauge.operators import models as K, screens as S
from tablegauge.plans import prediction as P
from tablegauge.sources import artefacts


@pytest.fixture(scope="module")
def prices(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        x1, x2, south = rng.gauss(50, 15), rng.uniform(0, 100), rng.random() < 0.5
        rows.append((i, x1, float("nan") if i % 11 == 0 else x2, None if i % 13 == 0 else "it's \\ south" if south else "north",
                     2 * x1 + 0.5 * x2 + 8 * south + rng.gauss(0, 0.5), "high" if x1 > 50 else "low"))
    return spark.createDataFrame(rows, "row_id long, `feat.x1` double, x2 double, region string, price double, class string")


def linear(prices, **named):
    candidate = K.Candidate("linear_regression", "linear", LinearRegression())
    return P.refit(prices, "price", S.REGRESSION, candidate, ["feat.x1", "x2"], ["region"], **named)


def test_round_trip_in_a_new_session(spark, prices, folder):
    fitted = linear(prices)
    P.save(fitted, folder, "m", {"rmse": 1.5})
    # a fresh session shares nothing but the folder
    other = spark.newSession()
    loaded, about = P.load(other, folder, "m")
    assert about["features"] == ["feat.x1", "x2", "region"] and about["target"] == "price" and about["metrics"] == '{"rmse": 1.5}'
    assert about["settings"]["max_categories"] == 30 and loaded.max_categories == 30
    raw = prices.drop("price")
    here, there = (by(P.predict(f, raw).rows, "row_id") for f in (fitted, loaded))
    assert here.keys() == there.keys() and len(here) == 300
    assert all(here[k]["predicted"] == there[k]["predicted"] for k in here)
    assert P.predict(fitted, raw).rows.columns == [*raw.columns, "predicted"]
    gaps = [abs(r["predicted"] - prices_[r["row_id"]]) for prices_ in [{r.row_id: r.price for r in prices.collect()}] for r in here.values()
            if r["row_id"] % 11 and r["row_id"] % 13]
    assert sum(gaps) / len(gaps) < 3


def test_missing_columns_are_reported(spark, prices, folder):
    P.save(linear(prices), folder, "m")
    found = P.predict_saved(spark, folder, "m", prices.select("row_id", "x2"))
    assert found.rows is None and sorted(map(tuple, found.missing.collect())) == [("feat.x1", 0), ("region", 2)]
    assert P.predict_saved(spark, folder, "m", prices).missing.isEmpty()
    with pytest.raises(KeyError):
        P.load(spark, folder, "other")
    with pytest.raises(Exception, match="already exists|exists"):
        P.save(linear(prices), folder, "m")
    assert artefacts.list_models(spark, folder).count() == 1


def test_unseen_values_and_clashing_names(spark, prices):
    fitted = linear(prices)
    odd = spark.createDataFrame(
        [(None, 1.0, 2.0, "never seen", 9.0, "p"), (1, None, None, None, None, None)],
        "row_id long, `feat.x1` double, x2 double, region string, prediction double, predicted2 string").withColumn("features", F.lit("mine"))
    rows = P.predict(fitted, odd).rows.collect()
    assert len(rows) == 2 and all(r.predicted is not None and r.features == "mine" for r in rows)
    assert {r.prediction for r in rows} == {9.0, None}
    assert P.predict(fitted, odd.limit(0)).rows.count() == 0


def test_classes_come_back_as_their_names(spark, prices, folder):
    tree = K.Candidate("decision_tree", "tree_based", DecisionTreeClassifier(maxDepth=3))
    P.save(P.refit(prices, "class", S.BINARY, tree, ["feat.x1", "x2"], ["region"]), folder, "c")
    rows = P.predict_saved(spark, folder, "c", prices.drop("class")).rows.collect()
    wanted = {r.row_id: r["class"] for r in prices.collect()}
    assert sum(r.predicted == wanted[r.row_id] for r in rows) > 290
    assert all(0 <= r.probability_1 <= 1 and (r.probability_1 > 0.5) == (r.predicted == "low") for r in rows)


def test_neighbours_and_log_targets_are_saved_whole(spark, prices, folder):
    near = K.Candidate("knn", "distance_based", None, k=3)
    fitted = P.refit(prices, "price", S.REGRESSION, near, ["feat.x1", "x2"], [], key="row_id", log_target=True)
    P.save(fitted, folder, "k")
    rows = by(P.predict_saved(spark, folder, "k", prices.drop("price"), key="row_id").rows, "row_id")
    wanted = {r.row_id: r.price for r in prices.collect()}
    assert len(rows) == 300 and sum(abs(rows[k]["predicted"] - wanted[k]) < 25 for k in wanted) > 250
    logged = linear(prices, log_target=True)
    assert P.predict(logged, prices).rows.agg(F.avg("predicted")).first()[0] == pytest.approx(prices.agg(F.avg("price")).first()[0], rel=0.1)


def test_train_and_save_keeps_the_winner(spark, prices, folder):
    data = prices.drop("class").withColumnRenamed("feat.x1", "x1").na.drop()
    result, fitted = P.train_and_save(data, "price", "row_id", folder, "best", families=["linear", "tree_based"])
    assert result.status == "completed" and fitted.candidate == result.ranking.where("rank = 1").first()["candidate"]
    assert artefacts.load_model(spark, folder, "best")[1]["settings"]["candidate"] == fitted.candidate
    flat = data.withColumn("price", F.lit("same"))
    result, fitted = P.train_and_save(flat, "price", "row_id", folder, "none")
    assert result.status == "blocked" and fitted is None and artefacts.list_models(spark, folder).count() == 1
