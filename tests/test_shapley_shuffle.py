"""Sampled Shapley values: rows meet by position before they are scored, and not again behind that."""

import random

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from conftest import by
from tablegauge.operators import explain as E


def test_scored_rows_are_not_shuffled(spark, frame, monkeypatch):
    rng = random.Random(4)
    df = frame("row_id long, a double, b double", [(i, rng.gauss(0, 1), rng.gauss(0, 2)) for i in range(200)])
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df.withColumn("label", 3 * F.col("a") - F.col("b")))
    model = LinearRegression().fit(df)
    seen, ranked = [], E._rank_shapley
    monkeypatch.setattr(E, "_rank_shapley", lambda rows: seen.append(rows) or ranked(rows))
    found = by(E.sampled_shapley(model, df, ["a", "b"], "row_id"), "feature")
    # of a linear model, the value of a feature is its weight times the mean distance from its donors, whatever the order
    pairs = E.with_donors(df, "row_id", 8).select("pos", F.explode(F.array(*[
        F.struct(F.lit(n).alias("f"), (w * (F.get("v", F.lit(i)) - F.get("donor", F.lit(i)))).alias("g"))
        for i, (n, w) in enumerate(zip("ab", model.coefficients, strict=True))])).alias("s"))
    wanted = by(pairs.groupBy("pos", "s.f").agg(F.avg("s.g").alias("g")).groupBy("f").agg(F.avg(F.abs("g")).alias("g")), "f")
    assert {f: round(r["g"], 4) for f, r in wanted.items()} == {f: round(r["mean_abs_shapley"], 4) for f, r in found.items()}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        E.sampled_shapley(model, df, ["a", "b"], "row_id")
        plan = seen[-1]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # donors, rows, and the few sums of the features
    assert sum("Exchange hashpartitioning" in line for line in plan.splitlines()) == 3
