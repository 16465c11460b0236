"""Mixtures fitted together are those that Spark ML fits one by one."""

import numpy as np
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablegauge.operators import mixtures as X, models as K, screens as S


def rows_of(spark, n=600):
    rng = np.random.default_rng(11)
    v = np.concatenate([rng.normal(m, 0.6, (n // 3, 4)) for m in (0.0, 1.5, 4.0)])
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row_id long, v array<double>").select(
        "row_id", array_to_vector("v").alias("features")).repartition(3, "row_id").sortWithinPartitions("row_id").persist()


def test_same_as_one_by_one(spark):
    rows = rows_of(spark)
    made = {f"k{k}": GaussianMixture(k=k, seed=42, maxIter=m) for k, m in ((2, 100), (3, 100), (4, 7))}
    found = X.fit_together(rows, made)
    for name, estimator in made.items():
        alone, own = estimator.fit(rows), found[name]
        assert own.rounds == alone.summary.numIter
        assert np.isclose(own.log_likelihood, alone.summary.logLikelihood, rtol=1e-9)
        assert np.allclose(own.weights, alone.weights, atol=1e-7)
        assert np.allclose(own.means, [r["mean"].toArray() for r in alone.gaussiansDF.collect()], atol=1e-6)
        both = alone.transform(rows).select("row_id", F.col("prediction").alias("p")).join(own.transform(rows), "row_id")
        assert both.where("p <> prediction").count() == 0


def test_one_pass_for_all(spark, monkeypatch):
    passes = []
    sums = X._sums
    monkeypatch.setattr(X, "_sums", lambda rows, models: passes.append(sorted(models)) or sums(rows, models))
    grid = [c for c in K.sweep_candidates(S.CLUSTERING, 0, 0) if c.name in ("mixture_k2", "mixture_k3", "kmeans_k3")]
    runs, models = K.train_candidates(rows_of(spark, 300), None, S.CLUSTERING, grid)
    assert {r.candidate: r.status for r in runs.collect()} == dict.fromkeys(["mixture_k2", "mixture_k3", "kmeans_k3"], "completed")
    assert passes[0] == ["mixture_k2", "mixture_k3"] and len(passes) == max(models[f"mixture_k{k}"].rounds for k in (2, 3))
