"""Planted-signal tests for models, explanations, versions and the composed runs."""

import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from conftest import by, one
from tablegauge.operators import cleaning as K, explain as E, metrics as M, models, screens as S, versions as V
from tablegauge.plans import cleaning_run, modeling_run
from tablegauge.sources import artefacts, readers, registry as R


@pytest.fixture(scope="module")
def prices(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        x1, x2, south = rng.gauss(0, 3), rng.gauss(0, 3), rng.random() < 0.5
        rows.append((i, x1, x2, "south" if south else "north", 2 * x1 + 0.5 * x2 + 8 * south + rng.gauss(0, 0.5)))
    return spark.createDataFrame(rows, "row_id long, feat_x1 double, feat_x2 double, region string, price double")


def test_modeling_run_regression(spark, prices):
    result = modeling_run.model_table(prices, "price", "row_id", families=["linear", "tree_based"])
    assert result.status == "completed" and result.task == S.REGRESSION
    best = result.ranking.where("rank = 1").first()
    assert best["candidate"] == "linear_regression" and best["score"] < 1.0
    assert one(result.summary)["n_completed"] == 2


def test_modeling_run_blocks_a_constant_target(spark, prices):
    flat = prices.withColumn("price", F.lit("same"))
    assert modeling_run.model_table(flat, "price", "row_id").status == "blocked"


def test_failed_candidate_is_a_row(spark, prices):
    rows = VectorAssembler(inputCols=["feat_x1"], outputCol="features").transform(prices).select(
        "row_id", "features", F.col("price").alias("label"))
    broken = models.Candidate("broken", "linear", LinearRegression(featuresCol="absent"))
    fine = models.Candidate("fine", "linear", LinearRegression())
    runs, fitted = models.train_candidates(rows, rows, S.REGRESSION, [broken, fine])
    status = {r["candidate"]: r["status"] for r in runs.collect()}
    assert status == {"broken": "failed", "fine": "completed"} and list(fitted) == ["fine"]


def test_sweep_lists_are_complete():
    assert len(models.sweep_candidates(S.REGRESSION, 100, 3)) == 69
    assert len({c.name for c in models.sweep_candidates(S.BINARY, 100, 3)}) == len(models.sweep_candidates(S.BINARY, 100, 3))
    assert [c.name for c in models.random_search(S.BINARY, 100)] == [c.name for c in models.random_search(S.BINARY, 100)]
    assert models.families(S.BINARY, 2000, 25, True)[-1] == "neural"
    assert "distance_based" not in models.families(S.REGRESSION, 10, 3, False)


def test_voting_takes_smallest_label_on_ties(spark, frame):
    class Fixed:
        def __init__(self, value):
            self.value = value

        def transform(self, df):
            return df.withColumn("prediction", F.lit(self.value))

    rows = frame("row_id long, features double, label double", [(1, 0.0, 1.0)])
    made = {"a": Fixed(2.0), "b": Fixed(1.0)}
    assert models.vote(made, ["a", "b"], rows, True).first()["prediction"] == 1.0
    assert models.vote(made, ["a", "b"], rows, False).first()["prediction"] == 1.5


def test_three_blobs(spark, frame):
    rng = random.Random(9)
    rows = [(i, rng.gauss(cx, 1), rng.gauss(cy, 1)) for i, (cx, cy) in enumerate([(0, 0), (10, 10), (0, 10)] * 60)]
    df = frame("row_id long, x1 double, x2 double", rows)
    df = VectorAssembler(inputCols=["x1", "x2"], outputCol="features").transform(df).select("row_id", "features")
    grid = [c for c in models.sweep_candidates(S.CLUSTERING, 0, 0) if c.name in ("kmeans_k2", "kmeans_k3", "kmeans_k5")]
    runs, _ = models.train_candidates(df, None, S.CLUSTERING, grid)
    assert M.rank_runs(runs, S.CLUSTERING).where("rank = 1").first()["candidate"] == "kmeans_k3"


def test_recursive_forecast_of_a_linear_trend(spark, frame):
    rows = [("s", i, 3.0 * i + (i % 7)) for i in range(120)]
    df = frame("k string, t long, y double", rows).withColumn(
        "ts", F.timestamp_micros(F.col("t") * 86_400_000_000).cast("timestamp_ntz"))
    frame_ = models.forecast_frame(df, "y", "ts", ["k"], 14, 5)
    train = models.one_step_rows(frame_, (1, 2, 7), (7,), 14)
    model = LinearRegression(regParam=1e-9).fit(train)
    errors = by(models.horizon_errors(models.recursive_forecast(model, frame_, 5, (1, 2, 7), (7,), 14), 5), "step")
    assert len(errors) == 5 and errors[5]["rmse"] < 0.1


def test_permutation_importance_finds_the_signal(spark, frame):
    rng = random.Random(10)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(300)]
    df = frame("row_id long, x0 double, x1 double, x2 double", rows).withColumn("label", 5 * F.col("x0") + 0.01 * F.col("x1"))
    df = VectorAssembler(inputCols=["x0", "x1", "x2"], outputCol="features").transform(df)
    model = LinearRegression().fit(df)
    top = E.permutation_importance(model, df, ["x0", "x1", "x2"], "row_id", repeats=3).where("rank = 1").first()
    assert top["feature"] == "x0" and top["importance"] > 1.0
    linear = by(E.linear_shapley(model, df, ["x0", "x1", "x2"]), "feature")
    sampled = by(E.sampled_shapley(model, df, ["x0", "x1", "x2"], "row_id", orders=40), "feature")
    assert sampled["x0"]["mean_abs_shapley"] == pytest.approx(linear["x0"]["mean_abs_shapley"], rel=0.15)
    curve = [r["mean_prediction"] for r in E.partial_dependence(model, df, 0).orderBy("value").collect()]
    assert len(curve) == 20 and curve == sorted(curve)


def test_model_round_trip(spark, prices, folder):
    from pyspark.ml import Pipeline

    pipe = Pipeline(stages=[VectorAssembler(inputCols=["feat_x1"], outputCol="features"), LinearRegression(labelCol="price")])
    artefacts.save_model(pipe.fit(prices), folder, "m1", S.REGRESSION, "price", ["feat_x1"], {"rmse": 1.0})
    model, meta = artefacts.load_model(spark, folder, "m1")
    assert meta["features"] == ["feat_x1"] and model.transform(prices).count() == 300
    with pytest.raises(KeyError):
        artefacts.load_model(spark, folder, "m2")


def test_clean_and_register(spark, frame, folder):
    rows = [(float(i), "ab"[i % 2], 1.0 * i) for i in range(30)] + [(0.0, "a", 0.0)] + [(None, "b", 5.5)]
    df = frame("age double, city string, score double", rows)
    result = cleaning_run.clean_and_register(df, "people", folder, K.RunOptions(run_recommended=True, allow_full_fit=True))
    versions = by(result.versions, "kind")
    assert versions["raw"]["row_count"] == 32 and versions["processed"]["row_count"] == 31
    assert versions["processed"]["parent_version_id"] == "people-raw" and result.problems.count() == 0
    assert result.cleaned.where("age IS NULL").count() == 0


def test_registry_refuses_repeats_and_orphans(spark, frame, folder):
    row = R.version_row(frame("x int", [(1,)]), "d", "v1", "raw", 1, with_quality=False)
    assert R.register_versions(spark, folder + "/r", row) == 1
    with pytest.raises(R.RegistryConflict):
        R.register_versions(spark, folder + "/r", row)
    orphan = R.version_row(frame("x int", [(1,)]), "d", "v3", "processed", 3, parent="v2", with_quality=False)
    with pytest.raises(R.RegistryConflict):
        R.register_versions(spark, folder + "/r", orphan)
    assert R.children(spark, folder + "/r", "v1").count() == 0 and R.get_version(spark, folder + "/r", "v1").count() == 1


def test_lineage_cycle_is_found(spark):
    rows = [("d", "a", None), ("d", "b", "a"), ("d", "c", "d1"), ("d", "d1", "c")]
    versions = spark.createDataFrame(rows, "dataset_id string, version_id string, parent_version_id string").withColumn("kind", F.lit("processed"))
    found = {(r["version_id"], r["problem"]) for r in V.lineage_problems(versions).collect()}
    assert {v for v, p in found if p == "not reachable from a root"} == {"c", "d1"}


def test_read_only_guard(spark, frame):
    df = frame("x int", [(1,), (2,)])
    assert R.query_table(df, " SELECT sum(x) AS s FROM experiments").first()["s"] == 3
    assert R.query_table(df, "WITH a AS (SELECT 'drop' AS w FROM experiments) SELECT count(*) AS n FROM a").first()["n"] == 2
    for sql in ("DROP TABLE experiments", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SELECT nope FROM experiments"):
        with pytest.raises(R.QueryRejected):
            R.query_table(df, sql)


def test_experiments_with_mixed_metrics_get_no_rank(spark, frame):
    df = frame("experiment_id string, metric string, direction string, score double",
               [("a", "rmse", "minimize", 1.0), ("b", "f1", "maximize", 0.9), ("c", None, None, None)])
    assert {r["rank"] for r in V.compare_experiments(df).collect()} == {None}


def test_csv_reader(spark, folder):
    path = folder + "/d.csv"
    with open(path, "w") as f:
        f.write("id,age,city,flag\n1,30,London,true\n2,NA,\"a, b\",false\n3,41.5,,true\n")
    df = readers.read_csv(spark, path)
    assert [t for _, t in df.dtypes] == ["bigint", "double", "string", "boolean"]
    assert df.where("age IS NULL").count() == 1 and df.where("city IS NULL").count() == 1
    bad = folder + "/bad.csv"
    with open(bad, "w") as f:
        f.write("a,b\n1,2\n3\n4,5,6\n")
    with pytest.raises(readers.InvalidCsv):
        readers.read_csv(spark, bad)
    assert {r["reason"]: r["rejected"] for r in readers.reject_report(spark, bad).collect()} == {"too_few_fields": 1, "too_many_fields": 1}
    with pytest.raises(readers.MissingSource):
        readers.read_dataset(spark, folder + "/none.csv")
    with pytest.raises(readers.WrongFormat):
        readers.detect_format("a.xyz")


def test_manifest_digests_small_and_large_files(spark, folder):
    import hashlib

    from tablegauge.sources import landing

    for name, text in (("small.txt", "a\n"), ("large.txt", "line\n" * 100)):
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)
    found = {r["path"].split("/")[-1]: r for r in landing.file_manifest(spark, folder).collect()}
    assert found["small.txt"]["sha256"] == hashlib.sha256(b"a\n").hexdigest()
    assert found["large.txt"]["sha256"] == hashlib.sha256(b"line\n" * 100).hexdigest() and found["large.txt"]["size_bytes"] == 500


def test_landing_copies_bytes(spark, folder):
    import pytest

    from tablegauge.sources import landing

    raw = b"a,b\r\n1,2\r\n\x00\xff"
    with open(f"{folder}/in.csv", "wb") as f:
        f.write(raw)
    landing.land_raw(spark, f"{folder}/in.csv", f"{folder}/landed")
    with open(f"{folder}/landed/in.csv", "rb") as f:
        assert f.read() == raw
    with pytest.raises(FileExistsError):
        landing.land_raw(spark, f"{folder}/in.csv", f"{folder}/landed")


def test_long_chain_and_seeded_walks(spark):
    from tablegauge.operators import versions as V

    chain = spark.range(300).selectExpr("'d' AS dataset_id", "'v' || id AS version_id", "IF(id > 0, 'v' || (id - 1), NULL) AS parent_version_id")
    assert V.closure(chain).count() == 300 * 301 // 2
    assert {(r["ancestor_id"], r["distance"]) for r in V.ancestors(chain, "v200").collect()} == {(f"v{200 - d}", d) for d in range(1, 201)}
    assert V.descendants(chain, "v200").count() == 99
    assert {(r["root_id"], r["depth"]) for r in V.roots(chain).collect()} == {("v0", d) for d in range(300)}
    assert V.relationship(chain, "v3", "v250").first()["relationship"] == "ancestor"


def test_sketch_has_no_global_aggregate_of_rows(spark):
    from tablegauge.operators import ordered

    df = spark.range(10_000).selectExpr("CAST(id % 1000 AS DOUBLE) AS x", "CAST(NULL AS DOUBLE) AS y")
    edges = ordered.sketch_edges(df, {"x": df["x"], "y": df["y"]}, 32)
    assert len(edges["x"]) > 20 and edges["y"] == [-float("inf"), 0.0, float("inf")]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from tablegauge.session import scratch_folder

    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None, applicationId="a")
    with pytest.raises(RuntimeError):
        scratch_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context), "x")


def test_a_broken_landing_is_repeated(spark, folder, monkeypatch):
    import hashlib
    import os

    from tablegauge.sources import landing

    os.makedirs(f"{folder}/in")
    contents = {f"f{i}.bin": os.urandom(1000 + i) for i in range(12)}
    for name, raw in contents.items():
        with open(f"{folder}/in/{name}", "wb") as f:
            f.write(raw)
    walk = landing._walk

    def broken(files, destination):
        # some files land, then the run dies before its manifest
        walk(files.where("path LIKE '%f1%'"), destination).collect()
        with open(f"{folder}/out/{landing.ASIDE}half", "wb") as f:
            f.write(b"half a file")
        raise OSError("lost")

    monkeypatch.setattr(landing, "_walk", broken)
    with pytest.raises(OSError, match="lost"):
        landing.land_raw(spark, f"{folder}/in", f"{folder}/out")
    assert not os.path.exists(f"{folder}/out/{landing.MANIFEST}/_SUCCESS")
    monkeypatch.setattr(landing, "_walk", walk)
    rows = landing.land_raw(spark, f"{folder}/in", f"{folder}/out").collect()
    assert {r.path.split("/")[-1]: r.sha256 for r in rows} == {n: hashlib.sha256(raw).hexdigest() for n, raw in contents.items()}
    assert sorted(n for n in os.listdir(f"{folder}/out") if not n.startswith(("_started", "_manifest", "."))) == sorted(contents)
    with pytest.raises(FileExistsError):
        landing.land_raw(spark, f"{folder}/in", f"{folder}/out")
    os.makedirs(f"{folder}/other")
    with open(f"{folder}/other/theirs", "w") as f:
        f.write("x")
    with pytest.raises(FileExistsError):
        landing.land_raw(spark, f"{folder}/in", f"{folder}/other")
    assert landing.read_manifest(spark, f"{folder}/out").count() == 12


def test_importance_moves_single_values(spark, frame):
    rows = [(i, float(i), float(i * i % 17), 0.0, float(i) * 2) for i in range(50)]
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(
        frame("row_id long, a double, b double, c double, label double", rows)).select("row_id", "features", "label")
    swapped = E.swapped_rows(df, "row_id", 3, 4).collect()
    assert len(swapped) == 50 * 3 * 4
    of = {r[4]: r[1:4] for r in rows}
    for r in swapped:
        own, now = of[r.label], r.features.toArray().tolist()
        assert [x for i, x in enumerate(now) if i != r.feature] == [x for i, x in enumerate(own) if i != r.feature]
    for key in {(r.repeat, r.feature) for r in swapped}:  # a permutation each
        values = sorted(r.features.toArray()[r.feature] for r in swapped if (r.repeat, r.feature) == key)
        assert values == sorted(row[1 + key[1]] for row in rows)
    assert E.swapped_rows(df.limit(1), "row_id", 3, 2).count() == 6 and E.swapped_rows(df.limit(0), "row_id", 3, 2).count() == 0


def test_forecast_rows_do_not_depend_on_blocks(spark, frame):
    df = frame("s string, t long, y double", [(s, t, float(t * (2 if s == "a" else 3) % 17)) for s in "ab" for t in range(60)]).withColumn(
        "t", F.timestamp_seconds(F.col("t") * 3600).cast("timestamp_ntz"))
    whole = sorted(map(str, models.forecast_frame(df, "y", "t", ["s"], 5, 4).collect()))
    assert len(whole) == 2 * 56
    for size in (5, 7, 13):
        assert sorted(map(str, models.forecast_frame(df, "y", "t", ["s"], 5, 4, block_rows=size).collect())) == whole


def test_forecast_run(spark, frame):
    from tablegauge.plans.forecast_run import forecast_table

    rng = random.Random(2)
    rows, y = [], 10.0
    for i in range(200):
        y = 2 + 0.8 * y + rng.gauss(0, 0.1)
        rows.append((i, y if i != 50 else None, 1))
    df = frame("t long, y double, one int", rows).withColumn("t", F.timestamp_seconds(F.col("t") * 86400).cast("timestamp_ntz"))
    result = forecast_table(df, "y", "t", lags=(1, 2), windows=(3,), horizon=3)
    assert result.status == "completed" and result.best == "linear_regression"
    errors = by(result.errors, "step")
    assert 0.05 < errors[1]["rmse"] < 0.2 and errors[3]["rmse"] < 0.4 and errors[1]["n"] == errors[3]["n"] > 20
    assert by(result.runs, "candidate").keys() == {"linear_regression", "decision_tree", "random_forest"}
    assert forecast_table(df.union(df), "y", "t").status == "blocked"
    assert forecast_table(df.limit(1), "y", "t").status == "blocked"
    assert forecast_table(df.limit(6), "y", "t").status == "blocked"
