"""Profile, quality, cleaning, screens, features, splits on small frames."""

import pytest
from pyspark.sql import functions as F

from conftest import by, one
from tablegauge.functions import columns as C, text
from tablegauge.operators import cleaning as K, features as G, filters, metrics as M, profile as P, quality as Q, screens as S
from tablegauge.operators import splits as L


@pytest.fixture(scope="module")
def sample(spark):
    rows = [
        (1, 30.0, "London", "2023-01-05", 1.5), (2, None, "Paris", "2023-02-10", 2.5), (3, 41.0, None, "2023-03-01", 3.5),
        (4, 28.0, "London", "2023-04-20", None), (5, 35.0, "Rome", "2023-05-05", 0.5), (5, 35.0, "Rome", "2023-05-05", 0.5),
    ]
    return spark.createDataFrame(rows, "id long, age double, city string, signup_date string, score double")


def test_profile(spark, sample):
    facts = by(P.profile(sample), "column")
    assert facts["signup_date"]["inferred_type"] == C.DATETIME and facts["city"]["inferred_type"] == C.CATEGORICAL
    assert facts["age"]["n_missing"] == 1 and facts["age"]["missing_percentage"] == 16.6667
    assert facts["age"]["median"] == 35.0 and facts["city"]["most_frequent"] == "London"
    assert facts["city"]["n_unique"] == 3
    assert one(P.duplicate_rows(sample)) == {"n_rows": 6, "duplicate_rows": 1, "duplicate_percentage": 16.6667}
    assert one(P.table_header(sample))["n_columns"] == 5


def test_nan_is_missing_and_nulls_are_equal_rows(spark, frame):
    df = frame("x double, s string", [(float("nan"), None), (None, None), (1.0, "")])
    assert by(P.missing_counts(df), "column")["x"]["missing_count"] == 2
    assert one(P.duplicate_rows(C.normalise_missing(df)))["duplicate_rows"] == 1


@pytest.mark.parametrize("n, severity", [(1, "medium"), (9, "critical")])
def test_missing_ladder(spark, frame, n, severity):
    df = frame("i int, x double", [(i, None if i < n else float(i)) for i in range(10)])
    found = one(Q.run_checks(df, checks=["missing_values"]))
    assert found["severity"] == severity and found["affected_rows"] == n


def test_quality_findings(spark, frame):
    rows = []
    for i in range(120):
        rows.append((
            1000.0 + i if i >= 4 else 90000.0, None if i % 5 == 0 else 20.0 + i % 30,
            "London" if i % 2 else "london ", "yes" if i < 112 else "no", str(i),
        ))
    df = frame("amount double, age double, city string, target string, count_text string", rows)
    found = {(r["finding_type"], r["column"]): r for r in Q.run_checks(df, target="target").collect()}
    assert found[Q.MISSING, "age"]["severity"] == "medium"
    assert found[Q.OUTLIERS, "amount"]["affected_rows"] == 4
    assert found[Q.SKEW, "amount"]["severity"] == "medium"
    assert found[Q.CATEGORIES, "city"]["affected_rows"] == 120 and found[Q.CATEGORIES, "city"]["severity"] == "low"
    assert found[Q.TYPE_MISMATCH, "count_text"]["confidence"] == 1.0
    assert found[Q.IMBALANCE, "target"]["severity"] == "high"
    summary = one(Q.summarise(Q.run_checks(df, target="target")))
    assert summary["score"] == 100 - sum(Q.PENALTY[r["severity"]] for r in found.values())
    with pytest.raises(ValueError):
        Q.run_checks(df, checks=["nonsense"])
    with pytest.raises(ValueError):
        Q.run_checks(df, target="nowhere").count()


def test_text_folding(spark, frame):
    df = frame("s string", [("  Straße\t x ",), ("STRASSE X",)])
    assert df.select(text.fold(F.col("s")).alias("k")).distinct().count() == 1


def test_imputation(spark, frame):
    ages = [10.0, 20.0, None, 40.0, 50.0, 60.0, 70.0, 80.0, 90.0, None]
    df = frame("age double", [(a,) for a in ages])
    assert [r["age"] for r in K.impute_median(df, "age").collect()][2] == 55.0
    cities = frame("city string", [(c,) for c in ["A", "B", "A", None, "A", "B", "A", "B", "A", None]])
    assert {r["city"] for r in K.impute_mode(cities, "city").collect()} == {"A", "B"}
    tie = frame("city string", [("b",), ("a",), (None,)])
    assert K.mode_of(tie, "city") == "a"
    fitted = K.impute_median(df, "age", fit=F.col("age") <= 40)
    assert 20.0 in [r["age"] for r in fitted.collect()]


def test_refusals(spark, frame):
    df = frame("n string, d string, v double", [("1", "01/02/2024", 1.0), ("x", "31/12/2023", 0.0)])
    for call in (
        lambda: K.text_to_number(df, "n"),
        lambda: K.text_to_timestamp(df, "d", None),
        lambda: K.text_to_timestamp(df, "d", "%m/%d/%Y"),
        lambda: K.log_transform(df, "v"),
        lambda: K.drop_column(df, "v", target="v"),
    ):
        with pytest.raises(K.CleaningRefused):
            call()
    assert K.text_to_timestamp(df, "d", "%d/%m/%Y").schema["d"].dataType.typeName().startswith("timestamp")
    assert K.spark_pattern("%Y-%m-%dT%H:%M") == "yyyy-MM-dd'T'HH:mm"


def test_gated_run(spark, sample):
    plan = K.operation_rows(K.plan_for(sample))
    kinds = {o["operation_type"]: o for o in plan}
    assert kinds[K.DEDUPLICATE]["status"] == "recommended" and kinds[K.TO_DATE]["status"] == "review_required"
    assert [o["status"] for o in plan] == sorted((o["status"] for o in plan), key=K.STATUSES.index)
    cleaned, log = K.run_plan(sample, plan, K.RunOptions())
    assert cleaned.count() == 6 and {r["status"] for r in log.collect()} == {"skipped"}
    approve = K.RunOptions(approved={o["operation_id"] for o in plan})
    _, log = K.run_plan(sample, plan, approve)
    assert by(log, "operation_type")[K.IMPUTE_NUMBER]["reason"].startswith("must be fitted")
    approve = K.RunOptions(approved={o["operation_id"] for o in plan}, allow_full_fit=True,
                           overrides={"convert_text_to_datetime:signup_date": {"format": "%Y-%m-%d"}})
    cleaned, log = K.run_plan(sample, plan, approve)
    assert all(r["status"] in ("executed", "skipped") for r in log.collect())
    assert cleaned.count() == 5 and cleaned.where("age IS NULL OR city IS NULL").count() == 0
    assert sample.count() == 6


def test_whitespace_only_variants_are_recommended(spark, frame):
    df = frame("c string", [("a",)] * 4 + [("a ",)] * 3 + [("b",)] * 5)
    plan = {o["operation_type"]: o["status"] for o in K.operation_rows(K.plan_for(df))}
    assert plan == {K.TRIM: "recommended", K.DEDUPLICATE: "recommended"}
    assert {r["c"] for r in K.standardise_spellings(df, "c").collect()} == {"a", "b"}
    assert {r["c"] for r in K.standardise_spellings(df, "c", {"b": "z"}).collect()} == {"a", "a ", "z"}


def test_slicers(spark, frame):
    df = frame("c string, n string, d string", [("a", "1", "2024-01-01"), ("b", "x", "2024-02-01"), ("A", "3", "2024-03-01")])
    assert filters.slice_rows(df, ranges={"n": (0, 5)}).count() == 2
    assert filters.slice_rows(df, dates={"d": ("2024-01-15", None)}).count() == 2
    assert filters.slice_rows(df, search="A", search_columns=["c"]).count() == 2
    assert filters.slice_rows(df, categories={"c": []}).count() == 3
    assert filters.missing_columns(df, ["c", "z"]) == ["z"]


def test_screens(spark, frame):
    rows = [(i, float(i) * 1.5, i % 2 == 0, "NSEW"[i % 4], 1 + i % 3) for i in range(240)]
    df = frame("customer_id long, price double, churned boolean, region string, grade int", rows)
    facts = C.settle(P.column_table(df))
    task = lambda t, **k: one(S.task_type(facts, t, **k))["task"]
    assert task("price") == S.REGRESSION and task("churned") == S.BINARY and task("region") == S.MULTICLASS
    assert task("grade") == S.REGRESSION and task("grade", classes_declared=True) == S.MULTICLASS
    scores = by(S.target_scores(facts, "predict churned"), "column")
    assert scores["customer_id"]["score"] < 0 and scores["churned"]["match"] == "exact"
    assert one(S.choose_target(S.target_scores(facts, "predict churned")))["target"] == "churned"
    assert one(S.choose_target(S.target_scores(facts)))["reason"] == "within_margin"
    assert S.passes(S.feasibility(df, "price", S.REGRESSION))
    tiny = df.limit(1)
    assert "too_few_rows" in {r["issue"] for r in S.feasibility(tiny, "price", S.REGRESSION).collect()}
    assert not S.passes(S.readiness(df, "price", S.REGRESSION, 0))


def test_features(spark, frame):
    rows = [(float(i), float(i), None, 5.0, i % 2, "r%d" % (i % 3), -100.0 * 2.0 ** (i % 12), float(i) * 3 + (i % 2) * 0.01) for i in range(80)]
    df = frame("num_a double, num_a_dup double, empty double, const double, near_binary int, region string, neg double, num_b double", rows)
    stock = by(G.inventory(P.column_table(df)), "column")
    assert stock["empty"]["excluded_because"] == "all_missing" and stock["const"]["excluded_because"] == "constant"
    chosen = by(G.select_features(df), "column")
    assert (chosen["num_a_dup"]["action"], chosen["num_a_dup"]["related"]) == ("drop", "num_a")
    assert chosen["near_binary"]["reason"] == "low_variety" and chosen["num_b"]["reason"] == "redundant"
    assert chosen["region"]["action"] == "retain"
    assert ("neg", "reciprocal") in {tuple(r) for r in G.transform_choices(df, ["neg"]).collect()}
    needs = {tuple(r) for r in G.requirements(df).collect()}
    assert ("region", "encoding") in needs


def test_preprocessor_fits_on_train_only(spark, frame):
    train = frame("x double, c string", [(1.0, "a"), (3.0, "a"), (None, "b"), (5.0, None)])
    stage = G.Preprocessor(["x"], ["c"], robust=False).fit(train)
    out = stage.transform(frame("x double, c string", [(None, "new"), (3.0, "a")])).collect()
    assert stage.medians == {"x": 3.0} and stage.top == {"c": ["a", "b"]}
    assert out[0]["features"][0] == pytest.approx(out[1]["features"][0])


def test_splits_are_stable_and_stratified(spark, frame):
    df = frame("k long, y string", [(i, "a" if i % 10 else "b") for i in range(1000)])
    first = {r["k"]: r["split"] for r in L.random_holdout(df, "k").collect()}
    again = {r["k"]: r["split"] for r in L.random_holdout(df.repartition(5), "k").collect()}
    assert first == again
    exact = L.stratified_holdout(df, "k", "y", exact=True).groupBy("y", "split").count().collect()
    assert {(r["y"], r["split"]): r["count"] for r in exact}["b", "train"] == 70
    plan = one(L.split_plan(df, S.BINARY, "y"))
    assert plan["strategy"] == "stratified_holdout" and plan["train_fraction"] == 0.7


def test_metrics(spark, frame):
    rows = frame("label double, prediction double", [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (2.0, 2.0)])
    m = one(M.classification_metrics(rows))
    assert m["accuracy"] == 0.75 and m["recall_macro"] == pytest.approx(2.5 / 3, abs=1e-6)
    flat = frame("label double, prediction double", [(1.0, 2.0), (1.0, 0.0)])
    assert one(M.regression_metrics(flat))["r2"] is None
    auc = frame("label int, score double", [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)])
    assert one(M.roc_auc(auc))["roc_auc"] == 0.625
    runs = frame("candidate string, family string, status string, metrics map<string,double>", [
        ("b", "ensemble", "completed", {"rmse": 1.0}), ("a", "linear", "completed", {"rmse": 1.0}),
        ("c", "linear", "completed", {"rmse": float("nan")}), ("d", "linear", "failed", None)])
    ranked = by(M.rank_runs(runs, S.REGRESSION), "candidate")
    assert [ranked[c]["rank"] for c in "abcd"] == [1, 2, None, None]


def test_cleaning_passes_do_not_grow_with_columns(spark, frame):
    def jobs(width):
        ddl = ", ".join([f"n{i} double, t{i} string, c{i} string" for i in range(width)])
        rows = [tuple(x for i in range(width) for x in (None if k == i else float(k + i), str(k), None if k % 7 == 1 else " a" if k % 3 else "b")) for k in range(40)]
        df = frame(ddl, rows + rows[:2])
        plan = [dict(operation_id=f"{kind}:{c}", operation_type=kind, column=c, status="recommended", source_finding_id="f") for kind, prefix in (
            (K.IMPUTE_NUMBER, "n"), (K.TO_NUMBER, "t"), (K.IMPUTE_CATEGORY, "c"), (K.TRIM, "c")) for c in (f"{prefix}{i}" for i in range(width))]
        plan.insert(0, dict(operation_id="d", operation_type=K.DEDUPLICATE, column=None, status="recommended", source_finding_id="f"))
        group = f"cleaning-{width}"
        spark.sparkContext.setJobGroup(group, "")
        cleaned, log = K.run_plan(df, plan, K.RunOptions(run_recommended=True, allow_full_fit=True))
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setJobGroup("", "")
        found = log.collect()
        assert [r.step for r in found] == list(range(1, 4 * width + 2)) and {r.status for r in found} == {"executed"}
        assert cleaned.count() == 40 and {r.c0 for r in cleaned.collect()} == {"a", "b"} and dict(cleaned.dtypes)["t0"] == "bigint"
        return n

    assert jobs(2) == jobs(6)


def test_operations_on_one_column_follow_one_another(spark, frame):
    df = frame("a string, n double", [(" 1 ", 1.0), ("2", None), ("x", 3.0), (None, 4.0)])
    op = lambda kind, c: dict(operation_id=f"{kind}:{c}", operation_type=kind, column=c, status="recommended", source_finding_id="f")
    advice = dict(op(sorted(K.ADVICE)[0], "n"))
    plan = [op(K.TRIM, "a"), advice, op(K.TO_NUMBER, "a"), op(K.DROP_COLUMN, "a"), op(K.TRIM, "a"), op(K.IMPUTE_NUMBER, "n"), op(K.LOG, "n")]
    cleaned, log = K.run_plan(df, plan, K.RunOptions(run_recommended=True, fit=F.col("n") < 4))
    found = {r.step: r for r in log.collect()}
    assert [found[i].status for i in range(1, 8)] == ["executed", "skipped", "failed", "executed", "skipped", "executed", "executed"]
    assert "'x'" in found[3].reason and "not in the table" in found[5].reason and found[2].reason.startswith("advice only")
    assert cleaned.columns == ["n"] and found[6].missing_before == 1 and found[6].missing_after == 0
    assert sorted(round(r.n, 6) for r in cleaned.collect()) == [0.0, 0.693147, 1.098612, 1.386294]
    target = K.run_plan(df, [op(K.DROP_COLUMN, "n")], K.RunOptions(run_recommended=True, target="n"))
    assert target[1].first().status == "failed" and target[0].columns == ["a", "n"]
