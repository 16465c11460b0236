"""Training, evaluation, forecasting and explanation queries.

Where a model has a closed form (one-feature least squares), the SQL computes it; tree, boosting and clustering fits have
no SQL counterpart.
"""

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tablegauge.functions import columns as C
from tablegauge.operators import explain as E, features as G, metrics as M, models as K, screens as S, splits as L, tuning as T
from tablegauge.queries.features import UNIT
from tablegauge.queries.registry import query, rounded, table
from tablegauge.session import scratch_folder, staged
from tablegauge.sources import artefacts


def _price_rows(spark, sf, inputs=("l_quantity",)):
    li = table(spark, sf, "lineitem").withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    split = L.random_holdout(li, "row_id", shares=(0.8, 0.0, 0.2))
    rows = VectorAssembler(inputCols=list(inputs), outputCol="features").transform(split)
    return rows.select("row_id", "features", F.col("l_extendedprice").alias("label"), "split")


PRICE_FIT = f"""s AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_quantity AS x, l_extendedprice AS y FROM lineitem),
    t AS (SELECT *, {UNIT.format('row_id')} < 8000 AS train FROM s),
    m AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b, avg(x) AS mx FROM t WHERE train)"""


@query(
    "linear_regression",
    f"""WITH {PRICE_FIT}, e AS (SELECT y, a * x + b AS p FROM t, m WHERE NOT train)
    SELECT count(*) AS n, round(avg(pow(y - p, 2)), 0) AS mse, round(sqrt(avg(pow(y - p, 2))), 3) AS rmse,
      round(avg(abs(y - p)), 3) AS mae, round(1 - avg(pow(y - p, 2)) / var_pop(y), 6) AS r2 FROM e""",
)
def linear_regression(spark, sf):
    rows = _price_rows(spark, sf)
    model = LinearRegression(solver="normal").fit(rows.where("split = 'train'"))
    out = M.regression_metrics(K.predict_label(model, rows.where("split = 'test'")))
    return out.select("n", F.round("mse", 0).alias("mse"), F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"), "r2")


@query(
    "cross_validation",
    """WITH t AS (SELECT o_custkey AS x, o_totalprice AS y, """
    + UNIT.format("o_orderkey").replace("|42", "|43")
    + """ % 5 AS fold FROM orders),
    m AS (SELECT f.fold, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM t, (SELECT DISTINCT fold FROM t) f
      WHERE t.fold <> f.fold GROUP BY f.fold),
    s AS (SELECT t.fold, sqrt(avg(pow(y - (a * x + b), 2))) AS rmse FROM t JOIN m ON m.fold = t.fold GROUP BY t.fold)
    SELECT 'linear' AS candidate, count(*) AS folds, round(avg(rmse), 3) AS mean, round(stddev_pop(rmse), 3) AS std FROM s""",
)
def cross_validation(spark, sf):
    o = L.hash_fold(table(spark, sf, "orders"), "o_orderkey")
    rows = VectorAssembler(inputCols=["o_custkey"], outputCol="features").transform(o).select(
        F.col("o_orderkey").alias("row_id"), "features", F.col("o_totalprice").alias("label"), "fold"
    )
    candidates = [K.Candidate("linear", "linear", LinearRegression(solver="normal"))]
    return rounded(K.cross_validate(rows, S.REGRESSION, candidates).select("candidate", "folds", "mean", "std"), 3)


def _label_rows(spark, sf):
    """Documents with a quality label, simple text measures as features."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    measured = d.select(
        F.col("doc_id").alias("row_id"),
        F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split("text", r"\s+")).cast("double").alias("n_words"),
        (F.length(F.regexp_replace("text", r"[^0-9]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("digit_share"),
        F.col("quality").cast("double").alias("label"),
    )
    rows = VectorAssembler(inputCols=["n_chars", "n_words", "digit_share"], outputCol="features").transform(measured)
    return L.random_holdout(rows.select("row_id", "features", "label"), "row_id", shares=(0.8, 0.0, 0.2))


def _train_test(rows):
    return rows.where("split = 'train'"), rows.where("split = 'test'")


@query("train_regressors")
def train_regressors(spark, sf):
    o = table(spark, sf, "orders")
    stage = G.Preprocessor(["o_custkey", "month"], ["o_orderstatus", "o_orderpriority"])
    split = L.random_holdout(o.withColumn("month", F.month("o_orderdate")), "o_orderkey", shares=(0.8, 0.0, 0.2))
    rows = stage.fit(split.where("split = 'train'")).transform(split).select(
        F.col("o_orderkey").alias("row_id"), "features", F.col("o_totalprice").alias("label"), "split"
    )
    runs, _ = K.train_candidates(*_train_test(rows), S.REGRESSION, K.baselines(S.REGRESSION, 4))
    return M.rank_runs(runs, S.REGRESSION)


@query("train_classifiers")
def train_classifiers(spark, sf):
    train, test = _train_test(_label_rows(spark, sf))
    runs, _ = K.train_candidates(train, test, S.BINARY, K.baselines(S.BINARY, 3))
    return M.rank_runs(runs, S.BINARY)


@query("classifier_sweep_and_vote")
def classifier_sweep_and_vote(spark, sf):
    """The whole fixed grid, ranked, and the voting ensemble of the best five."""
    train, test = _train_test(_label_rows(spark, sf))
    runs, models = K.train_candidates(train, test, S.BINARY, K.sweep_candidates(S.BINARY, train.count(), 3))
    ranking = M.rank_runs(runs, S.BINARY)
    voted = K.voting_ensemble(models, ranking, test, S.BINARY)
    row = spark.createDataFrame(
        [(None, "voting_top5", "ensemble", "f1_macro", voted["f1_macro"], "ensemble", None)],
        "rank int, candidate string, family string, metric string, score double, selection string, reason string",
    )
    return ranking.unionByName(row)


@query("modeling_run")
def modeling_run(spark, sf):
    """Screens, feature selection, split, preprocessing, training and ranking in one call."""
    from tablegauge.plans.modeling_run import model_table

    return model_table(table(spark, sf, "orders"), "o_totalprice", "o_orderkey").ranking


@query("random_search")
def random_search(spark, sf):
    """Thirty draws of forest settings, compared on growing parts of the rows; finalists are cross validated on all of them."""
    return T.search(L.hash_fold(_label_rows(spark, sf).drop("split"), "row_id"), S.BINARY, "random_forest")


@query(
    "ridge_search",
    """WITH t AS (SELECT o_custkey::DOUBLE AS x, o_totalprice::DOUBLE AS y, CAST("""
    + UNIT.format("o_orderkey").replace("|42", "|43")
    + """ % 5 AS INTEGER) AS fold FROM orders),
    m AS (SELECT f.fold, count(*) AS n, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS d, covar_pop(y, x) AS c FROM t, (SELECT DISTINCT fold FROM t) f
      WHERE t.fold <> f.fold GROUP BY f.fold),
    a AS (SELECT i::INTEGER AS i, pow(10, i - 4)::DOUBLE AS alpha FROM range(0, 9) r(i)),
    e AS (SELECT i, t.fold, sqrt(avg(pow(y - (my + n * c / d / (n + alpha) / d * (x - mx)), 2))) AS rmse FROM t JOIN m ON m.fold = t.fold, a GROUP BY i, t.fold)
    SELECT 'ridge_' || i AS candidate, count(*) AS folds, round(avg(rmse), 3) AS mean, round(stddev_pop(rmse), 3) AS std, 'completed' AS status
    FROM e GROUP BY i""",
)
def ridge_search(spark, sf):
    """The whole space of a ridge, every setting on all rows of every fold."""
    o = L.hash_fold(table(spark, sf, "orders"), "o_orderkey")
    rows = VectorAssembler(inputCols=["o_custkey"], outputCol="features").transform(o).select(
        F.col("o_orderkey").alias("row_id"), "features", F.col("o_totalprice").alias("label"), "fold")
    return rounded(T.search(rows, S.REGRESSION, "ridge").select("candidate", "folds", "mean", "std", "status"), 3)


def _vectors(spark, sf):
    from pyspark.ml.functions import array_to_vector

    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )


@query("train_clusterings")
def train_clusterings(spark, sf):
    runs, _ = K.train_candidates(_vectors(spark, sf), None, S.CLUSTERING, K.sweep_candidates(S.CLUSTERING, 0, 0))
    return M.rank_runs(runs, S.CLUSTERING)


RULES = ("o_totalprice", "orders")
RUN_SQL = """r AS (SELECT o_totalprice AS y, avg(o_totalprice) OVER () AS whole,
      avg(o_totalprice) OVER (PARTITION BY o_orderstatus) AS by_status,
      avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS by_priority FROM orders),
    s AS (SELECT 'whole' AS candidate, 'linear' AS family, sqrt(avg(pow(y - whole, 2))) AS rmse FROM r
      UNION ALL SELECT 'by_status', 'tree_based', sqrt(avg(pow(y - by_status, 2))) FROM r
      UNION ALL SELECT 'by_priority', 'tree_based', sqrt(avg(pow(y - by_priority, 2))) FROM r)"""


def _rule_runs(spark, sf):
    """Runs of three mean predictors plus one failure."""
    o = table(spark, sf, "orders")
    parts = []
    for name, family, column in (("whole", "linear", None), ("by_status", "tree_based", "o_orderstatus"),
                                 ("by_priority", "tree_based", "o_orderpriority")):
        key = [column] if column else []
        means = o.groupBy(*key).agg(F.avg("o_totalprice").alias("prediction"))
        joined = o.join(means, column) if column else C.attach_row(o, means)
        found = M.regression_metrics(joined.withColumn("label", F.col("o_totalprice")))
        parts.append(found.select(
            F.lit(name).alias("candidate"), F.lit(family).alias("family"), F.lit("completed").alias("status"),
            F.create_map(F.lit("rmse"), F.col("rmse")).alias("metrics"),
        ))
    failed = o.limit(1).select(
        F.lit("broken").alias("candidate"), F.lit("neural").alias("family"), F.lit("failed").alias("status"),
        F.lit(None).cast("map<string,double>").alias("metrics"),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(failed)


@query(
    "run_ranking",
    f"""WITH {RUN_SQL} SELECT CAST(row_number() OVER (ORDER BY round(rmse, 6), family, candidate) AS INTEGER) AS "rank", candidate,
    round(rmse, 4) AS score FROM s UNION ALL SELECT -1, 'broken', -1.0""",
)
def run_ranking(spark, sf):
    ranked = M.rank_runs(_rule_runs(spark, sf), S.REGRESSION).select("rank", "candidate", F.round("score", 4).alias("score"))
    return ranked.na.fill(-1, ["rank"]).na.fill(-1.0, ["score"])


@query(
    "run_summary",
    f"""WITH {RUN_SQL} SELECT count(*) + 1 AS n_runs, count(*) AS n_completed, 1::BIGINT AS n_failed, 'rmse' AS metric_names FROM s""",
)
def run_summary(spark, sf):
    return M.summarise_runs(_rule_runs(spark, sf))


@query(
    "candidate_families",
    """SELECT 'linear' AS family WHERE (SELECT count(*) FROM orders) > 0 UNION ALL SELECT 'tree_based' UNION ALL SELECT 'ensemble'
    UNION ALL SELECT 'probabilistic'""",
)
def candidate_families(spark, sf):
    o = table(spark, sf, "orders")
    found = K.families(S.MULTICLASS, o.count(), len(o.columns) - 1, numeric_only=False)
    return spark.createDataFrame([(f,) for f in found], "family string")


@query("recursive_forecast")
def recursive_forecast(spark, sf):
    """Hourly mean per event type: a linear one-step model rolled forward six steps from every origin."""
    from tablegauge.queries.features import hourly

    lags, windows, reach, horizon = (1, 2, 3), (7,), 7, 6
    frame = staged(K.forecast_frame(hourly(spark, sf), "value", "hour", ["event_type"], reach, horizon), "origins")
    rows = K.one_step_rows(frame, lags, windows, reach, ("hour",))
    early = F.col("origin") < F.lit("2024-01-22").cast("timestamp_ntz")
    model = LinearRegression().fit(rows.where(early))
    out = K.recursive_forecast(model, frame.where(~early), horizon, lags, windows, reach, ("hour",))
    return K.horizon_errors(out, horizon)


@query(
    "recursive_forecast_origins",
    """WITH h AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS hour, avg(value) AS value FROM events GROUP BY 1, 2),
    r AS (SELECT hour, row_number() OVER (PARTITION BY event_type ORDER BY hour) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM h)
    SELECT CAST(s AS INTEGER) AS step, (SELECT count(*) FROM r WHERE i >= 7 AND n - i >= 6 AND hour >= TIMESTAMP '2024-01-22') AS n
    FROM range(1, 7) t(s)""",
)
def recursive_forecast_origins(spark, sf):
    return recursive_forecast(spark, sf).select("step", "n")


@query("refit_and_predict")
def refit_and_predict(spark, sf):
    """Refit on all rows, save with metadata, load and predict with the probability of class 1."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression

    rows = _label_rows(spark, sf)
    root = scratch_folder(spark, "models")
    fitted = Pipeline(stages=[LogisticRegression()]).fit(rows)
    artefacts.save_model(fitted, root, "quality", S.BINARY, "quality", ["n_chars", "n_words", "digit_share"])
    model, _ = artefacts.load_model(spark, root, "quality")
    return K.predictions(model, rows, binary=True).select("row_id", "prediction", F.round("probability_1", 6).alias("p1"))


IMPORTANCE = ["o_custkey", "month", "day"]


def _solve3(i: int) -> str:
    """Weight i of least squares on three features by Cramer's rule, from moments c11 .. c33 and c1y .. c3y."""
    def det(m: list[list[str]]) -> str:
        (a, b, c), (d, e, f), (g, h, k) = m
        return f"({a} * ({e} * {k} - {f} * {h}) - {b} * ({d} * {k} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"

    whole = [[f"c{min(r, c)}{max(r, c)}" for c in (1, 2, 3)] for r in (1, 2, 3)]
    swapped = [[f"c{r}y" if c == i else whole[r - 1][c - 1] for c in (1, 2, 3)] for r in (1, 2, 3)]
    return f"{det(swapped)} / {det(whole)}"


IMPORTANCE_SQL = f"""WITH s AS (SELECT o_orderkey AS row_id, o_custkey::DOUBLE AS x1, month(o_orderdate)::DOUBLE AS x2, day(o_orderdate)::DOUBLE AS x3,
      o_totalprice::DOUBLE AS y FROM orders),
    t AS (SELECT *, {UNIT.format('row_id')} AS u FROM s),
    m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(y) AS my, {', '.join(f'covar_pop(x{a}, x{b}) AS c{a}{b}' for a in (1, 2, 3) for b in (1, 2, 3) if a <= b)},
      {', '.join(f'covar_pop(x{a}, y) AS c{a}y' for a in (1, 2, 3))} FROM t WHERE u < 8000),
    w AS (SELECT m1, m2, m3, my, {', '.join(f'{_solve3(i)} AS w{i}' for i in (1, 2, 3))} FROM m),
    h AS (SELECT x1, x2, x3, y, y - (my + w1 * (x1 - m1) + w2 * (x2 - m2) + w3 * (x3 - m3)) AS gap, w1, w2, w3,
      row_number() OVER (ORDER BY u, row_id) - 1 AS pos, count(*) OVER () AS n, var_pop(y) OVER () AS spread FROM t, w WHERE u >= 8000),
    v AS ({' UNION ALL '.join(f"SELECT pos, {i - 1} AS f, x{i} AS x FROM h" for i in (1, 2, 3))}),
    k AS (SELECT r, f, CAST('0x' || substr(md5(r || '|' || f || '|42'), 1, 8) AS BIGINT) AS digest FROM range(0, 10) a(r), range(0, 3) b(f)),
    e AS (SELECT r, k.f, any_value(spread) AS spread, avg(pow(gap, 2)) AS whole,
      avg(pow(gap - CASE k.f WHEN 0 THEN w1 * (v.x - x1) WHEN 1 THEN w2 * (v.x - x2) ELSE w3 * (v.x - x3) END, 2)) AS mixed
      FROM h, k JOIN v ON v.f = k.f AND v.pos = (h.pos + digest % (n - 1) + 1) % n GROUP BY r, k.f),
    i AS (SELECT f, round(avg((mixed - whole) / spread), 6) AS importance, round(stddev_pop((mixed - whole) / spread), 6) AS std FROM e GROUP BY f)
    SELECT CAST(row_number() OVER (ORDER BY importance DESC, f) AS INTEGER) AS "rank", list_value('o_custkey', 'month', 'day')[f + 1] AS feature, importance, std FROM i"""


@query("permutation_importance", IMPORTANCE_SQL)
def permutation_importance(spark, sf):
    o = table(spark, sf, "orders").withColumns({"month": F.month("o_orderdate"), "day": F.dayofmonth("o_orderdate")})
    rows = VectorAssembler(inputCols=IMPORTANCE, outputCol="features").transform(
        L.random_holdout(o, "o_orderkey", shares=(0.8, 0.0, 0.2))).select(
        F.col("o_orderkey").alias("row_id"), "features", F.col("o_totalprice").alias("label"), "split")
    model = LinearRegression(solver="normal").fit(rows.where("split = 'train'"))
    return E.permutation_importance(model, rows.where("split = 'test'").drop("split"), IMPORTANCE, "row_id")


@query(
    "partial_dependence",
    f"""WITH {PRICE_FIT}, r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM t WHERE NOT train),
    h AS (SELECT any_value(n) * 0.05::DOUBLE + 0.41::DOUBLE AS lo, any_value(n) * 0.95::DOUBLE + 0.59::DOUBLE AS hi FROM r),
    q AS (SELECT max(x) FILTER (i = floor(lo)) * (1 - (any_value(lo) - floor(any_value(lo)))) + max(x) FILTER (i = ceil(lo)) * (any_value(lo) - floor(any_value(lo))) AS a,
      max(x) FILTER (i = floor(hi)) * (1 - (any_value(hi) - floor(any_value(hi)))) + max(x) FILTER (i = ceil(hi)) * (any_value(hi) - floor(any_value(hi))) AS z FROM r, h)
    SELECT round(q.a + (q.z - q.a) * g / 19.0, 6) AS value, round(m.a * (q.a + (q.z - q.a) * g / 19.0) + m.b, 3) AS mean_prediction
    FROM q, m, range(0, 20) t(g)""",
)
def partial_dependence(spark, sf):
    rows = _price_rows(spark, sf)
    model = LinearRegression(solver="normal").fit(rows.where("split = 'train'"))
    out = E.partial_dependence(model, rows.where("split = 'test'"), 0)
    return out.select(F.round("value", 6).alias("value"), F.round("mean_prediction", 3).alias("mean_prediction"))


@query(
    "linear_shapley",
    f"""WITH {PRICE_FIT}, c AS (SELECT avg(x) AS c FROM t WHERE NOT train)
    SELECT 1 AS "rank", 'l_quantity' AS feature, round(avg(abs(a * (x - c))), 3) AS mean_abs_shapley FROM t, m, c WHERE NOT train""",
)
def linear_shapley(spark, sf):
    rows = _price_rows(spark, sf)
    model = LinearRegression(solver="normal").fit(rows.where("split = 'train'"))
    return rounded(E.linear_shapley(model, rows.where("split = 'test'"), ["l_quantity"]), 3)


@query("sampled_shapley")
def sampled_shapley(spark, sf):
    rows = _price_rows(spark, sf, ["l_quantity", "l_discount"])
    model = LinearRegression().fit(rows.where("split = 'train'"))
    return E.sampled_shapley(model, rows.where("split = 'test'"), ["l_quantity", "l_discount"], "row_id")
