"""Saved models that predict raw rows, and linear sweeps that are cross validated from one scan.

Least squares on one number and one category has a closed form (a common slope inside groups); so have penalised fits on
one or two standardised numbers.
"""

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tablegauge.functions import columns as C
from tablegauge.operators import gram, models as K, screens as S, splits as L
from tablegauge.plans import prediction as P
from tablegauge.queries.features import UNIT
from tablegauge.queries.registry import query, table
from tablegauge.session import scratch_folder


def _raw_orders(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.expr("CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END").alias("customer"),
        F.expr("CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END").alias("priority"), F.col("o_totalprice").alias("price"))


def _saved_orders(spark, sf):
    """Folder with a linear model of the raw rows under the name ``orders``."""
    root = scratch_folder(spark, "models")
    # all categories and the intercept are one column too many; a trace of a penalty keeps the normal equations solvable
    linear = K.Candidate("linear_regression", "linear", LinearRegression(solver="normal", regParam=1e-5))
    P.save(P.refit(_raw_orders(spark, sf), "price", S.REGRESSION, linear, ["customer"], ["priority"]), root, "orders")
    return root


@query(
    "predict_raw_rows",
    """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END AS x, o_totalprice AS y,
      CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS g FROM orders),
    c AS (SELECT median(x) AS mid FROM o),
    k AS (SELECT g AS usual FROM o WHERE g IS NOT NULL GROUP BY g ORDER BY count(*) DESC, g LIMIT 1),
    f AS (SELECT o_orderkey, coalesce(x, mid)::DOUBLE AS x, coalesce(g, usual) AS g, y FROM o, c, k),
    m AS (SELECT g, avg(x) AS mx, avg(y) AS my FROM f GROUP BY g),
    b AS (SELECT sum((x - mx) * (y - my)) / sum(pow(x - mx, 2)) AS slope FROM f JOIN m USING (g))
    SELECT o_orderkey, round(my + slope * (x - mx), 0) AS predicted FROM f JOIN m USING (g), b""",
)
def predict_raw_rows(spark, sf):
    """Fitted on raw columns with gaps, saved whole, loaded, and applied to the raw rows without their target."""
    found = P.predict_saved(spark, _saved_orders(spark, sf), "orders", _raw_orders(spark, sf).drop("price"))
    return found.rows.select("o_orderkey", F.round("predicted", 0).alias("predicted"))


@query("predict_missing_columns", """SELECT 'customer' AS "column", 0 AS position UNION ALL SELECT 'priority', 1""")
def predict_missing_columns(spark, sf):
    """The columns that a saved model needs and a table does not have."""
    return P.predict_saved(spark, _saved_orders(spark, sf), "orders", _raw_orders(spark, sf).select("o_orderkey", "price")).missing


def _line_rows(spark, sf, inputs):
    li = table(spark, sf, "lineitem").withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    rows = VectorAssembler(inputCols=inputs, outputCol="features").transform(L.hash_fold(li, "row_id"))
    return rows.select("row_id", "features", F.col("l_extendedprice").alias("label"), "fold")


LINES = f"""t AS (SELECT CAST({UNIT.format('row_id').replace('|42', '|43')} % 5 AS INTEGER) AS fold, x1, x2, y
      FROM (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_quantity::DOUBLE AS x1, l_discount::DOUBLE AS x2, l_extendedprice::DOUBLE AS y FROM lineitem)),
    folds AS (SELECT DISTINCT fold AS out FROM t),
    m AS (SELECT out, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS d1, stddev_pop(x2) AS d2,
      covar_pop(x1, x2) AS c12, covar_pop(y, x1) AS c1, covar_pop(y, x2) AS c2 FROM t JOIN folds ON fold <> out GROUP BY out)"""


@query(
    "ridge_cv_gram",
    f"""WITH {LINES},
    a AS (SELECT * FROM (VALUES ('linear', 0.0), ('ridge_0.001', 0.001), ('ridge_0.01', 0.01), ('ridge_0.1', 0.1), ('ridge_1', 1.0), ('ridge_10', 10.0),
      ('ridge_100', 100.0), ('ridge_1000', 1000.0)) v(candidate, alpha)),
    b AS (SELECT *, n * c12 / (d1 * d2) AS r, n * c1 / d1 AS q1, n * c2 / d2 AS q2, n + alpha::DOUBLE AS d FROM m, a),
    w AS (SELECT *, (q1 * d - r * q2) / (d * d - r * r) / d1 AS w1, (q2 * d - r * q1) / (d * d - r * r) / d2 AS w2 FROM b),
    e AS (SELECT candidate, fold, y, y - (my + w1 * (x1 - m1) + w2 * (x2 - m2)) AS e FROM t JOIN w ON fold = out)
    SELECT candidate, fold, count(*) AS n, round(sqrt(avg(e * e)), 3) AS rmse, round(1 - avg(e * e) / var_pop(y), 6) AS r2
    FROM e GROUP BY candidate, fold""",
)
def ridge_cv_gram(spark, sf):
    """Least squares and all ridge penalties, each fold, from one scan of the rows."""
    found = gram.grams(_line_rows(spark, sf, ["l_quantity", "l_discount"]))
    rows = gram.cross_validated(spark, found, [c for c in gram.linear_grid() if c.l1 is None])
    return rows.select("candidate", "fold", "n", F.round("rmse", 3).alias("rmse"), C.signed_round(F.col("r2"), 6).alias("r2"))


GRID = ", ".join(f"('{c.name}', {c.alpha!r}::DOUBLE, {'NULL' if c.l1 is None else repr(c.l1)}::DOUBLE)" for c in gram.linear_grid())


@query(
    "linear_sweep_cv",
    f"""WITH {LINES}, a AS (SELECT * FROM (VALUES {GRID}) v(candidate, alpha, l1)),
    w AS (SELECT *, CASE WHEN l1 IS NULL THEN n * c1 / d1 / (n + alpha) ELSE
      sign(c1) * greatest(abs(c1 / d1) - alpha * l1, 0) / (1 + alpha * (1 - l1)) END / d1 AS w1 FROM m, a),
    e AS (SELECT candidate, fold, sqrt(avg(pow(y - (my + w1 * (x1 - m1)), 2))) AS rmse FROM t JOIN w ON fold = out GROUP BY candidate, fold)
    SELECT candidate, count(*) AS folds, round(avg(rmse), 3) AS mean, round(stddev_pop(rmse), 3) AS std FROM e GROUP BY candidate""",
)
def linear_sweep_cv(spark, sf):
    """The whole grid of the linear family, cross validated."""
    ranked = gram.sweep_cross_validated(_line_rows(spark, sf, ["l_quantity"]), S.REGRESSION, [])
    return ranked.select("candidate", "folds", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"))


FORECAST_STEPS = 6


@query(
    "modeling_run_forecast",
    f"""WITH h AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS hour, avg(value) AS y FROM events GROUP BY 1, 2),
    o AS (SELECT hour, row_number() OVER (ORDER BY hour) AS i, count(*) OVER () AS n FROM h),
    c AS (SELECT max(hour) FILTER (i = greatest(1, floor(n * 0.7 + 1e-9))) AS c1, max(hour) FILTER (i = greatest(1, floor(n * 0.85 + 1e-9))) AS c2 FROM o),
    r AS (SELECT hour, y, lead(hour) OVER w AS next_hour, {', '.join(f'lead(y, {k}) OVER w AS y{k}' for k in range(1, FORECAST_STEPS + 1))},
      lead(hour, {FORECAST_STEPS}) OVER w AS last_hour FROM h WINDOW w AS (PARTITION BY event_type ORDER BY hour)),
    m AS (SELECT regr_slope(y1, y) AS b, regr_intercept(y1, y) AS a FROM r, c WHERE next_hour <= c1),
    p AS (SELECT *, {', '.join(f"a * {'+'.join(['1.0', *(f'pow(b, {j})' for j in range(1, k))]).join('()')} + pow(b, {k}) * y AS p{k}" for k in range(1, FORECAST_STEPS + 1))}
      FROM r, m, c WHERE hour > c2 AND last_hour IS NOT NULL)
    """
    + " UNION ALL ".join(f"SELECT {k} AS step, count(*) AS n, round(sqrt(avg(pow(y{k} - p{k}, 2))), 6) AS rmse FROM p" for k in range(1, FORECAST_STEPS + 1)),
)
def modeling_run_forecast(spark, sf):
    """Time split, lagged rows, training and errors by step in one call, with a model of one lag."""
    from tablegauge.plans.forecast_run import forecast_table
    from tablegauge.queries.features import hourly

    linear = K.Candidate("linear_regression", "linear", LinearRegression(solver="normal"))
    result = forecast_table(hourly(spark, sf), "value", "hour", ["event_type"], lags=(1,), windows=(), horizon=FORECAST_STEPS, candidates=[linear])
    return result.errors
