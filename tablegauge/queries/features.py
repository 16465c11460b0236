"""Problem screens, feature, split and metric queries."""

from pyspark.sql import functions as F

from tablegauge.functions import columns as C
from tablegauge.operators import features as G, metrics as M, profile as P, screens as S, splits as L
from tablegauge.queries.registry import DIRTY_EVENTS, dirty_events, query, rounded, table


def _fact_sql(columns, source):
    """Column facts as rows; kind and float flag are known from the schema."""
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS c, '{kind}' AS kind, {is_float} AS is_float, {named} AS named, count(*) AS n, count({c}) AS k,
        count(DISTINCT {c}) AS u, round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS mf,
        round(count(DISTINCT {c}) / nullif(count({c}), 0)::DOUBLE, 6) AS uf FROM {source}"""
        for c, kind, is_float, named in columns
    )


ORDER_COLUMNS = [
    ("o_orderkey", "numeric", "FALSE", "FALSE"),
    ("o_custkey", "numeric", "FALSE", "FALSE"),
    ("o_orderstatus", "categorical", "FALSE", "FALSE"),
    ("o_totalprice", "numeric", "TRUE", "FALSE"),
    ("o_orderdate", "datetime", "FALSE", "FALSE"),
    ("o_orderpriority", "categorical", "FALSE", "FALSE"),
]
ID_SQL = "(named OR (uf >= 0.99 AND (kind = 'categorical' OR (kind = 'numeric' AND NOT is_float))))"
SCORE_SQL = f"""s AS (SELECT c AS "column", {ID_SQL} AS identifier_like,
    (CASE WHEN {ID_SQL} THEN -40 ELSE 15 END
    + CASE WHEN mf = 0 THEN 12 WHEN mf <= 0.2 THEN 6 WHEN mf <= 0.5 THEN 0 ELSE -25 END
    + CASE kind WHEN 'boolean' THEN 18 WHEN 'categorical' THEN CASE WHEN u BETWEEN 2 AND 20 THEN 18 WHEN u <= 50 THEN 6 ELSE -10 END
      WHEN 'numeric' THEN CASE WHEN u BETWEEN 2 AND 20 THEN 14 WHEN uf > 0.5 THEN 12 ELSE 4 END ELSE 4 END)::DOUBLE AS score
    FROM f WHERE k > 0 AND u > 1)"""


@query(
    "target_scores",
    f"""WITH f AS ({_fact_sql(ORDER_COLUMNS, 'orders')}), {SCORE_SQL}
    SELECT CAST(row_number() OVER (ORDER BY score DESC, "column") AS INTEGER) AS "rank", "column", score, identifier_like FROM s""",
)
def target_scores(spark, sf):
    return S.target_scores(P.column_table(table(spark, sf, "orders"))).drop("match")


@query(
    "target_scores_named",
    f"""WITH f AS ({_fact_sql(ORDER_COLUMNS, 'orders')}), {SCORE_SQL}
    SELECT "column", score + CASE "column" WHEN 'o_totalprice' THEN 60 ELSE 0 END AS score,
      CASE "column" WHEN 'o_totalprice' THEN 'exact' ELSE 'none' END AS "match" FROM s""",
)
def target_scores_named(spark, sf):
    facts = P.column_table(table(spark, sf, "orders"))
    return S.target_scores(facts, "model o totalprice by customer").select("column", "score", "match")


@query(
    "target_choice",
    """SELECT 'o_totalprice' AS target, 'named' AS reason WHERE (SELECT count(DISTINCT o_totalprice) FROM orders) > 1""",
)
def target_choice(spark, sf):
    facts = P.column_table(table(spark, sf, "orders"))
    return S.choose_target(S.target_scores(facts, "model o totalprice by customer"))


@query(
    "task_type",
    """SELECT 'o_totalprice' AS target, CASE WHEN count(DISTINCT o_totalprice) = 2 THEN 'binary_classification'
      ELSE 'regression' END AS task FROM orders
    UNION ALL SELECT 'o_orderstatus', CASE WHEN count(DISTINCT o_orderstatus) = 2 THEN 'binary_classification'
      ELSE 'multiclass_classification' END FROM orders""",
)
def task_type(spark, sf):
    facts = C.settle(P.column_table(table(spark, sf, "orders")))
    both = S.task_type(facts, "o_totalprice").unionByName(S.task_type(facts, "o_orderstatus"))
    return both.select("target", "task")


@query(
    "time_column",
    "SELECT 'ts' AS time_column, 'only datetime column' AS reason WHERE (SELECT count(ts) FROM events) > 0",
)
def time_column(spark, sf):
    return S.time_column(P.column_types(table(spark, sf, "events")))


@query(
    "mape_eligibility",
    """SELECT 'value' AS target, count(value) AS n, count(*) FILTER (value = 0) AS zeros,
    count(*) FILTER (value = 0) = 0 AND min(value) >= 0 AS eligible FROM events""",
)
def mape_eligibility(spark, sf):
    return S.mape_eligible(table(spark, sf, "events"), "value")


@query(
    "feasibility",
    """WITH e AS (SELECT ts, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value FROM events),
    b AS (SELECT min(ts) AS a, max(ts) AS z FROM e WHERE value IS NOT NULL)
    SELECT 'warning' AS level, 'target_mostly_missing' AS issue FROM e HAVING 1 - count(value) / count(*)::DOUBLE > 0.2
    UNION ALL SELECT 'blocking', 'target_gaps' FROM e, b WHERE ts BETWEEN a AND z HAVING count(*) > count(value)""",
)
def feasibility(spark, sf):
    e = table(spark, sf, "events").select(
        "ts", "user_id", F.expr("CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END").alias("value")
    )
    return S.feasibility(e, "value", S.FORECASTING, "ts").select("level", "issue")


@query(
    "readiness",
    f"""WITH {DIRTY_EVENTS} SELECT 'warning' AS level, 'target_has_missing' AS issue,
    CAST(count(*) - count(value) AS VARCHAR) AS detail FROM dirty HAVING count(*) > count(value)""",
)
def readiness(spark, sf):
    return S.readiness(dirty_events(spark, sf), "value", S.REGRESSION, 3)


PART_COLUMNS = [
    ("p_partkey", "numeric", "FALSE", "FALSE"),
    ("p_name", "categorical", "FALSE", "FALSE"),
    ("p_brand", "categorical", "FALSE", "FALSE"),
    ("p_type", "categorical", "FALSE", "FALSE"),
    ("p_size", "numeric", "FALSE", "FALSE"),
    ("p_retailprice", "numeric", "TRUE", "FALSE"),
]


@query(
    "inventory",
    f"""WITH f AS ({_fact_sql(PART_COLUMNS, 'part')}) SELECT c AS "column", u AS n_unique,
    c <> 'p_retailprice' AND k > 0 AND u > 1 AND NOT {ID_SQL} AS candidate,
    CASE WHEN c = 'p_retailprice' THEN 'target' WHEN k = 0 THEN 'all_missing' WHEN u <= 1 THEN 'constant'
      WHEN {ID_SQL} THEN 'identifier_like' ELSE '-' END AS excluded_because FROM f""",
)
def inventory(spark, sf):
    stock = G.inventory(P.column_table(table(spark, sf, "part")), "p_retailprice")
    return stock.select("column", "n_unique", "candidate", "excluded_because").na.fill("-", ["excluded_because"])


def _line_variants(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_quantity",
        "l_discount",
        F.col("l_quantity").alias("a_quantity"),
        F.col("l_quantity").cast("int").alias("quantity_int"),
        (F.col("l_quantity") * 2 + F.col("l_tax")).alias("quantity_like"),
        "l_extendedprice",
    )


@query(
    "dup_columns",
    """SELECT 'l_quantity' AS "column", 'a_quantity' AS duplicate_of WHERE (SELECT count(*) FROM lineitem) > 0
    UNION ALL SELECT 'quantity_int', 'a_quantity' FROM lineitem HAVING count(*) FILTER (l_quantity <> floor(l_quantity)) = 0""",
)
def dup_columns(spark, sf):
    return G.duplicate_columns(_line_variants(spark, sf))


@query(
    "redundant_pairs",
    """SELECT 'quantity_like' AS "column", 'l_quantity' AS anchor, round(corr(l_quantity, l_quantity * 2 + l_tax), 6) AS correlation
    FROM lineitem""",
)
def redundant_pairs(spark, sf):
    names = ["l_quantity", "l_discount", "quantity_like", "l_extendedprice"]
    return rounded(G.redundant_pairs(_line_variants(spark, sf), names))


@query(
    "feature_selection",
    """SELECT * FROM (VALUES ('a_quantity', 'retain', 'no_structural_reason', '-'), ('l_discount', 'retain', 'no_structural_reason', '-'),
      ('l_quantity', 'drop', 'duplicate', 'a_quantity'), ('quantity_int', 'drop', 'duplicate', 'a_quantity'),
      ('quantity_like', 'review', 'redundant', 'a_quantity')) t("column", action, reason, related)
    WHERE (SELECT corr(l_quantity, l_quantity * 2 + l_tax) FROM lineitem) >= 0.95""",
)
def feature_selection(spark, sf):
    return G.select_features(_line_variants(spark, sf), "l_extendedprice").na.fill("-", ["related"])


TRANSFORM_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", min({c}) AS lo, max({c}) AS hi, skewness({c}) AS g, avg({c}) AS m, stddev_pop({c}) AS sd,
    count(*) FILTER ({c} = 0) > 0 AS z FROM {t}"""
    for c, t in (("value", "events"), ("shifted", "(SELECT value - avg(value) OVER () AS shifted FROM events)"),
                 ("big", "(SELECT value * 1000 + 500000 AS big FROM events)"))
)


@query(
    "transform_choices",
    f"""WITH f AS ({TRANSFORM_SQL}), r AS (SELECT *, CASE WHEN lo > 0 AND (hi / nullif(lo, 0) >= 1000 OR g >= 2) THEN 'log'
      WHEN hi < 0 AND abs(g) >= 2 THEN 'reciprocal' WHEN lo <= 0 AND lo > -1 AND (z OR lo < 0) AND g >= 2 THEN 'log1p'
      WHEN lo >= 0 AND g >= 1 AND g < 2 THEN 'sqrt' END AS op FROM f)
    SELECT "column", op AS operation FROM r WHERE op IS NOT NULL
    UNION ALL SELECT "column", 'abs' FROM r WHERE lo < 0 AND hi > 0 AND sd > 0 AND abs(m) <= 0.1 * sd
    UNION ALL SELECT "column", 'scale' FROM r WHERE op IS NULL AND greatest(abs(lo), abs(hi)) > 1000""",
)
def transform_choices(spark, sf):
    e = table(spark, sf, "events")
    mean = e.agg(F.avg("value").alias("m"))
    wide = C.attach_row(e, mean).select(
        "value", (F.col("value") - F.col("m")).alias("shifted"), (F.col("value") * 1000 + 500000).alias("big")
    )
    return G.transform_choices(wide)


@query(
    "apply_transforms",
    """SELECT event_id, round(ln(value), 6) AS value__log, round(ln(1 + value), 6) AS value__log1p,
    round(sqrt(value), 6) AS value__sqrt, round(abs(value), 6) AS value__abs, round(1 / value, 6) AS value__reciprocal FROM events""",
)
def apply_transforms(spark, sf):
    operations = ["log", "log1p", "sqrt", "abs", "reciprocal"]
    out = G.apply_transforms(table(spark, sf, "events"), [("value", o) for o in operations])
    return rounded(out.select("event_id", *[f"value__{o}" for o in operations]), how=C.round_scaled)


@query(
    "calendar_choices",
    """SELECT c AS "column", part, part IN ('month', 'day_of_week', 'hour') AS cyclical FROM
      (VALUES ('year'), ('month'), ('day'), ('day_of_week'), ('day_of_year'), ('quarter'), ('hour')) p(part),
      (SELECT 'ts' AS c, max(hour(ts) + minute(ts) + second(ts)) > 0 AS timed FROM events
       UNION ALL SELECT 'day', FALSE) d WHERE part <> 'hour' OR timed""",
)
def calendar_choices(spark, sf):
    e = table(spark, sf, "events").select("ts", F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("day"))
    return G.calendar_choices(e, ["ts", "day"])


@query(
    "calendar",
    """SELECT event_id, year(ts)::DOUBLE AS ts__year, month(ts)::DOUBLE AS ts__month, day(ts)::DOUBLE AS ts__day,
    (isodow(ts) - 1)::DOUBLE AS ts__day_of_week, dayofyear(ts)::DOUBLE AS ts__day_of_year, quarter(ts)::DOUBLE AS ts__quarter,
    hour(ts)::DOUBLE AS ts__hour, round(sin(2 * pi() * (month(ts) - 1) / 12), 6) + 0.0::DOUBLE AS ts__month_sin,
    round(cos(2 * pi() * (month(ts) - 1) / 12), 6) + 0.0::DOUBLE AS ts__month_cos, round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0::DOUBLE AS ts__hour_sin,
    round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0::DOUBLE AS ts__hour_cos FROM events""",
)
def calendar(spark, sf):
    parts = [*G.CALENDAR_PARTS, "hour"]
    out = G.calendar_features(table(spark, sf, "events"), "ts", parts, ["month", "hour"])
    return rounded(out.drop("ts", "user_id", "event_type", "value", "props"))


HOURLY = """h AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS hour, avg(value) AS value FROM events GROUP BY 1, 2)"""


def hourly(spark, sf):
    e = table(spark, sf, "events")
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour")
    return e.groupBy("event_type", hour).agg(F.avg("value").alias("value"))


@query(
    "lags",
    f"""WITH {HOURLY} SELECT event_type, hour, """
    + ", ".join(f"round(lag(value, {k}) OVER (PARTITION BY event_type ORDER BY hour), 9) AS value__lag_{k}" for k in G.LAGS)
    + " FROM h",
)
def lags(spark, sf):
    return rounded(G.temporal_features(hourly(spark, sf), "value", "hour", ["event_type"], windows=()).drop("value"), 9)


ROLLING_SQL = ", ".join(
    f"""round(CASE WHEN count(value) OVER w{w} = {w} THEN avg(value) OVER w{w} END, 9) AS value__rolling_mean_{w},
    round(CASE WHEN count(value) OVER w{w} = {w} THEN stddev_samp(value) OVER w{w} END, 9) AS value__rolling_std_{w}"""
    for w in G.WINDOWS
)


def _windows(partition):
    return ", ".join(
        f"w{w} AS ({partition} ORDER BY hour ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)" for w in G.WINDOWS
    )


@query(
    "rolling",
    f"WITH {HOURLY} SELECT event_type, hour, {ROLLING_SQL} FROM h WINDOW {_windows('PARTITION BY event_type')}",
)
def rolling(spark, sf):
    return rounded(G.temporal_features(hourly(spark, sf), "value", "hour", ["event_type"], lags=()).drop("value"), 9)


ONE_SERIES = """h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, avg(value) AS value FROM events GROUP BY 1)"""


@query(
    "rolling_single_series",
    f"""WITH {ONE_SERIES} SELECT hour, round(lag(value, 1) OVER (ORDER BY hour), 9) AS value__lag_1,
    round(lag(value, 14) OVER (ORDER BY hour), 9) AS value__lag_14, {ROLLING_SQL} FROM h WINDOW {_windows('')}""",
)
def rolling_single_series(spark, sf):
    """One global series, cut into blocks of 100 rows that borrow the tail of the block before."""
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour")
    series = table(spark, sf, "events").groupBy(hour).agg(F.avg("value").alias("value"))
    out = G.temporal_features_sliced(series, "value", "hour", lags=(1, 14), block_rows=100)
    return rounded(out.drop("value"), 9)


@query(
    "lag_plan",
    """WITH n AS (SELECT count(*) AS n FROM events) SELECT 'value' AS "column", 'lag' AS feature, CAST(k AS INTEGER) AS size
      FROM n, (VALUES (1), (2), (3), (7), (14)) t(k) WHERE n.n > k + 10 AND n.n >= 50
    UNION ALL SELECT 'value', f, CAST(w AS INTEGER) FROM n, (VALUES (7), (30)) t(w), (VALUES ('rolling_mean'), ('rolling_std')) s(f)
      WHERE n.n > w + 10 AND n.n >= 50
    UNION ALL SELECT 'user_id', 'lag', 1 FROM n WHERE n.n > 11 AND n.n >= 50""",
)
def lag_plan(spark, sf):
    return G.lag_plan(table(spark, sf, "events"), "value", "ts", ["user_id"])


@query(
    "preprocessing_requirements",
    f"""WITH {DIRTY_EVENTS} SELECT 'value' AS "column", 'imputation' AS operation FROM dirty HAVING count(*) > count(value)
    UNION ALL SELECT 'event_type', 'encoding' FROM dirty HAVING count(DISTINCT event_type) > 1""",
)
def preprocessing_requirements(spark, sf):
    return G.requirements(dirty_events(spark, sf).select("event_type", "user_id", "value"), "user_id")


@query(
    "preprocess_train_only",
    """WITH t AS (SELECT *, event_id % 5 < 4 AS train, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS v FROM events),
    m AS (SELECT quantile_cont(v, 0.5) AS med FROM t WHERE train),
    o AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM t WHERE train),
    s AS (SELECT count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) / count(v)::DOUBLE AS share FROM t, o WHERE train),
    a AS (SELECT avg(coalesce(v, med)) AS mu, stddev_samp(coalesce(v, med)) AS sd FROM t, m WHERE train)
    SELECT event_id, round((coalesce(v, med) - mu) / sd, 5) AS scaled FROM t, m, a, s WHERE share <= 2""",
)
def preprocess_train_only(spark, sf):
    from pyspark.ml.functions import vector_to_array

    e = table(spark, sf, "events").select(
        "event_id", "event_type", F.expr("CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END").alias("v")
    )
    stage = G.Preprocessor(["v"], ["event_type"], robust=False).fit(e.where("event_id % 5 < 4"))
    out = stage.transform(e)
    return rounded(out.select("event_id", F.get(vector_to_array("features"), F.lit(0)).alias("scaled")), 5)


@query(
    "outlier_share",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
    SELECT round(count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) / count(*)::DOUBLE, 6) AS share,
      count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) / count(*)::DOUBLE > 0.05 AS robust
    FROM events, q""",
)
def outlier_share(spark, sf):
    share = G.outlier_share(table(spark, sf, "events"), ["value"])
    return spark.createDataFrame([(round(share, 6), share > G.ROBUST_FROM)], "share double, robust boolean")


@query(
    "log_target",
    """WITH m AS (SELECT avg(value) AS m, min(value) AS low FROM events),
    g AS (SELECT avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5) AS skew, any_value(low) AS low FROM events, m)
    SELECT 'value' AS target, round(skew, 6) AS skew, round(low, 6) AS low, skew > 1 AND low >= 0 AS use_log FROM g""",
)
def log_target(spark, sf):
    return rounded(G.log_target(table(spark, sf, "events"), "value"))


# --- splits and metrics -------------------------------------------------------------------------------------------

UNIT = "CAST(('0x' || substr(md5(CAST({0} AS VARCHAR) || '|42'), 1, 8)) AS BIGINT) % 10000"


@query(
    "split_plan",
    """SELECT 'labels' AS source, CASE WHEN min(n) >= 2 AND count(*) >= 2 THEN 'stratified_holdout' ELSE 'random_holdout' END AS strategy,
      CASE WHEN sum(n) < 200 THEN 0.8 ELSE 0.7 END::DOUBLE AS train_fraction,
      CASE WHEN sum(n) < 200 THEN 0.0 ELSE 0.15 END::DOUBLE AS validation_fraction
    FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)
    UNION ALL SELECT 'events', 'time_ordered_holdout', CASE WHEN count(*) < 200 THEN 0.8 ELSE 0.7 END::DOUBLE,
      CASE WHEN count(*) < 200 THEN 0.0 ELSE 0.15 END::DOUBLE FROM events""",
)
def split_plan(spark, sf):
    a = L.split_plan(table(spark, sf, "labels"), S.BINARY, "toxic").withColumn("source", F.lit("labels"))
    b = L.split_plan(table(spark, sf, "events"), S.FORECASTING, "value").withColumn("source", F.lit("events"))
    return a.unionByName(b).select("source", "strategy", "train_fraction", "validation_fraction")


@query(
    "random_holdout",
    f"""SELECT o_orderkey, CASE WHEN u < 7000 THEN 'train' WHEN u < 8500 THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT o_orderkey, {UNIT.format('o_orderkey')} AS u FROM orders)""",
)
def random_holdout(spark, sf):
    return L.random_holdout(table(spark, sf, "orders"), "o_orderkey").select("o_orderkey", "split")


@query(
    "stratified_holdout",
    f"""SELECT doc_id, toxic, CASE WHEN u < 7000 THEN 'train' WHEN u < 8500 THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT doc_id, toxic, {UNIT.format("(toxic || '|' || doc_id)")} AS u FROM labels)""",
)
def stratified_holdout(spark, sf):
    return L.stratified_holdout(table(spark, sf, "labels"), "doc_id", "toxic").select("doc_id", "toxic", "split")


@query(
    "stratified_holdout_exact",
    f"""WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus
        ORDER BY {UNIT.format('o_orderkey')}, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
    SELECT o_orderkey, CASE WHEN i < 0.7::DOUBLE * n THEN 'train' WHEN i < (0.7::DOUBLE + 0.15::DOUBLE) * n THEN 'validation' ELSE 'test' END AS split FROM r""",
)
def stratified_holdout_exact(spark, sf):
    out = L.stratified_holdout(table(spark, sf, "orders"), "o_orderkey", "o_orderstatus", exact=True)
    return out.select("o_orderkey", "split")


@query(
    "time_holdout",
    """WITH r AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM events),
    c AS (SELECT max(ts) FILTER (i = floor(n * 0.7::DOUBLE + 1e-9) - 1) AS a,
      max(ts) FILTER (i = floor(n * (0.7::DOUBLE + 0.15::DOUBLE) + 1e-9) - 1) AS b FROM r)
    SELECT event_id, CASE WHEN ts <= a THEN 'train' WHEN ts <= b THEN 'validation' ELSE 'test' END AS split FROM events, c""",
)
def time_holdout(spark, sf):
    return L.time_holdout(table(spark, sf, "events"), "ts").select("event_id", "split")


@query(
    "split_counts",
    f"""SELECT o_orderstatus, CASE WHEN u < 7000 THEN 'train' WHEN u < 8500 THEN 'validation' ELSE 'test' END AS split, count(*) AS n
    FROM (SELECT o_orderstatus, {UNIT.format('o_orderkey')} AS u FROM orders) GROUP BY 1, 2""",
)
def split_counts(spark, sf):
    out = L.random_holdout(table(spark, sf, "orders"), "o_orderkey")
    return out.groupBy("o_orderstatus", "split").agg(F.count("*").alias("n"))


@query(
    "chronology",
    """WITH t AS (SELECT event_type, ts, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT sum(n)::BIGINT AS n_rows, 0::BIGINT AS unparseable, count(DISTINCT ts) AS distinct_times,
      sum(n - 1)::BIGINT AS repeated_times, count(DISTINCT ts) >= 2 AS usable FROM t""",
)
def chronology(spark, sf):
    return L.chronology(table(spark, sf, "events"), "ts", ["event_type"])


@query(
    "hash_folds",
    f"""SELECT fold, count(*) AS n FROM (SELECT CAST({UNIT.format('o_orderkey').replace('|42', '|43')} % 5 AS INTEGER) AS fold FROM orders)
    GROUP BY 1""",
)
def hash_folds(spark, sf):
    return L.hash_fold(table(spark, sf, "orders"), "o_orderkey").groupBy("fold").agg(F.count("*").alias("n"))


@query(
    "regression_metrics",
    """WITH r AS (SELECT l_extendedprice AS y, l_quantity * 2000 AS p FROM lineitem),
    e AS (SELECT count(*) AS n, avg(pow(y - p, 2)) AS mse, avg(abs(y - p)) AS mae, var_pop(y) AS v FROM r)
    SELECT n, round(mse, 2) AS mse, round(sqrt(mse), 6) AS rmse, round(mae, 6) AS mae, round(1 - mse / v, 6) AS r2 FROM e""",
)
def regression_metrics(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 2000).alias("prediction")
    )
    return M.regression_metrics(rows).withColumn("mse", F.round("mse", 2))


@query(
    "classification_metrics",
    """WITH r AS (SELECT toxic AS y, quality AS p FROM labels), c AS (SELECT DISTINCT y AS k FROM r UNION SELECT DISTINCT p FROM r),
    m AS (SELECT k, count(*) FILTER (y = k AND p = k)::DOUBLE AS tp, count(*) FILTER (y = k) AS a, count(*) FILTER (p = k) AS b
      FROM c, r GROUP BY k),
    s AS (SELECT coalesce(tp / nullif(b, 0), 0) AS pr, coalesce(tp / nullif(a, 0), 0) AS re, tp FROM m)
    SELECT (SELECT count(*) FROM r) AS n, round(sum(tp) / (SELECT count(*) FROM r), 6) AS accuracy,
      round(avg(pr), 6) AS precision_macro, round(avg(re), 6) AS recall_macro,
      round(avg(coalesce(2 * pr * re / nullif(pr + re, 0), 0)), 6) AS f1_macro FROM s""",
)
def classification_metrics(spark, sf):
    rows = table(spark, sf, "labels").select(F.col("toxic").alias("label"), F.col("quality").alias("prediction"))
    return M.classification_metrics(rows)


@query(
    "roc_auc",
    """WITH r AS (SELECT l.toxic AS y, d.n_chars AS s, rank() OVER (ORDER BY d.n_chars) + (count(*) OVER (PARTITION BY d.n_chars) - 1) / 2.0 AS r
      FROM labels l JOIN documents d USING (doc_id)),
    c AS (SELECT sum(r) FILTER (y = 1) AS rs, count(*) FILTER (y = 1)::DOUBLE AS p, count(*) FILTER (y = 0)::DOUBLE AS q FROM r)
    SELECT round((rs - p * (p + 1) / 2) / (p * q), 6) AS roc_auc FROM c""",
)
def roc_auc(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return M.roc_auc(rows.select(F.col("toxic").alias("label"), F.col("n_chars").alias("score")))


@query(
    "cluster_metrics",
    """WITH p AS (SELECT label AS c, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i, vec_id FROM embeddings),
    m AS (SELECT c, i, avg(x) AS m FROM p GROUP BY 1, 2), g AS (SELECT i, avg(x) AS m FROM p GROUP BY 1),
    d AS (SELECT p.c, vec_id, sum(pow(x - m.m, 2)) AS d2 FROM p JOIN m ON m.c = p.c AND m.i = p.i GROUP BY 1, 2),
    s AS (SELECT c, count(*) AS n, avg(sqrt(d2)) AS s, sum(d2) AS w FROM d GROUP BY 1),
    b AS (SELECT sum(s.n * pow(m.m - g.m, 2)) AS b FROM m JOIN s ON s.c = m.c JOIN g ON g.i = m.i),
    k AS (SELECT count(*) AS k, sum(n)::BIGINT AS n, sum(w) AS w FROM s),
    r AS (SELECT a.c, max((a.s + z.s) / dist) AS r FROM s a JOIN s z ON a.c <> z.c JOIN
      (SELECT u.c AS c1, v.c AS c2, sqrt(sum(pow(u.m - v.m, 2))) AS dist FROM m u JOIN m v ON u.i = v.i AND u.c <> v.c GROUP BY 1, 2) q
      ON q.c1 = a.c AND q.c2 = z.c GROUP BY 1)
    SELECT k.k AS k, k.n AS n, round((b.b / (k.k - 1)) / (k.w / (k.n - k.k)), 4) AS calinski_harabasz,
      round((SELECT avg(r) FROM r), 4) AS davies_bouldin FROM k, b""",
)
def cluster_metrics(spark, sf):
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, sf, "embeddings").select(
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").alias("prediction")
    )
    return rounded(M.cluster_metrics(rows, silhouette=False), 4)
