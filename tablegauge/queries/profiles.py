"""Profiling, quality and filter queries."""

from pyspark.sql import functions as F

from tablegauge.operators import filters, profile as P, quality as Q
from tablegauge.queries.registry import DIRTY_EVENTS, DIRTY_PART, dirty_events, dirty_part, query, rounded, table

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _numeric_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", count({column}) AS "count", round(avg({column}), 6) AS mean,
      round(stddev_samp({column}), 6) AS std, min({column}) AS minimum,
      round(quantile_cont({column}, 0.25), 6) AS q25, round(quantile_cont({column}, 0.5), 6) AS median,
      round(quantile_cont({column}, 0.75), 6) AS q75, max({column}) AS maximum FROM lineitem"""


@query("profile_numeric", " UNION ALL ".join(map(_numeric_sql, LINE_NUMBERS)))
def profile_numeric(spark, sf):
    return rounded(P.numeric_profile(table(spark, sf, "lineitem"), LINE_NUMBERS))


@query(
    "profile_header",
    "SELECT count(*) AS n_rows, 4 AS n_columns, 's_suppkey,s_name,s_nationkey,s_acctbal' AS column_names FROM supplier",
)
def profile_header(spark, sf):
    return P.table_header(table(spark, sf, "supplier"))


def _missing_sql(columns, source, digits=4):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS missing_count,
        round(100.0 * (count(*) - count({c})) / count(*)::DOUBLE, {digits}) AS missing_percentage FROM {source}"""
        for c in columns
    )


DIRTY_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "amount_text"]


@query("profile_missing", f"WITH {DIRTY_EVENTS} " + _missing_sql(DIRTY_COLUMNS, "dirty"))
def profile_missing(spark, sf):
    return P.missing_counts(dirty_events(spark, sf))


@query(
    "profile_total_missing",
    f"""WITH {DIRTY_EVENTS} SELECT CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS total_missing_cells
    FROM dirty""",
)
def profile_total_missing(spark, sf):
    return P.total_missing_cells(dirty_events(spark, sf))


@query(
    "profile_distinct",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_count FROM lineitem"""
        for c in ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]
    ),
)
def profile_distinct(spark, sf):
    columns = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]
    return P.distinct_counts(table(spark, sf, "lineitem"), columns)


def _top_sql(columns, source, k):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", value, n, position FROM (
          SELECT value, n, CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS position FROM (
            SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY 1))
        WHERE position <= {k}"""
        for c in columns
    )


@query("profile_categorical_topk", _top_sql(["o_orderpriority", "o_orderstatus"], "orders", 5))
def profile_categorical_topk(spark, sf):
    return P.top_values(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"])


@query(
    "profile_categorical",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS distinct_count, min(value) FILTER (position = 1) AS most_frequent,
        min(n) FILTER (position = 1) AS most_frequent_count,
        '[' || string_agg('"' || value || '"', ',' ORDER BY position) FILTER (position <= 5) || ']' AS sample_values
        FROM (SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS position FROM (
          SELECT {c} AS value, count(*) AS n FROM part GROUP BY 1))"""
        for c in ["p_brand", "p_type"]
    ),
)
def profile_categorical(spark, sf):
    return P.categorical_profile(table(spark, sf, "part"), ["p_brand", "p_type"])


@query(
    "profile_datetime",
    """SELECT 'ts' AS "column", strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS minimum,
    strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS maximum, count(ts) AS "count" FROM events
    UNION ALL SELECT 'day_text', strftime(min(ts)::DATE, '%Y-%m-%dT%H:%M:%S'),
    strftime(max(ts)::DATE, '%Y-%m-%dT%H:%M:%S'), count(ts) FROM events""",
)
def profile_datetime(spark, sf):
    e = table(spark, sf, "events").select("ts", F.date_format("ts", "yyyy-MM-dd").alias("day_text"))
    return P.datetime_profile(e, ["ts", "day_text"])


@query(
    "profile_types",
    """SELECT * FROM (VALUES ('event_id', 0, 'bigint', 'numeric'), ('day_text', 1, 'string', 'datetime'),
    ('event_type', 2, 'string', 'categorical'), ('ts', 3, 'timestamp_ntz', 'datetime'),
    ('empty', 4, 'string', 'unknown'), ('flag', 5, 'boolean', 'boolean')) AS t("column", position, storage_type,
    inferred_type) WHERE (SELECT count(*) FROM events) > 0""",
)
def profile_types(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd").alias("day_text"),
        "event_type",
        "ts",
        F.lit(None).cast("string").alias("empty"),
        (F.col("user_id") > 5).alias("flag"),
    )
    return P.column_types(e)


@query(
    "profile_duplicates",
    f"""WITH {DIRTY_EVENTS} SELECT sum(c)::BIGINT AS n_rows, sum(c - 1)::BIGINT AS duplicate_rows,
    round(100.0 * sum(c - 1)::DOUBLE / sum(c)::DOUBLE, 4) AS duplicate_percentage FROM (
      SELECT count(*) AS c FROM dirty GROUP BY event_id, ts, user_id, event_type, value, amount_text)""",
)
def profile_duplicates(spark, sf):
    return P.duplicate_rows(dirty_events(spark, sf))


@query(
    "column_statistics",
    f"""WITH {DIRTY_EVENTS} SELECT 'value' AS "column", count(value) AS "count", count(*) - count(value) AS missing_count,
    count(DISTINCT value) AS unique_count, min(value) AS minimum, max(value) AS maximum, round(avg(value), 6) AS mean,
    round(quantile_cont(value, 0.5), 6) AS median FROM dirty""",
)
def column_statistics(spark, sf):
    return rounded(P.column_statistics(dirty_events(spark, sf), "value"))


@query("full_profile")
def full_profile(spark, sf):
    return P.profile(table(spark, sf, "orders"))


@query(
    "quality_missing",
    f"""WITH {DIRTY_EVENTS}, m AS (SELECT count(*) - count(value) AS k, count(*) AS n FROM dirty)
    SELECT 'missing_values:value' AS finding_id,
      CASE WHEN p <= 5 THEN 'low' WHEN p <= 20 THEN 'medium' WHEN p <= 50 THEN 'high' ELSE 'critical' END AS severity,
      'value' AS "column", k AS affected_rows, p AS affected_percentage
    FROM (SELECT k, round(100.0 * k / n::DOUBLE, 4) AS p FROM m) WHERE k > 0""",
)
def quality_missing(spark, sf):
    findings = Q.missing_findings(P.missing_counts(dirty_events(spark, sf)))
    return findings.select("finding_id", "severity", "column", "affected_rows", "affected_percentage")


@query(
    "quality_duplicates",
    f"""WITH {DIRTY_EVENTS}, g AS (SELECT count(*) AS c FROM dirty
      GROUP BY event_id, ts, user_id, event_type, value, amount_text),
    d AS (SELECT sum(c - 1)::BIGINT AS k, round(100.0 * sum(c - 1)::DOUBLE / sum(c)::DOUBLE, 4) AS p FROM g)
    SELECT 'duplicate_rows:_dataset_' AS finding_id,
      CASE WHEN p <= 1 THEN 'low' WHEN p <= 10 THEN 'medium' ELSE 'high' END AS severity,
      k AS affected_rows, p AS affected_percentage FROM d WHERE k > 0""",
)
def quality_duplicates(spark, sf):
    findings = Q.duplicate_findings(P.duplicate_rows(dirty_events(spark, sf)))
    return findings.select("finding_id", "severity", "affected_rows", "affected_percentage")


@query(
    "quality_datetime_text",
    """SELECT 'potential_type_mismatch:day_text' AS finding_id, 'medium' AS severity, 'day_text' AS "column",
    0.9::DOUBLE AS confidence WHERE (SELECT count(ts) FROM events) > 0""",
)
def quality_datetime_text(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day_text"), "ts")
    return Q.datetime_text_findings(P.column_types(e)).select("finding_id", "severity", "column", "confidence")


@query(
    "quality_text_numbers",
    f"""WITH {DIRTY_EVENTS}, r AS (
      SELECT 'amount_text' AS "column", count(amount_text) AS n_values,
        count(TRY_CAST(amount_text AS DOUBLE)) AS n_numeric,
        (SELECT min(amount_text) FROM dirty WHERE TRY_CAST(amount_text AS DOUBLE) IS NULL) AS example FROM dirty)
    SELECT "column", round(n_numeric / n_values::DOUBLE, 4) AS confidence, example FROM r
    WHERE n_numeric >= 0.9 * n_values""",
)
def quality_text_numbers(spark, sf):
    df = dirty_events(spark, sf)
    found = Q.numeric_text_findings(df, P.column_types(df))
    return found.select(
        "column",
        "confidence",
        F.get_json_object("observed", "$.example_non_numeric_values[0]").alias("example"),
    )


@query(
    "quality_inconsistent_categories",
    f"""WITH {DIRTY_PART}, v AS (SELECT p_type AS value, lower(trim(p_type)) AS normalised, count(*) AS n
      FROM dirty_part GROUP BY 1, 2)
    SELECT normalised, count(*) AS spellings, sum(n)::BIGINT AS n FROM v GROUP BY 1 HAVING count(*) > 1""",
)
def quality_inconsistent_categories(spark, sf):
    groups = Q.category_variants(dirty_part(spark, sf), ["p_type"])
    return groups.select("normalised", F.size("variants").cast("long").alias("spellings"), "n")


def _fence_sql(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS "column", count(*) AS n_rows, count({column}) AS n_values, round(any_value(q1), 6) AS q1,
      round(any_value(q3), 6) AS q3, round(any_value(q1 - 1.5 * (q3 - q1)), 6) AS lower_fence,
      round(any_value(q3 + 1.5 * (q3 - q1)), 6) AS upper_fence,
      count(*) FILTER ({column} < q1 - 1.5 * (q3 - q1) OR {column} > q3 + 1.5 * (q3 - q1)) AS outlier_count,
      min({column}) FILTER ({column} < q1 - 1.5 * (q3 - q1) OR {column} > q3 + 1.5 * (q3 - q1)) AS min_outlier,
      max({column}) FILTER ({column} < q1 - 1.5 * (q3 - q1) OR {column} > q3 + 1.5 * (q3 - q1)) AS max_outlier
      FROM {source}, (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {source})"""


@query(
    "quality_iqr_outliers", _fence_sql("o_totalprice", "orders")
)
def quality_iqr_outliers(spark, sf):
    return rounded(Q.outlier_fences(table(spark, sf, "orders"), ["o_totalprice"]))


@query("quality_iqr_outliers_heavy_tail", _fence_sql("value", "events"))
def quality_iqr_outliers_heavy_tail(spark, sf):
    return rounded(Q.outlier_fences(table(spark, sf, "events"), ["value"]))


@query(
    "quality_skew",
    """WITH s AS (SELECT 'value' AS "column", skewness(value) AS g, count(value) AS n FROM events
      UNION ALL SELECT 'event_id', skewness(event_id), count(*) FROM events)
    SELECT "column", CASE WHEN abs(g) >= 2 THEN 'medium' ELSE 'low' END AS severity,
      round(g, 4) AS skewness FROM s WHERE abs(g) >= 1 AND n >= 8""",
)
def quality_skew(spark, sf):
    found = Q.skew_findings(table(spark, sf, "events"), ["value", "event_id"])
    return found.select(
        "column", "severity", F.get_json_object("observed", "$.skewness").cast("double").alias("skewness")
    )


@query(
    "quality_class_imbalance",
    """WITH c AS (SELECT CAST(toxic AS VARCHAR) AS label, count(*) AS n FROM labels GROUP BY 1),
    r AS (SELECT count(*) AS n_classes, max(n) AS majority, min(n) AS minority, max(n)::DOUBLE / min(n) AS ratio FROM c)
    SELECT n_classes, majority, minority, (SELECT label FROM c ORDER BY n DESC, label LIMIT 1) AS majority_class,
      (SELECT label FROM c ORDER BY n, label DESC LIMIT 1) AS minority_class, round(ratio, 4) AS imbalance_ratio FROM r""",
)
def quality_class_imbalance(spark, sf):
    return rounded(
        Q.imbalance_table(table(spark, sf, "labels"), "toxic").select(
            "n_classes", "majority", "minority", "majority_class", "minority_class", "imbalance_ratio"
        ),
        4,
    )


REPORT_SQL = f"""WITH {DIRTY_EVENTS}, n AS (SELECT count(*)::DOUBLE AS n FROM dirty),
    miss AS (SELECT round(100.0 * (count(*) - count(value)) / count(*)::DOUBLE, 4) AS p FROM dirty),
    dup AS (SELECT round(100.0 * sum(c - 1)::DOUBLE / sum(c)::DOUBLE, 4) AS p FROM (SELECT count(*) AS c FROM dirty
      GROUP BY event_id, ts, user_id, event_type, value, amount_text)),
    num AS (SELECT event_id::DOUBLE AS x, 'event_id' AS c FROM dirty UNION ALL SELECT user_id, 'user_id' FROM dirty
      UNION ALL SELECT value, 'value' FROM dirty WHERE value IS NOT NULL),
    q AS (SELECT c, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, skewness(x) AS g, count(*) AS k FROM num
      GROUP BY c),
    o AS (SELECT q.c, round(100.0 * count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))
      / any_value(n.n), 4) AS p FROM num JOIN q ON num.c = q.c CROSS JOIN n WHERE k >= 8 AND q1 <> q3 GROUP BY q.c),
    f AS (
      SELECT 'missing_values' AS finding_type, 'value' AS "column",
        CASE WHEN p <= 5 THEN 'low' WHEN p <= 20 THEN 'medium' WHEN p <= 50 THEN 'high' ELSE 'critical' END AS severity
        FROM miss WHERE p > 0
      UNION ALL SELECT 'duplicate_rows', NULL,
        CASE WHEN p <= 1 THEN 'low' WHEN p <= 10 THEN 'medium' ELSE 'high' END FROM dup WHERE p > 0
      UNION ALL SELECT 'potential_type_mismatch', 'amount_text', 'medium' FROM dirty
        HAVING count(TRY_CAST(amount_text AS DOUBLE)) >= 0.9 * count(amount_text)
      UNION ALL SELECT 'potential_outliers', c, CASE WHEN p <= 5 THEN 'low' ELSE 'medium' END FROM o WHERE p > 0
      UNION ALL SELECT 'high_skew', c, CASE WHEN abs(g) >= 2 THEN 'medium' ELSE 'low' END FROM q WHERE abs(g) >= 1)"""


@query("quality_report", REPORT_SQL + ' SELECT finding_type, "column", severity FROM f')
def quality_report(spark, sf):
    return Q.run_checks(dirty_events(spark, sf)).select("finding_type", "column", "severity")


@query(
    "quality_summary",
    REPORT_SQL
    + """ SELECT count(*) AS total_findings, count(*) FILTER (severity = 'low') AS n_low,
    count(*) FILTER (severity = 'medium') AS n_medium, count(*) FILTER (severity = 'high') AS n_high,
    count(*) FILTER (severity = 'critical') AS n_critical, count(DISTINCT "column") AS columns_with_findings,
    greatest(0.0, 100.0 - sum(CASE severity WHEN 'low' THEN 2 WHEN 'medium' THEN 6 WHEN 'high' THEN 15 ELSE 35 END)
      )::DOUBLE AS score FROM f""",
)
def quality_summary(spark, sf):
    return Q.summarise(Q.run_checks(dirty_events(spark, sf))).select(
        "total_findings", "n_low", "n_medium", "n_high", "n_critical", "columns_with_findings", "score"
    )


@query(
    "quality_before_after",
    """WITH b AS (SELECT * FROM (VALUES ('missing_values', 1), ('duplicate_rows', 1)) t(finding_type, k)),
    a AS (SELECT * FROM (VALUES ('missing_values', 0), ('duplicate_rows', 0)) t(finding_type, k))
    SELECT b.finding_type, b.k::BIGINT AS before, a.k::BIGINT AS after,
      CASE WHEN a.k < b.k THEN 'improved' WHEN a.k > b.k THEN 'regressed' ELSE 'unchanged' END AS change
    FROM b JOIN a ON a.finding_type = b.finding_type WHERE (SELECT count(*) FROM events WHERE event_id % 50 = 0) > 0""",
)
def quality_before_after(spark, sf):
    before = dirty_events(spark, sf)
    after = table(spark, sf, "events")
    checks = ["missing_values", "duplicate_rows"]
    return Q.compare_findings(Q.run_checks(before, checks=checks), Q.run_checks(after, checks=checks))


@query(
    "slicer_filter",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem
    WHERE l_returnflag IN ('R', 'A') AND l_quantity BETWEEN 10 AND 20
      AND l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'
      AND (contains(lower(l_returnflag), 'r') OR contains(lower(l_linestatus), 'r'))""",
)
def slicer_filter(spark, sf):
    return filters.slice_rows(
        table(spark, sf, "lineitem"),
        categories={"l_returnflag": ["R", "A"]},
        ranges={"l_quantity": (10, 20)},
        dates={"l_shipdate": ("1996-01-01", "1996-12-31")},
        search="R",
        search_columns=["l_returnflag", "l_linestatus"],
    ).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("category_filter", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P')")
def category_filter(spark, sf):
    o = table(spark, sf, "orders")
    return o.where(filters.category_condition({"o_orderstatus": ["F", "P"]})).select("o_orderkey", "o_orderpriority")


@query(
    "complete_case_filter",
    f"WITH {DIRTY_EVENTS} SELECT event_id, value FROM dirty WHERE value IS NOT NULL AND user_id IS NOT NULL",
)
def complete_case_filter(spark, sf):
    return filters.complete_cases(dirty_events(spark, sf), ["value", "user_id"]).select("event_id", "value")


@query(
    "finite_filter",
    """SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'inf'::DOUBLE
    WHEN event_id % 11 = 0 THEN 'nan'::DOUBLE ELSE value END AS v FROM events) WHERE isfinite(v)""",
)
def finite_filter(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id",
        F.expr(
            "CASE WHEN event_id % 7 = 0 THEN double('Infinity') WHEN event_id % 11 = 0 THEN double('NaN') ELSE value END"
        ).alias("v"),
    )
    return filters.finite_rows(e, "v").select("event_id")


@query(
    "slicer_values",
    "SELECT DISTINCT trim(c_mktsegment) AS value FROM customer WHERE trim(c_mktsegment) <> ''",
)
def slicer_values(spark, sf):
    return filters.distinct_values(table(spark, sf, "customer"), "c_mktsegment")


@query("numeric_bounds", "SELECT min(value) AS minimum, max(value) AS maximum FROM events")
def numeric_bounds(spark, sf):
    return filters.numeric_bounds(table(spark, sf, "events"), "value")


@query(
    "feature_projection",
    "SELECT o_custkey, o_orderkey, o_orderpriority, o_orderstatus FROM orders",
)
def feature_projection(spark, sf):
    return filters.project_features(table(spark, sf, "orders"), "o_totalprice")


@query(
    "trim_unobserved_target",
    """WITH e AS (SELECT event_id, ts, CASE WHEN event_id < 100 OR event_id % 9 = 0 THEN NULL ELSE value END AS y
      FROM events),
    b AS (SELECT min(ts) AS a, max(ts) AS z FROM e WHERE y IS NOT NULL)
    SELECT event_id FROM e, b WHERE ts BETWEEN a AND z""",
)
def trim_unobserved_target(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", "ts", F.expr("CASE WHEN event_id < 100 OR event_id % 9 = 0 THEN NULL ELSE value END").alias("y")
    )
    return filters.trim_unobserved_ends(e, "y", "ts").select("event_id")
