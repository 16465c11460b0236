"""Cleaning queries: plans, transforms on the dirty views, sequential execution."""

from pyspark.sql import functions as F

from tablegauge.functions import columns as C
from tablegauge.operators import cleaning as K, profile as P, quality as Q
from tablegauge.queries.profiles import REPORT_SQL
from tablegauge.queries.registry import DIRTY_EVENTS, DIRTY_PART, dirty_events, dirty_part, query, rounded, table


@query(
    "clean_impute_median",
    f"""WITH {DIRTY_EVENTS} SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM dirty)), 6) AS value
    FROM dirty""",
)
def clean_impute_median(spark, sf):
    return rounded(K.impute_median(dirty_events(spark, sf), "value").select("event_id", "value"))


@query(
    "clean_impute_median_train_scope",
    f"""WITH {DIRTY_EVENTS} SELECT event_id, round(coalesce(value,
      (SELECT quantile_cont(value, 0.5) FROM dirty WHERE ts < TIMESTAMP '2024-01-20')), 6) AS value FROM dirty""",
)
def clean_impute_median_train_scope(spark, sf):
    train = F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")
    return rounded(K.impute_median(dirty_events(spark, sf), "value", fit=train).select("event_id", "value"))


@query(
    "clean_impute_mode",
    """WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders)
    SELECT o_orderkey, coalesce(p, (SELECT p FROM d WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1)) AS p
    FROM d""",
)
def clean_impute_mode(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END").alias("p")
    )
    return K.impute_mode(o, "p")


@query("clean_dedup", f"WITH {DIRTY_EVENTS} SELECT DISTINCT event_id, user_id, event_type, value, amount_text FROM dirty")
def clean_dedup(spark, sf):
    return K.drop_duplicate_rows(dirty_events(spark, sf)).select(
        "event_id", "user_id", "event_type", "value", "amount_text"
    )


@query("clean_text_to_number", "SELECT event_id, event_id % 97 AS amount FROM events")
def clean_text_to_number(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.expr("' ' || CAST(event_id % 97 AS STRING)").alias("amount")
    )
    return K.text_to_number(e, "amount")


@query(
    "clean_text_to_number_refused",
    f"""WITH {DIRTY_EVENTS} SELECT TRUE AS refused FROM dirty
    HAVING count(*) FILTER (amount_text IS NOT NULL AND TRY_CAST(amount_text AS DOUBLE) IS NULL) > 0""",
)
def clean_text_to_number_refused(spark, sf):
    try:
        K.text_to_number(dirty_events(spark, sf), "amount_text")
        refused = False
    except K.CleaningRefused:
        refused = True
    return spark.createDataFrame([(refused,)], "refused boolean")


@query("clean_text_to_timestamp", "SELECT event_id, date_trunc('minute', ts)::TIMESTAMP AS moment FROM events")
def clean_text_to_timestamp(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.date_format("ts", "dd/MM/yyyy 'at' HH:mm").alias("moment"))
    out = K.text_to_timestamp(e, "moment", "%d/%m/%Y at %H:%M")
    return out.withColumn("moment", F.col("moment").cast("timestamp_ntz"))


@query("clean_trim", f"WITH {DIRTY_PART} SELECT p_partkey, regexp_replace(trim(p_type), '\\s+', ' ', 'g') AS p_type FROM dirty_part")
def clean_trim(spark, sf):
    return K.trim_whitespace(dirty_part(spark, sf), "p_type").select("p_partkey", "p_type")


@query(
    "clean_standardise",
    f"""WITH {DIRTY_PART}, v AS (SELECT p_type AS value, lower(trim(p_type)) AS k, count(*) AS n FROM dirty_part GROUP BY 1, 2),
    b AS (SELECT k, value AS canonical FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, value) AS r FROM v)
      WHERE r = 1)
    SELECT p_partkey, b.canonical AS p_type FROM dirty_part JOIN b ON lower(trim(p_type)) = b.k""",
)
def clean_standardise(spark, sf):
    return K.standardise_spellings(dirty_part(spark, sf), "p_type").select("p_partkey", "p_type")


@query("clean_log", "SELECT event_id, round(ln(value), 6) AS value FROM events")
def clean_log(spark, sf):
    return rounded(K.log_transform(table(spark, sf, "events"), "value", zeros=True).select("event_id", "value"), how=C.round_scaled)


@query("clean_drop_column", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def clean_drop_column(spark, sf):
    return K.drop_column(table(spark, sf, "supplier"), "s_nationkey", target="s_acctbal")


PLAN_SQL = (
    REPORT_SQL
    + """, ops AS (
      SELECT CASE finding_type WHEN 'missing_values' THEN 'impute_missing_numeric'
          WHEN 'duplicate_rows' THEN 'remove_exact_duplicate_rows' WHEN 'potential_type_mismatch' THEN 'convert_text_to_numeric'
          WHEN 'potential_outliers' THEN 'review_outliers'
          WHEN 'high_skew' THEN CASE WHEN (SELECT min(value) FROM dirty) > 0 THEN 'transform_distribution_log'
            ELSE 'review_distribution_transform' END END AS operation_type,
        CASE WHEN finding_type = 'duplicate_rows' THEN 'recommended'
          WHEN finding_type = 'missing_values' AND severity = 'low' THEN 'recommended'
          WHEN finding_type = 'potential_type_mismatch' AND (SELECT count(*) FROM dirty WHERE TRY_CAST(amount_text AS DOUBLE)
            IS NULL) = 0 THEN 'recommended' ELSE 'review_required' END AS status, "column" FROM f)"""
)


@query("cleaning_plan", PLAN_SQL + ' SELECT operation_type, status, "column" FROM ops')
def cleaning_plan(spark, sf):
    return K.plan_for(dirty_events(spark, sf)).select("operation_type", "status", "column")


@query(
    "cleaning_plan_summary",
    PLAN_SQL
    + """ SELECT count(*) AS total_operations, count(*) FILTER (status = 'recommended') AS n_recommended,
    count(*) FILTER (status = 'review_required') AS n_review_required,
    count(*) FILTER (status = 'not_safe_to_automate') AS n_not_safe_to_automate,
    count(*) FILTER (operation_type = 'review_outliers') AS n_investigation,
    string_agg(DISTINCT "column", ',' ORDER BY "column") AS columns_affected,
    count(*) FILTER (status = 'recommended') AS auto_applicable_count FROM ops""",
)
def cleaning_plan_summary(spark, sf):
    return K.summarise_plan(K.plan_for(dirty_events(spark, sf))).select(
        "total_operations",
        "n_recommended",
        "n_review_required",
        "n_not_safe_to_automate",
        "n_investigation",
        "columns_affected",
        "auto_applicable_count",
    )


@query(
    "cleaning_spelling_plan",
    """SELECT 'standardize_category_formatting' AS operation_type, 'review_required' AS status, 'p_type' AS "column"
    WHERE (SELECT count(*) FROM part WHERE p_partkey % 3 = 0 AND lower(p_type) <> p_type) > 0""",
)
def cleaning_spelling_plan(spark, sf):
    df = dirty_part(spark, sf)
    operations = K.plan_for(df)
    return operations.where("source_finding_id LIKE 'inconsistent%'").select("operation_type", "status", "column")


@query(
    "clean_sequential",
    f"""WITH {DIRTY_EVENTS}, d AS (SELECT DISTINCT * FROM dirty)
    SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM d)), 6) AS value FROM d""",
)
def clean_sequential(spark, sf):
    """Duplicate removal, then median imputation fitted on what is left."""
    cleaned, _ = _sequential(spark, sf)
    return rounded(cleaned.select("event_id", "value"))


def _sequential(spark, sf):
    df = dirty_events(spark, sf)
    rows = K.operation_rows(K.plan_for(df))
    order = [K.DEDUPLICATE, K.IMPUTE_NUMBER, K.TO_NUMBER]
    rows = sorted((r for r in rows if r["operation_type"] in order), key=lambda r: order.index(r["operation_type"]))
    options = K.RunOptions(approved={r["operation_id"] for r in rows}, allow_full_fit=True)
    return K.run_plan(df, rows, options)


@query(
    "clean_operation_log",
    f"""WITH {DIRTY_EVENTS}, d AS (SELECT DISTINCT * FROM dirty)
    SELECT 1 AS step, 'remove_exact_duplicate_rows' AS operation_type, 'executed' AS status,
      (SELECT count(*) FROM dirty) AS rows_before, (SELECT count(*) FROM d) AS rows_after,
      -1::BIGINT AS missing_before, -1::BIGINT AS missing_after
    UNION ALL SELECT 2, 'impute_missing_numeric', 'executed', count(*), count(*), count(*) - count(value), 0 FROM d
    UNION ALL SELECT 3, 'convert_text_to_numeric', 'failed', -1, -1, -1, -1""",
)
def clean_operation_log(spark, sf):
    counts = ["rows_before", "rows_after", "missing_before", "missing_after"]
    return _sequential(spark, sf)[1].na.fill(-1, counts).select("step", "operation_type", "status", *counts)


ADVISED = ", ".join(f"'{kind}'" for kind in K.ADVICE)


@query(
    "clean_gate_log",
    PLAN_SQL
    + f""" SELECT operation_type, "column", CASE WHEN operation_type NOT IN ({ADVISED}) AND status = 'recommended' THEN 'executed' ELSE 'skipped' END AS status,
    CASE WHEN operation_type IN ({ADVISED}) THEN 'advice only, nothing to transform' WHEN status <> 'recommended' THEN 'not approved' END AS reason FROM ops""",
)
def clean_gate_log(spark, sf):
    """The log of a whole plan of which only recommended operations may run: advice is listed, nothing else is touched."""
    df = dirty_events(spark, sf)
    _, log = K.run_plan(df, K.operation_rows(K.plan_for(df)), K.RunOptions(run_recommended=True, allow_full_fit=True))
    return log.select("operation_type", "column", "status", "reason")


@query("cleaning_plan_fingerprint")
def cleaning_plan_fingerprint(spark, sf):
    return K.fingerprint(K.plan_for(dirty_events(spark, sf)))


@query(
    "quality_before_after_score",
    f"""WITH {DIRTY_EVENTS}, g AS (SELECT count(*) AS c FROM dirty GROUP BY event_id, ts, user_id, event_type, value, amount_text),
    p AS (SELECT (SELECT round(100.0 * (count(*) - count(value)) / count(*)::DOUBLE, 4) FROM dirty) AS m,
      (SELECT round(100.0 * sum(c - 1)::DOUBLE / sum(c)::DOUBLE, 4) FROM g) AS d),
    s AS (SELECT 100.0 - CASE WHEN m = 0 THEN 0 WHEN m <= 5 THEN 2 WHEN m <= 20 THEN 6 WHEN m <= 50 THEN 15 ELSE 35 END
      - CASE WHEN d = 0 THEN 0 WHEN d <= 1 THEN 2 WHEN d <= 10 THEN 6 ELSE 15 END AS score FROM p)
    SELECT 'missing_cells' AS measure, (count(*) - count(value))::DOUBLE AS before, 0.0::DOUBLE AS after, 'improved' AS change FROM dirty
    UNION ALL SELECT 'rows', count(*)::DOUBLE, (SELECT count(*) FROM events)::DOUBLE, 'improved' FROM dirty
    UNION ALL SELECT 'columns', 6.0, 6.0, 'lost'
    UNION ALL SELECT 'score', score::DOUBLE, 100.0, CASE WHEN score = 100 THEN 'unchanged' ELSE 'improved' END FROM s""",
)
def quality_before_after_score(spark, sf):
    before, after = dirty_events(spark, sf), table(spark, sf, "events")
    checks = ["missing_values", "duplicate_rows"]
    return Q.compare_quality(
        before, after, Q.run_checks(before, checks=checks), Q.run_checks(after, checks=checks), target="value"
    )
