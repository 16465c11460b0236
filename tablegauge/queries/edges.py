"""Cases at the edge of the plain queries: microseconds, signed zeros, codes that look like numbers, wide tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablegauge.operators import charts as D, explore as X, profile as P, screens as S, versions as V
from tablegauge.queries.versions import write_lines
from tablegauge.queries.registry import query, rounded, table
from tablegauge.session import scratch_folder
from tablegauge.sources import readers


def _shifted(spark, sf):
    """Events of which every 50th repeats one microsecond later, and every 100th as it is."""
    events = table(spark, sf, "events")
    later = events.where("event_id % 50 = 0").withColumn("ts", F.expr("ts + INTERVAL '0.000001' SECOND"))
    return events.unionByName(later).unionByName(events.where("event_id % 100 = 0"))


@query(
    "duplicates_microseconds",
    """SELECT count(*) + count_if(event_id % 50 = 0) + count_if(event_id % 100 = 0) AS n_rows,
    count_if(event_id % 100 = 0) AS duplicate_rows FROM events""",
)
def duplicates_microseconds(spark, sf):
    return P.duplicate_rows(_shifted(spark, sf)).select("n_rows", "duplicate_rows")


@query("content_diff_microseconds", "SELECT count_if(event_id % 50 = 0) AS only_before, count_if(event_id % 50 = 0) AS only_after FROM events")
def content_diff_microseconds(spark, sf):
    events = table(spark, sf, "events")
    moved = events.withColumn("ts", F.expr("CASE WHEN event_id % 50 = 0 THEN ts + INTERVAL '0.000001' SECOND ELSE ts END"))
    return V.row_diff(events, moved)


@query(
    "signed_zero_duplicates",
    """SELECT count(*) AS n_rows, count(*) - count(DISTINCT CASE WHEN l_linenumber <= 2 THEN 0 ELSE l_linenumber END) AS duplicate_rows
    FROM lineitem""",
)
def signed_zero_duplicates(spark, sf):
    value = F.expr("CASE l_linenumber WHEN 1 THEN CAST('-0.0' AS DOUBLE) WHEN 2 THEN 0.0D ELSE CAST(l_linenumber AS DOUBLE) END")
    return P.duplicate_rows(table(spark, sf, "lineitem").select(value.alias("x"))).select("n_rows", "duplicate_rows")


@query(
    "csv_code_column",
    """SELECT c_custkey, (c_custkey % 9) || CASE WHEN c_custkey % 2 = 0 THEN 'D' ELSE 'f' END AS code,
    CAST(c_custkey AS DOUBLE) / 4 AS share FROM customer""",
)
def csv_code_column(spark, sf):
    path = scratch_folder(spark, "codes") + ".csv"
    table(spark, sf, "customer").selectExpr(
        "c_custkey", "(c_custkey % 9) || CASE WHEN c_custkey % 2 = 0 THEN 'D' ELSE 'f' END AS code", "c_custkey / 4 AS share").write.csv(path, header=True)
    return readers.read_csv(spark, path)


@query(
    "csv_rejects_quoted",
    """SELECT 'too_few_fields' AS reason, count(*) AS rejected FROM customer WHERE c_custkey % 5 = 1 HAVING count(*) > 0
    UNION ALL SELECT 'too_many_fields', count(*) FROM customer WHERE c_custkey % 5 = 2 HAVING count(*) > 0""",
)
def csv_rejects_quoted(spark, sf):
    path = scratch_folder(spark, "quoted") + ".csv"
    write_lines(table(spark, sf, "customer").repartition(4, "c_nationkey").select(F.expr(
        """CASE c_custkey % 5 WHEN 1 THEN '"x,y,""z",' || c_custkey WHEN 2 THEN '"a,b",1,2,' || c_custkey
        ELSE '"p,q",1,' || c_custkey END""").alias("name,one,key")), path)
    return readers.reject_report(spark, path).select("reason", "rejected")


WIDE = [f"CAST((l_orderkey * {7 + 3 * i} + l_linenumber * {i}) % {101 + 2 * i} AS DOUBLE) AS c{i:02d}" for i in range(12)]


@query(
    "strongest_corr_wide",
    """SELECT 'y' AS column_a, 'z' AS column_b, count(*) AS n, CAST(1 AS DOUBLE) AS correlation, 'strong' AS strength FROM lineitem""",
)
def strongest_corr_wide(spark, sf):
    """Fourteen columns; the strongest pair is the last one by name."""
    wide = table(spark, sf, "lineitem").selectExpr(*WIDE, "l_extendedprice AS y", "2 * l_extendedprice AS z")
    return rounded(D.strongest_correlation(wide))


@query(
    "group_summary_many",
    """SELECT CAST(l_partkey AS VARCHAR) AS category, count(*) AS "count", round(avg(l_quantity), 6) AS mean,
    round(median(l_quantity), 6) AS median FROM lineitem GROUP BY 1""",
)
def group_summary_many(spark, sf):
    """More than fifty groups, none left out."""
    return rounded(X.group_summary(table(spark, sf, "lineitem").withColumn("l_partkey", F.col("l_partkey").cast("string")), "l_partkey", "l_quantity"))


@query(
    "target_match_kinds",
    """SELECT h AS hint, c AS "column", m AS "match" FROM (VALUES
      ('say what o_totalprice becomes', 'o_totalprice', 'exact'), ('the OTotalPrice', 'o_totalprice', 'normalized'),
      ('totalprice', 'o_totalprice', 'normalized'), ('prices of orderdates', 'o_orderdate', 'token'), ('status', 'o_orderstatus', 'none'),
      ('orderkey of o', 'o_orderkey', 'normalized'), ('predict the future value', 'o_custkey', 'none')) AS t(h, c, m)
    WHERE (SELECT count(*) FROM orders) > 0""",
)
def target_match_kinds(spark, sf):
    facts = P.column_table(table(spark, sf, "orders"))
    asked = [("say what o_totalprice becomes", "o_totalprice"), ("the OTotalPrice", "o_totalprice"), ("totalprice", "o_totalprice"),
             ("prices of orderdates", "o_orderdate"), ("status", "o_orderstatus"), ("orderkey of o", "o_orderkey"),
             ("predict the future value", "o_custkey")]
    parts = [S.name_matches(facts, h).where(F.col("column") == c).select(F.lit(h).alias("hint"), "column", "match") for h, c in asked]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
