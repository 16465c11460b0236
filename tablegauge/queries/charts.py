"""Chart data and dashboard queries."""

from pyspark.sql import functions as F

from tablegauge.operators import charts as D, filters
from tablegauge.queries.registry import query, rounded, table
from tablegauge.queries.statistics import ANOVA_SQL, PRICE_PAIRS, histogram_sql


@query("chart_histogram", histogram_sql("l_quantity", "lineitem"))
def chart_histogram(spark, sf):
    return rounded(D.histogram_data(table(spark, sf, "lineitem"), "l_quantity"))


@query(
    "chart_bar",
    """SELECT CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS position, value, n
    FROM (SELECT source AS value, count(*) AS n FROM documents GROUP BY 1)""",
)
def chart_bar(spark, sf):
    return D.bar_data(table(spark, sf, "documents"), "source")


@query("chart_scatter", "SELECT o_totalprice AS x, o_custkey::DOUBLE AS y FROM orders")
def chart_scatter(spark, sf):
    return D.scatter_data(table(spark, sf, "orders"), "o_totalprice", "o_custkey")


@query(
    "chart_box",
    """SELECT event_type AS category, count(*) AS n, min(value) AS minimum, round(quantile_cont(value, 0.25), 6) AS q25,
    round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS maximum
    FROM events GROUP BY 1""",
)
def chart_box(spark, sf):
    return rounded(D.box_data(table(spark, sf, "events"), "event_type", "value"))


@query(
    "chart_recommendations",
    """SELECT * FROM (VALUES (1, 'scatter_plot', 'o_custkey,o_totalprice', 90.0::DOUBLE),
      (2, 'scatter_plot', 'o_orderkey,o_totalprice', 90.0), (3, 'box_plot', 'o_orderpriority,o_totalprice', 80.0),
      (4, 'box_plot', 'o_orderstatus,o_totalprice', 80.0), (5, 'histogram', 'o_totalprice', 70.0))
      t("rank", kind, "columns", score)
    WHERE (SELECT count(DISTINCT o_orderpriority) + count(DISTINCT o_orderstatus) FROM orders) BETWEEN 2 AND 100""",
)
def chart_recommendations(spark, sf):
    return D.recommend_charts(table(spark, sf, "orders").drop("o_orderdate"), "o_totalprice")


@query(
    "chart_strength",
    ANOVA_SQL
    + """, c AS (SELECT abs(corr(o_custkey, o_totalprice)) AS r FROM orders)
    SELECT predictor, round(strength, 6) AS strength, CAST(row_number() OVER (ORDER BY strength DESC) AS INTEGER) AS "rank"
    FROM (SELECT 'o_orderpriority' AS predictor, sqrt(ssb / (ssb + ssw)) AS strength FROM p
      UNION ALL SELECT 'o_custkey', r FROM c)""",
)
def chart_strength(spark, sf):
    df = table(spark, sf, "orders").select("o_totalprice", "o_custkey", "o_orderpriority")
    return rounded(D.rank_by_strength(df, "o_totalprice").select("predictor", "strength", "rank"))


@query(
    "kpi_cards",
    """SELECT 'row_count' AS card, count(*)::DOUBLE AS value, '-' AS label FROM orders
    UNION ALL SELECT 'average', round(avg(o_orderkey), 6), 'o_orderkey' FROM orders
    UNION ALL SELECT 'average', round(avg(o_custkey), 6), 'o_custkey' FROM orders
    UNION ALL SELECT 'top_category', n::DOUBLE, v FROM (SELECT o_orderstatus AS v, count(*) AS n FROM orders
      GROUP BY 1 ORDER BY n DESC, v LIMIT 1)""",
)
def kpi_cards(spark, sf):
    return rounded(D.kpi_cards(table(spark, sf, "orders"))).na.fill("-", ["label"])


@query(
    "monthly_trend",
    """SELECT strftime(o_orderdate, '%Y-%m') AS month, round(avg(o_totalprice), 6) AS value, count(*) AS n
    FROM orders GROUP BY 1""",
)
def monthly_trend(spark, sf):
    return rounded(D.monthly_trend(table(spark, sf, "orders"), "o_orderdate", "o_totalprice"))


@query(
    "monthly_row_counts",
    "SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*)::DOUBLE AS value, count(*) AS n FROM lineitem GROUP BY 1",
)
def monthly_row_counts(spark, sf):
    return D.monthly_trend(table(spark, sf, "lineitem"), "l_shipdate")


FILTERED = "(SELECT * FROM orders WHERE o_orderstatus IN ('F') AND o_totalprice BETWEEN 1000 AND 300000)"


def _filtered(spark, sf):
    return filters.slice_rows(
        table(spark, sf, "orders"), {"o_orderstatus": ["F"]}, {"o_totalprice": (1000, 300000)}
    )


@query("dashboard_histogram", histogram_sql("o_totalprice", FILTERED, 12))
def dashboard_histogram(spark, sf):
    return rounded(D.filtered_histogram(_filtered(spark, sf), "o_totalprice"))


@query(
    "dashboard_upper_median",
    f"""SELECT 'o_totalprice' AS "column", o_totalprice AS median FROM (
      SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM {FILTERED})
    WHERE i = n // 2""",
)
def dashboard_upper_median(spark, sf):
    return D.upper_median(_filtered(spark, sf), "o_totalprice")


@query(
    "dashboard_top_categories",
    f"""SELECT CAST(position AS INTEGER) AS position, value, n, round(n / total::DOUBLE, 6) AS frequency, k AS unique_count,
      0::BIGINT AS missing_count
    FROM (SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS position, sum(n) OVER () AS total,
      count(*) OVER () AS k FROM (SELECT o_orderpriority AS value, count(*) AS n FROM {FILTERED} GROUP BY 1))
    WHERE position <= 8""",
)
def dashboard_top_categories(spark, sf):
    return D.top_categories(_filtered(spark, sf), "o_orderpriority")


CORR_SQL = " UNION ALL ".join(
    f"""SELECT '{a}' AS column_a, '{b}' AS column_b, count(*) AS n, round(corr({a}, {b}), 6) AS correlation FROM lineitem"""
    for a, b in PRICE_PAIRS
)


@query(
    "strongest_corr",
    f"""SELECT *, CASE WHEN abs(correlation) > 0.7 THEN 'strong' WHEN abs(correlation) > 0.4 THEN 'moderate' ELSE 'weak' END
      AS strength FROM ({CORR_SQL}) ORDER BY abs(correlation) DESC LIMIT 1""",
)
def strongest_corr(spark, sf):
    return rounded(
        D.strongest_correlation(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    )


@query("correlation_ranking", f"SELECT * FROM ({CORR_SQL}) ORDER BY abs(correlation) DESC LIMIT 2")
def correlation_ranking(spark, sf):
    return rounded(
        D.correlation_ranking(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], limit=2)
    )


@query(
    "grouped_means",
    """SELECT c_mktsegment AS category, round(avg(c_acctbal), 6) AS mean, count(c_acctbal) AS n FROM customer GROUP BY 1""",
)
def grouped_means(spark, sf):
    return rounded(D.grouped_means(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal"))


@query(
    "stacked_counts",
    """SELECT o_orderpriority AS a, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
    count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1 ORDER BY 1 LIMIT 10""",
)
def stacked_counts(spark, sf):
    return D.stacked_counts(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


@query(
    "treemap",
    """SELECT CAST(position AS INTEGER) AS position, value, n, round(n / total::DOUBLE, 6) AS share FROM (
      SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS position, sum(n) OVER () AS total
      FROM (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1)) WHERE position <= 12""",
)
def treemap(spark, sf):
    return D.treemap(table(spark, sf, "part"), "p_brand")
