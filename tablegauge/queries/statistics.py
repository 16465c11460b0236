"""Exploratory, hypothesis-test and rank-test queries."""

from pyspark.sql import functions as F

from tablegauge.operators import explore as X, hypothesis as H, kendall as K, pvalues, quality as Q, ranktests as R
from tablegauge.queries.registry import DIRTY_EVENTS, dirty_events, query, rounded, table

PRICE_PAIRS = [("l_discount", "l_extendedprice"), ("l_discount", "l_quantity"), ("l_extendedprice", "l_quantity")]


def _union(parts):
    return " UNION ALL ".join(parts)


def normal_tail_sql(z: str) -> str:
    """P(Z > z) for z >= 0 by Simpson's rule over a fine grid (the reference value of a normal p-value)."""
    return f"""(SELECT 0.5 - CASE WHEN least({z}, 12.0) = 0 THEN 0 ELSE least({z}, 12.0) / 3000.0 / sqrt(2 * pi()) *
      sum((CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
        * exp(-0.5 * pow(least({z}, 12.0) * i / 1000.0, 2))) END FROM range(0, 1001) t(i))"""


@query(
    "eda_column_kinds",
    """SELECT * FROM (VALUES ('s_suppkey', 'numeric'), ('s_name', 'categorical'), ('s_nationkey', 'numeric'),
    ('s_acctbal', 'numeric')) t("column", kind) WHERE (SELECT count(*) FROM supplier) > 0""",
)
def eda_column_kinds(spark, sf):
    return X.classify(table(spark, sf, "supplier"))


@query(
    "eda_numeric_summary",
    _union(
        f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
        round(min({c}), 6) AS minimum, round(quantile_cont({c}, 0.05), 6) AS q05, round(quantile_cont({c}, 0.25), 6) AS q25,
        round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q75,
        round(quantile_cont({c}, 0.95), 6) AS q95, round(max({c}), 6) AS maximum FROM supplier"""
        for c in ("s_acctbal", "s_nationkey")
    ),
)
def eda_numeric_summary(spark, sf):
    return rounded(X.numeric_summary(table(spark, sf, "supplier"), ["s_acctbal", "s_nationkey"]))


@query(
    "eda_categorical_summary",
    _union(
        f"""SELECT '{c}' AS "column", CAST(position AS INTEGER) AS position, value, n,
        round(n / present::DOUBLE, 6) AS frequency, unique_count, round(unique_count / present::DOUBLE, 6) AS cardinality_ratio
        FROM (SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS position, sum(n) OVER () AS present,
          count(*) OVER () AS unique_count FROM (SELECT {c} AS value, count(*) AS n FROM documents GROUP BY 1))
        WHERE position <= 10"""
        for c in ("source", "lang")
    ),
)
def eda_categorical_summary(spark, sf):
    return X.categorical_summary(table(spark, sf, "documents"), ["source", "lang"])


@query(
    "eda_datetime_summary",
    """SELECT 'o_orderdate' AS "column", strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS minimum,
    strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS maximum, count(o_orderdate) AS "count",
    count(DISTINCT o_orderdate) AS unique_count FROM orders""",
)
def eda_datetime_summary(spark, sf):
    return X.datetime_summary(table(spark, sf, "orders"), ["o_orderdate"])


@query(
    "eda_missingness",
    f"WITH {DIRTY_EVENTS}, m AS ("
    + _union(
        f"""SELECT '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS missing_count FROM dirty"""
        for c in ("event_id", "ts", "user_id", "event_type", "value", "amount_text")
    )
    + """), a AS (SELECT * FROM m UNION ALL SELECT '*', sum(n_rows)::BIGINT, sum(missing_count)::BIGINT FROM m)
    SELECT "column", n_rows, missing_count, round(100.0 * missing_count / n_rows::DOUBLE, 6) AS missing_percentage FROM a""",
)
def eda_missingness(spark, sf):
    return X.missingness(dirty_events(spark, sf))


@query(
    "corr_pairs",
    _union(
        f"""SELECT '{a}' AS column_a, '{b}' AS column_b, count(*) AS n, round(corr({a}, {b}), 6) AS correlation
        FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL"""
        for a, b in PRICE_PAIRS
    ),
)
def corr_pairs(spark, sf):
    return rounded(X.correlations(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query(
    "group_summary",
    """SELECT o_orderpriority AS category, count(*) AS "count", round(avg(o_totalprice), 6) AS mean,
    round(median(o_totalprice), 6) AS median FROM orders GROUP BY 1 ORDER BY 1 LIMIT 50""",
)
def group_summary(spark, sf):
    return rounded(X.group_summary(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"))


@query(
    "contingency",
    "SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 200",
)
def contingency(spark, sf):
    return X.contingency(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query(
    "distribution_shape",
    _union(
        f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 4) AS mean, round(var_samp({c}), 4) AS variance,
        round(stddev_samp({c}), 4) AS std, round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis
        FROM {t}"""
        for c, t in (("value", "events"),)
    ),
)
def distribution_shape(spark, sf):
    return rounded(X.shape(table(spark, sf, "events"), ["value"]), 4)


def histogram_sql(column: str, source: str, limit: int = 50) -> str:
    return f"""WITH b AS (SELECT count({column}) AS n, min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi,
        least(ceil(log2(count({column})))::INTEGER + 1, {limit}) AS k FROM {source}),
      c AS (SELECT least(floor(({column} - lo) / (hi - lo) * k)::INTEGER, k - 1) AS r, {column} AS x, lo, hi, k
        FROM {source}, b WHERE {column} IS NOT NULL),
      d AS (SELECT CASE WHEN x < lo + r * ((hi - lo) / k) THEN r - 1 ELSE r END AS r, x, lo, hi, k FROM c),
      e AS (SELECT CASE WHEN x >= lo + (r + 1) * ((hi - lo) / k) AND r < k - 1 THEN r + 1 ELSE r END AS bin FROM d),
      f AS (SELECT bin, count(*) AS n FROM e GROUP BY 1)
      SELECT '{column}' AS "column", CAST(i AS INTEGER) AS bin, round(lo + i * (hi - lo) / k, 6) AS left_edge,
        round(lo + (i + 1) * (hi - lo) / k, 6) AS right_edge, coalesce(f.n, 0) AS "count"
      FROM b, range(0, 51) t(i) LEFT JOIN f ON f.bin = i WHERE i < k"""


@query("histogram", histogram_sql("o_totalprice", "orders"))
def histogram(spark, sf):
    return rounded(X.histograms(table(spark, sf, "orders"), ["o_totalprice"]))


@query("histogram_heavy_tail", histogram_sql("value", "events"))
def histogram_heavy_tail(spark, sf):
    return rounded(X.histograms(table(spark, sf, "events"), ["value"]))


@query(
    "truncation_notes",
    """SELECT 'numeric_pairs' AS battery, 28 AS candidates, 5 AS kept WHERE (SELECT count(*) FROM lineitem) > 0
    UNION ALL SELECT 'categorical_numeric', 16, 5""",
)
def truncation_notes(spark, sf):
    li = table(spark, sf, "lineitem")
    from tablegauge.functions import columns as C

    return X.truncation_notes(li, C.numeric_columns(li), C.columns_of_kind(li, C.CATEGORICAL), cap=5)


@query(
    "eda_cross_reference",
    f"""WITH {DIRTY_EVENTS} SELECT finding_id, signal FROM (
      SELECT 'missing_values:value' AS finding_id, 'missingness' AS signal FROM dirty HAVING count(*) > count(value)
      UNION ALL SELECT 'high_skew:value', 'skewness' FROM dirty HAVING abs(skewness(value)) >= 1)""",
)
def eda_cross_reference(spark, sf):
    df = dirty_events(spark, sf)
    findings = Q.run_checks(df, checks=["missing_values", "duplicate_rows", "skewness"])
    return X.cross_reference(df, findings).where(F.col("evidence").isNotNull()).select("finding_id", "signal")


WELCH_COLUMNS = [("l_discount", "l_tax"), ("l_extendedprice", "l_quantity")]


@query(
    "welch",
    _union(
        f"""SELECT '{a}' AS column_a, '{b}' AS column_b, n, 'completed' AS status, round((ma - mb) / sqrt(va / n + vb / n), 5) AS statistic,
        round(pow(va / n + vb / n, 2) / ((pow(va / n, 2) + pow(vb / n, 2)) / (n - 1)), 4) AS degrees_of_freedom
        FROM (SELECT count(*) AS n, avg({a}) AS ma, avg({b}) AS mb, var_samp({a}) AS va, var_samp({b}) AS vb FROM lineitem)"""
        for a, b in WELCH_COLUMNS
    ),
)
def welch(spark, sf):
    return H.welch(table(spark, sf, "lineitem"), WELCH_COLUMNS).select(
        "column_a",
        "column_b",
        "n",
        "status",
        F.round("statistic", 5).alias("statistic"),
        F.round("degrees_of_freedom", 4).alias("degrees_of_freedom"),
    )


ANOVA_SQL = """WITH g AS (SELECT o_orderpriority AS label, count(*) AS n, avg(o_totalprice) AS m,
      var_samp(o_totalprice) * (count(*) - 1) AS ss FROM orders GROUP BY 1 HAVING count(*) >= 2),
    t AS (SELECT sum(n * m) / sum(n) AS grand FROM g),
    p AS (SELECT sum(n)::BIGINT AS n, count(*) AS k, sum(n * pow(m - grand, 2)) AS ssb, sum(ss) AS ssw FROM g, t)"""


@query(
    "anova",
    ANOVA_SQL
    + """ SELECT 'o_orderpriority' AS category_column, 'o_totalprice' AS numeric_column, n, k AS n_groups,
    round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS statistic, k - 1 AS df_between, n - k AS df_within FROM p""",
)
def anova(spark, sf):
    result = H.anova(table(spark, sf, "orders"), ["o_orderpriority"], ["o_totalprice"])
    return rounded(result.drop("status"))


@query(
    "correlation_ratio",
    ANOVA_SQL
    + """ SELECT 'o_orderpriority' AS category_column, 'o_totalprice' AS numeric_column, n, k AS n_groups,
    round(sqrt(ssb / (ssb + ssw)), 6) AS effect_size FROM p""",
)
def correlation_ratio(spark, sf):
    return rounded(H.correlation_ratio(table(spark, sf, "orders"), ["o_orderpriority"], ["o_totalprice"]).drop("status"))


CHI_SQL = """WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2),
    r AS (SELECT a, sum(n) AS n FROM c GROUP BY 1), s AS (SELECT b, sum(n) AS n FROM c GROUP BY 1),
    t AS (SELECT sum(n) AS n FROM c),
    x AS (SELECT sum(pow(coalesce(c.n, 0) - r.n * s.n / t.n::DOUBLE, 2) / (r.n * s.n / t.n::DOUBLE)) AS chi2
      FROM r CROSS JOIN s CROSS JOIN t LEFT JOIN c ON c.a = r.a AND c.b = s.b)"""


@query(
    "chi_square",
    CHI_SQL
    + """ SELECT 'l_returnflag' AS column_a, 'l_linestatus' AS column_b, t.n::BIGINT AS n, round(chi2, 6) AS statistic,
    ((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM s) - 1) AS degrees_of_freedom,
    round((SELECT min(n) FROM r) * (SELECT min(n) FROM s) / t.n::DOUBLE, 6) AS min_expected FROM x, t""",
)
def chi_square(spark, sf):
    result = H.chi_square(table(spark, sf, "lineitem"), [("l_returnflag", "l_linestatus")])
    return rounded(result.drop("status", "low_expected"))


@query(
    "cramers_v",
    CHI_SQL
    + """ SELECT 'l_returnflag' AS column_a, 'l_linestatus' AS column_b, t.n::BIGINT AS n,
    round(sqrt(chi2 / (t.n * least((SELECT count(*) FROM r) - 1, (SELECT count(*) FROM s) - 1))), 6) AS effect_size
    FROM x, t""",
)
def cramers_v(spark, sf):
    return rounded(H.cramers_v(table(spark, sf, "lineitem"), [("l_returnflag", "l_linestatus")]).drop("status"))


@query(
    "binned_mutual_information",
    """WITH qx AS (SELECT DISTINCT unnest(quantile_cont(l_quantity, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e
      FROM lineitem),
    qy AS (SELECT DISTINCT unnest(quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e
      FROM lineitem),
    ex AS (SELECT e FROM qx WHERE e > (SELECT min(l_quantity) FROM lineitem)),
    ey AS (SELECT e FROM qy WHERE e > (SELECT min(l_extendedprice) FROM lineitem)),
    z AS (SELECT (SELECT count(*) FROM ex WHERE e < l_quantity) AS a,
      (SELECT count(*) FROM ey WHERE e < l_extendedprice) AS b FROM lineitem),
    c AS (SELECT a, b, count(*) AS n FROM z GROUP BY 1, 2),
    m AS (SELECT n, sum(n) OVER (PARTITION BY a) AS r, sum(n) OVER (PARTITION BY b) AS s, sum(n) OVER () AS t FROM c)
    SELECT 'l_quantity' AS column_a, 'l_extendedprice' AS column_b, any_value(t)::BIGINT AS n,
      round(sum(n / t::DOUBLE * ln(n::DOUBLE * t / (r * s))), 6) AS effect_size FROM m""",
)
def binned_mutual_information(spark, sf):
    return rounded(H.mutual_information(table(spark, sf, "lineitem"), [("l_quantity", "l_extendedprice")]))


RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query(
    "spearman",
    _union(
        f"""SELECT '{a}' AS column_a, '{b}' AS column_b, count(*) AS n, round(corr(ra, rb), 6) AS statistic FROM (
        SELECT {RANK.format(a)} AS ra, {RANK.format(b)} AS rb FROM lineitem)"""
        for a, b in PRICE_PAIRS
    ),
)
def spearman(spark, sf):
    return rounded(R.spearman(table(spark, sf, "lineitem"), PRICE_PAIRS).drop("status"))


@query(
    "kendall_tau",
    """WITH p AS (SELECT s_nationkey AS x, s_acctbal AS y, row_number() OVER () AS i FROM supplier),
    s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s FROM p a JOIN p b ON a.i < b.i),
    tx AS (SELECT sum(n * (n - 1) / 2.0) AS t FROM (SELECT count(*) AS n FROM p GROUP BY x)),
    ty AS (SELECT sum(n * (n - 1) / 2.0) AS t FROM (SELECT count(*) AS n FROM p GROUP BY y)),
    c AS (SELECT count(*) AS n FROM p)
    SELECT c.n AS n, s.s::DOUBLE AS s,
      round(s.s / sqrt((c.n * (c.n - 1) / 2.0 - tx.t) * (c.n * (c.n - 1) / 2.0 - ty.t)), 6) AS statistic
    FROM s, tx, ty, c""",
)
def kendall_tau(spark, sf):
    return rounded(K.kendall(table(spark, sf, "supplier"), "s_nationkey", "s_acctbal").select("n", "s", "statistic"))


@query("kendall_tau_lineitem")
def kendall_tau_lineitem(spark, sf):
    """Too many row pairs for a pairwise SQL check at this size; the method is tested against brute force."""
    return rounded(K.kendall(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select("n", "s", "statistic"))


@query(
    "kendall_tau_customer",
    """WITH p AS (SELECT c_nationkey AS x, c_acctbal AS y, c_custkey AS i FROM customer),
    s AS (SELECT sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s FROM p a JOIN p b ON a.i < b.i)
    SELECT (SELECT count(*) FROM p) AS n, s::DOUBLE AS s FROM s""",
)
def kendall_tau_customer(spark, sf):
    return K.kendall(table(spark, sf, "customer"), "c_nationkey", "c_acctbal").select("n", "s")


MW_SQL = f"""WITH r AS (SELECT l_linestatus AS g, {RANK.format('l_extendedprice')} AS r, l_extendedprice AS x FROM lineitem),
    t AS (SELECT sum(n * n * n - n)::DOUBLE AS ties FROM (SELECT count(*)::DOUBLE AS n FROM r GROUP BY x)),
    f AS (SELECT count(*) FILTER (g = 'F') AS a, count(*) FILTER (g = 'O') AS b, sum(r) FILTER (g = 'F') AS ra FROM r),
    u AS (SELECT a, b, a + b AS n, ra - a * (a + 1) / 2.0 AS u, ties FROM f, t),
    z AS (SELECT *, (greatest(u, a::DOUBLE * b - u) - a::DOUBLE * b / 2 - 0.5)
      / sqrt(a::DOUBLE * b / 12 * (n + 1 - ties / (n * (n - 1.0)))) AS z FROM u)"""


@query(
    "mann_whitney",
    MW_SQL
    + f""" SELECT 'l_linestatus' AS category_column, 'l_extendedprice' AS numeric_column, a AS n_a, b AS n_b, n,
    u::DOUBLE AS statistic, round(z, 6) AS z, round(least(1.0, 2 * {normal_tail_sql('z')}), 6) AS p_value FROM z""",
)
def mann_whitney(spark, sf):
    result = R.mann_whitney_test(table(spark, sf, "lineitem"), "l_linestatus", "l_extendedprice")
    return rounded(result.select("category_column", "numeric_column", "n_a", "n_b", "n", "statistic", "z", "p_value"))


@query(
    "kruskal_wallis",
    f"""WITH r AS (SELECT o_orderpriority AS g, {RANK.format('o_totalprice')} AS r, o_totalprice AS x FROM orders),
    t AS (SELECT sum(n * n * n - n) AS ties FROM (SELECT count(*)::DOUBLE AS n FROM r GROUP BY x)),
    s AS (SELECT sum(rs * rs / n) AS spread, sum(n)::DOUBLE AS n, count(*) AS k FROM (SELECT sum(r) AS rs, count(*) AS n FROM r GROUP BY g))
    SELECT n::BIGINT AS n, k AS n_groups, k - 1 AS degrees_of_freedom,
      round((12 / (n * (n + 1)) * spread - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 5) AS statistic FROM s, t""",
)
def kruskal_wallis(spark, sf):
    result = R.kruskal(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice")
    return rounded(result.select("n", "n_groups", "degrees_of_freedom", "statistic"), 5)


@query(
    "wilcoxon_signed_rank",
    f"""WITH d AS (SELECT l_discount - l_tax AS d FROM lineitem), z AS (SELECT abs(d) AS x, d FROM d WHERE d <> 0),
    r AS (SELECT d, {RANK.format('x')} AS r FROM z)
    SELECT (SELECT count(*) FROM z) AS n, (SELECT count(*) FROM d WHERE d = 0) AS n_zero,
      sum(r) FILTER (d > 0)::DOUBLE AS w_plus, sum(r) FILTER (d < 0)::DOUBLE AS w_minus,
      least(sum(r) FILTER (d > 0), sum(r) FILTER (d < 0))::DOUBLE AS statistic FROM r""",
)
def wilcoxon_signed_rank(spark, sf):
    result = R.wilcoxon(table(spark, sf, "lineitem"), "l_discount", "l_tax")
    return result.select("n", "n_zero", "w_plus", "w_minus", "statistic")


@query(
    "sign_test",
    """SELECT count(*) FILTER (l_discount > l_tax) AS n_positive, count(*) FILTER (l_discount < l_tax) AS n_negative,
    count(*) FILTER (l_discount = l_tax) AS n_zero FROM lineitem""",
)
def sign_test(spark, sf):
    result = R.sign_test(table(spark, sf, "lineitem"), "l_discount", "l_tax")
    return result.select("n_positive", "n_negative", "n_zero")


FRIEDMAN = ["l_quantity", "l_discount", "l_tax"]


def _row_rank(i: int) -> str:
    others = [c for j, c in enumerate(FRIEDMAN) if j != i]
    less = " + ".join(f"({c} < {FRIEDMAN[i]})::INT" for c in others)
    same = " + ".join(f"({c} = {FRIEDMAN[i]})::INT" for c in others)
    return f"1 + ({less}) + ({same}) / 2.0"


@query(
    "friedman",
    f"""WITH r AS (SELECT {', '.join(f'{_row_rank(i)} AS r{i}' for i in range(3))} FROM lineitem),
    s AS (SELECT count(*)::DOUBLE AS n, pow(sum(r0), 2) + pow(sum(r1), 2) + pow(sum(r2), 2) AS q,
      sum(CASE WHEN r0 = r1 AND r1 = r2 THEN 24 WHEN r0 = r1 OR r1 = r2 OR r0 = r2 THEN 6 ELSE 0 END) AS ties FROM r)
    SELECT n::BIGINT AS n, round((12 / (n * 12) * q - 12 * n) / (1 - ties / (n * 24)), 4) AS statistic FROM s""",
)
def friedman(spark, sf):
    return rounded(R.friedman(table(spark, sf, "lineitem"), FRIEDMAN).select("n", "statistic"), 4)


PVALUES = """p AS (SELECT event_type AS test, (count(*) % 97) / 1000.0::DOUBLE AS p_value FROM events GROUP BY 1)"""


def _pvalues(spark, sf):
    """A family of small p-values derived from the events, one per event type."""
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("test")).agg(F.count("*").alias("n"))
    return e.select("test", ((F.col("n") % 97) / F.lit(1000.0)).alias("p_value"))


@query(
    "bonferroni",
    f"WITH {PVALUES} SELECT test, round(p_value, 6) AS p_value, round(least(1.0, p_value * count(*) OVER ()), 6) AS adjusted_p FROM p",
)
def bonferroni(spark, sf):
    return rounded(pvalues.adjust(_pvalues(spark, sf), method="bonferroni", order="test").drop("significant"))


@query(
    "holm",
    f"""WITH {PVALUES}, r AS (SELECT *, row_number() OVER (ORDER BY p_value, test) AS k, count(*) OVER () AS m FROM p)
    SELECT test, round(p_value, 6) AS p_value, round(least(1.0, max(p_value * (m - k + 1)) OVER (ORDER BY k)), 6) AS adjusted_p FROM r""",
)
def holm(spark, sf):
    return rounded(pvalues.adjust(_pvalues(spark, sf), method="holm", order="test").drop("significant"))


@query(
    "benjamini_hochberg",
    f"""WITH {PVALUES}, r AS (SELECT *, row_number() OVER (ORDER BY p_value, test) AS k, count(*) OVER () AS m FROM p)
    SELECT test, round(p_value, 6) AS p_value, round(least(1.0, min(p_value * m / k) OVER (ORDER BY k DESC)), 6) AS adjusted_p FROM r""",
)
def benjamini_hochberg(spark, sf):
    return rounded(pvalues.adjust(_pvalues(spark, sf), method="benjamini_hochberg", order="test").drop("significant"))


def integral_sql(density: str, upper: str, steps: int = 2000) -> str:
    """Simpson's rule of a density in x from 0 to an upper limit, the reference value of a tail probability."""
    return f"""(SELECT u / {steps} / 3 * sum((CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({density}))
      FROM (SELECT i, {upper} AS u, {upper} * i / {steps}.0::DOUBLE AS x FROM range(0, {steps + 1}) t(i)) GROUP BY u)"""


@query(
    "anova_p_value",
    """WITH g AS (SELECT c_mktsegment AS label, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) * (count(*) - 1) AS ss
      FROM customer GROUP BY 1 HAVING count(*) >= 2),
    t AS (SELECT sum(n * m) / sum(n) AS grand FROM g),
    f AS (SELECT (count(*) - 1)::DOUBLE AS a, (sum(n) - count(*))::DOUBLE AS b,
      (sum(n * pow(m - grand, 2)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))) AS f FROM g, t)
    SELECT round(f, 6) AS statistic, round(1 - """
    + integral_sql(
        "exp(lgamma((a + b) / 2) - lgamma(a / 2) - lgamma(b / 2) + a / 2 * ln(a / b) - (a + b) / 2 * ln(1 + a * x / b)) * pow(x, a / 2 - 1)",
        "f",
    ).replace("AS u,", "AS u, a, b,").replace("GROUP BY u", "GROUP BY u")
    + """, 5) AS p_value FROM f""",
)
def anova_p_value(spark, sf):
    result = H.anova_test(table(spark, sf, "customer"), ["c_mktsegment"], ["c_acctbal"])
    return result.select(F.round("statistic", 6).alias("statistic"), F.round("p_value", 5).alias("p_value"))


@query(
    "chi_square_p_value",
    """WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2),
    r AS (SELECT a, sum(n) AS n FROM c GROUP BY 1), s AS (SELECT b, sum(n) AS n FROM c GROUP BY 1),
    q AS (SELECT (SELECT sum(n) FROM c) * (sum(c.n * c.n / (r.n * s.n)) - 1) AS q FROM c JOIN r ON r.a = c.a JOIN s ON s.b = c.b),
    k AS (SELECT q, (((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM s) - 1))::DOUBLE AS k FROM q)
    SELECT round(q, 6) AS statistic, round(1 - """
    + integral_sql("exp(-x / 2 - k / 2 * ln(2) - lgamma(k / 2)) * pow(x, k / 2 - 1)", "q").replace("AS u,", "AS u, k,")
    + """, 5) AS p_value FROM k""",
)
def chi_square_p_value(spark, sf):
    result = H.chi_square_test(table(spark, sf, "orders"), [("o_orderpriority", "o_orderstatus")])
    return result.select(F.round("statistic", 6).alias("statistic"), F.round("p_value", 5).alias("p_value"))


RANKED = ["c_acctbal", "c_custkey", "c_nationkey"]
RANK_PAIRS = [(a, b) for i, a in enumerate(RANKED) for b in RANKED[i + 1 :]]


def _spearman_sql(a: str, b: str) -> str:
    density = "exp(lgamma((k + 1) / 2) - lgamma(k / 2) - (k + 1) / 2 * ln(1 + x * x / k)) / sqrt(k * pi())"
    return f"""SELECT 'spearman' AS test, '{a}' AS column_a, '{b}' AS column_b, n, 'completed' AS status, round(r, 6) AS statistic,
      round(1 - 2 * {integral_sql(density, 'score').replace('AS u,', 'AS u, k,')}, 5) AS p_value FROM (
      SELECT n, r, (n - 2)::DOUBLE AS k, abs(r) * sqrt((n - 2) / (1 - r * r)) AS score FROM (
        SELECT count(*) AS n, corr(ra, rb) AS r FROM (SELECT {RANK.format(a)} AS ra, {RANK.format(b)} AS rb FROM c)))"""


def _kendall_sql(a: str, b: str) -> str:
    ties = lambda c: f"""(SELECT sum(n * (n - 1) / 2) AS t, sum(n * (n - 1) * (n - 2)) AS t3, sum(n * (n - 1) * (2 * n + 5)) AS v
        FROM (SELECT count(*)::DOUBLE AS n FROM c GROUP BY {c}))"""  # noqa: E731
    return f"""SELECT 'kendall', '{a}', '{b}', n::BIGINT, 'completed', round(s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)), 6),
      round(2 * {normal_tail_sql('z')}, 5) FROM (
      SELECT *, abs(s) / sqrt((n * (n - 1) * (2 * n + 5) - vx - vy) / 18 + 2 * tx * ty / (n * (n - 1)) + t3x * t3y / (9 * n * (n - 1) * (n - 2))) AS z FROM (
        SELECT (SELECT count(*)::DOUBLE FROM c) AS n, (SELECT sum(sign(p.{a} - q.{a}) * sign(p.{b} - q.{b}))::DOUBLE FROM c p JOIN c q ON p.c_custkey < q.c_custkey) AS s,
          x.t AS tx, x.t3 AS t3x, x.v AS vx, y.t AS ty, y.t3 AS t3y, y.v AS vy FROM {ties(a)} x, {ties(b)} y))"""


def _labels_sql(c: str, x: str) -> str:
    ranked = f"""(SELECT any_value(n)::DOUBLE AS n, sum(r) AS rs, count(*)::DOUBLE AS size, g, any_value(ties) AS ties FROM (
        SELECT {c} AS g, {RANK.format(x)} AS r, count(*) OVER () AS n,
          (SELECT sum(m * m * m - m) FROM (SELECT count(*)::DOUBLE AS m FROM c GROUP BY {x})) AS ties FROM c) GROUP BY g)"""
    chi = integral_sql("exp(-x / 2 - k / 2 * ln(2) - lgamma(k / 2)) * pow(x, k / 2 - 1)", "h").replace("AS u,", "AS u, k,")
    whitney = f"""SELECT 'mann_whitney_u', '{c}', '{x}', n::BIGINT, CASE WHEN k = 2 THEN 'completed' ELSE 'unavailable' END,
      CASE WHEN k = 2 THEN u END, CASE WHEN k = 2 THEN round(least(1.0, 2 * {normal_tail_sql('z')}), 5) + 0.0 END FROM (
      SELECT *, (greatest(u, a * b - u) - a * b / 2 - 0.5) / sqrt(a * b / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM (
        SELECT *, ra - a * (a + 1) / 2 AS u FROM (SELECT count(*) AS k, any_value(n) AS n, any_value(ties) AS ties, arg_min(rs, g) AS ra, arg_min(size, g) AS a,
          arg_max(size, g) AS b FROM {ranked})))"""
    return whitney + f""" UNION ALL SELECT 'kruskal_wallis', '{c}', '{x}', n::BIGINT, 'completed', round(h, 6),
      round(CASE WHEN k = 1 THEN 2 * {normal_tail_sql('sqrt(h)')} ELSE 1 - {chi} END, 5) + 0.0 FROM (
      SELECT n, k, (12 / (n * (n + 1)) * spread - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM (
        SELECT count(*) - 1.0::DOUBLE AS k, any_value(n) AS n, any_value(ties) AS ties, sum(rs * rs / size) AS spread FROM {ranked}))"""


@query(
    "rank_battery",
    "WITH c AS (SELECT *, CASE WHEN c_nationkey < 12 THEN 'low' ELSE 'high' END AS side FROM customer) "
    + " UNION ALL ".join([*[_spearman_sql(*p) for p in RANK_PAIRS], *[_kendall_sql(*p) for p in RANK_PAIRS],
                          *[_labels_sql(c, x) for c in ("c_mktsegment", "side") for x in RANKED]]),
)
def rank_battery(spark, sf):
    """All four rank tests over three numbers and two categories, p-values included."""
    c = table(spark, sf, "customer").withColumn("side", F.when(F.col("c_nationkey") < 12, "low").otherwise("high"))
    found = R.rank_battery(c, RANKED, ["c_mktsegment", "side"])
    return found.withColumn("statistic", F.round("statistic", 6)).withColumn("p_value", F.round("p_value", 5))


BATTERY_PAIRS = [("o_orderpriority", "o_custkey"), ("o_orderpriority", "o_totalprice"), ("o_orderstatus", "o_custkey"),
                 ("o_orderstatus", "o_totalprice")]


def _moments_sql(c: str, x: str) -> str:
    return f"""SELECT '{c}' AS c, '{x}' AS x, count(*) AS k, sum(n) AS n, sum(n * pow(m - grand, 2)) AS ssb, sum(ss) AS ssw FROM
      (SELECT count(*) AS n, avg({x}) AS m, coalesce(var_samp({x}) * (count(*) - 1), 0) AS ss FROM orders GROUP BY {c}),
      (SELECT avg({x}) AS grand FROM orders)"""


@query(
    "test_battery",
    """SELECT 'welch' AS test, 'o_custkey' AS column_a, 'o_totalprice' AS column_b, count(*)::BIGINT AS n,
      round((avg(o_custkey) - avg(o_totalprice)) / sqrt(var_samp(o_custkey) / count(*) + var_samp(o_totalprice) / count(*)), 5) AS statistic
    FROM orders UNION ALL SELECT 'anova', c, x, n::BIGINT, round((ssb / (k - 1)) / (ssw / (n - k)), 5) FROM ("""
    + _union(_moments_sql(c, x) for c, x in BATTERY_PAIRS)
    + """) UNION ALL SELECT 'chi_square', 'o_orderpriority', 'o_orderstatus', any_value(t)::BIGINT, round(any_value(t) * (sum(n * n / (r * s)) - 1), 5)
    FROM (SELECT n, sum(n) OVER (PARTITION BY a) AS r, sum(n) OVER (PARTITION BY b) AS s, sum(n) OVER () AS t FROM
      (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2))""",
)
def test_battery(spark, sf):
    found = H.test_battery(
        table(spark, sf, "orders"), ["o_totalprice", "o_custkey"], ["o_orderstatus", "o_orderpriority"]
    )
    return found.select("test", "column_a", "column_b", "n", F.round("statistic", 5).alias("statistic"))


EFFECT_COLUMNS = ["o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice"]


def _information_sql(a: str, b: str) -> str:
    """Plug-in mutual information; numbers are cut at their deciles."""
    def code(x: str) -> str:
        if x not in ("o_custkey", "o_totalprice"):
            return x
        return f"""(SELECT count(*) FROM (SELECT DISTINCT unnest(q) AS e FROM (SELECT quantile_cont({x}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q,
          min({x}) AS low FROM orders)) WHERE e > (SELECT min({x}) FROM orders) AND e < {x})::VARCHAR"""

    return f"""SELECT 'mutual_information', '{a}', '{b}', any_value(t)::BIGINT, round(greatest(0.0, sum(n / t::DOUBLE * ln(n::DOUBLE * t / (r * s)))), 6) FROM
      (SELECT n, sum(n) OVER (PARTITION BY a) AS r, sum(n) OVER (PARTITION BY b) AS s, sum(n) OVER () AS t FROM
        (SELECT {code(a)} AS a, {code(b)} AS b, count(*) AS n FROM orders GROUP BY 1, 2))"""


@query(
    "effect_battery",
    """SELECT 'correlation_ratio' AS effect, c AS column_a, x AS column_b, n::BIGINT AS n, round(sqrt(ssb / (ssb + ssw)), 6) AS effect_size FROM ("""
    + _union(_moments_sql(c, x) for c, x in BATTERY_PAIRS)
    + """) UNION ALL SELECT 'cramers_v', 'o_orderpriority', 'o_orderstatus', any_value(t)::BIGINT,
      round(sqrt((sum(n * n / (r * s)) - 1) / least(count(DISTINCT a) - 1, count(DISTINCT b) - 1)), 6)
    FROM (SELECT a, b, n, sum(n) OVER (PARTITION BY a) AS r, sum(n) OVER (PARTITION BY b) AS s, sum(n) OVER () AS t FROM
      (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2)) UNION ALL """
    + " UNION ALL ".join(_information_sql(a, b) for i, a in enumerate(EFFECT_COLUMNS) for b in EFFECT_COLUMNS[i + 1 :]),
)
def effect_battery(spark, sf):
    """Cramer's V, eta and mutual information of all pairs."""
    found = H.effect_battery(
        table(spark, sf, "orders"), ["o_totalprice", "o_custkey"], ["o_orderstatus", "o_orderpriority"]
    )
    return rounded(found)
