"""Data behind charts and dashboards: bounded result tables, no drawing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tablegauge.functions import columns as C
from tablegauge.operators import explore as X, hypothesis as H, ordered, profile as P, ranktests as R

# fixed values: chart scores and report limits
SCORES = {
    ("scatter_plot", "numeric"): 90.0,
    ("box_plot", "numeric"): 80.0,
    ("histogram", "numeric"): 70.0,
    ("box_plot", "categorical"): 90.0,
    ("bar_chart", "categorical"): 80.0,
    ("histogram", "categorical"): 50.0,
}
MAX_CATEGORIES = 50
MAX_CHARTS = 50
MAX_RECOMMENDATIONS = 10
DASHBOARD_BINS = 12
TOP_IN_FILTER = 8
MIN_CORRELATION_PAIRS = 5
STRONG, MODERATE = 0.7, 0.4
STACK_ROWS, STACK_COLUMNS = 10, 6


def histogram_data(df: DataFrame, column: str) -> DataFrame:
    return X.histograms(df, [column])


def bar_data(df: DataFrame, column: str, limit: int = MAX_CATEGORIES) -> DataFrame:
    return P.top_values(df, [column], limit).select("position", "value", "n")


def scatter_data(df: DataFrame, x: str, y: str, limit: int | None = None) -> DataFrame:
    """Complete finite pairs. With ``limit`` (a drawing budget) the rows with the smallest hash are kept, which is a
    fixed sample whatever the partitioning."""
    points = df.select(C.finite(C.as_double(df, x)).alias("x"), C.finite(C.as_double(df, y)).alias("y")).where(
        C.complete(F.col("x"), F.col("y"))
    )
    if limit is None:
        return points
    return points.orderBy(F.xxhash64("x", "y"), "x", "y").limit(limit)


def box_data(df: DataFrame, category: str, numeric: str, limit: int | None = None) -> DataFrame:
    """Five-number summary and count per category; with ``limit`` only for the first categories by name."""
    value, label = C.finite(C.as_double(df, numeric)), C.as_text(df, category)
    rows = df.select(label.alias("category"), value.alias("value")).where(C.complete(F.col("category"), F.col("value")))
    basic = rows.groupBy("category").agg(
        F.count("*").alias("n"), F.min("value").alias("minimum"), F.max("value").alias("maximum")
    )
    kept = basic
    if limit is not None:
        kept = basic.orderBy("category").limit(limit)
        rows = rows.join(F.broadcast(kept.select("category")), "category", "left_semi")  # at most ``limit`` rows
    quartiles = ordered.quantile_columns(
        rows, {numeric: F.col("value")}, P.QUARTILES, {"category": F.col("category")}
    ).drop("column")
    return kept.join(quartiles, "category").select("category", "n", "minimum", "q25", "median", "q75", "maximum")


def available_charts(df: DataFrame) -> DataFrame:
    """Charts that can be drawn: (kind, columns, x, y). Constant or empty numbers and categories over the limit drop
    out; decided from one facts table."""
    kinds = C.eda_kinds(df)
    numeric = sorted(c for c, k in kinds.items() if k == C.NUMERIC)
    categorical = sorted(c for c, k in kinds.items() if k == C.CATEGORICAL)
    parts = []
    for i, c in enumerate(numeric):
        v = C.finite(C.as_double(df, c))
        parts.append(F.struct(F.lit(c).alias("column"), F.coalesce(F.min(v) < F.max(v), F.lit(False)).alias("usable")).alias(f"s{i}"))
    spread = {r["column"]: r["usable"] for r in C.stack_rows(df.agg(*parts)).collect()} if parts else {}
    sizes = {r["column"]: r["unique_count"] for r in P.distinct_counts(df, categorical).collect()} if categorical else {}
    cats = [c for c in categorical if 1 <= sizes[c] <= MAX_CATEGORIES]
    nums = [c for c in numeric if spread[c]]
    rows = [("histogram", c, c, None) for c in nums[:MAX_CHARTS]]
    rows += [("bar_chart", c, c, None) for c in cats[:MAX_CHARTS]]
    rows += [("scatter_plot", f"{a},{b}", a, b) for a, b in X.name_pairs(nums, MAX_CHARTS)]
    rows += [("box_plot", f"{c},{n}", c, n) for c in cats for n in nums][:MAX_CHARTS]
    return df.sparkSession.createDataFrame(rows, "kind string, columns string, x string, y string")


def recommend_charts(df: DataFrame, target: str, limit: int = MAX_RECOMMENDATIONS) -> DataFrame:
    """Charts that involve the target, by fixed score, then kind, then columns."""
    kind = C.eda_kinds(df).get(target)
    if kind not in (C.NUMERIC, C.CATEGORICAL):
        raise ValueError(f"target {target!r} must be a numeric or categorical column")
    charts = available_charts(df)
    touches = (F.col("x") == target) | (F.col("y") == target)
    if kind == C.CATEGORICAL:
        with_box = [r["y"] for r in charts.where((F.col("kind") == "box_plot") & (F.col("x") == target)).collect()]
        touches = touches | ((F.col("kind") == "histogram") & F.col("x").isin(with_box))
    score = F.lit(None).cast("double")
    for (chart, target_kind), points in SCORES.items():
        if target_kind == kind:
            fits = F.col("kind") == chart
            if chart == "box_plot":
                fits = fits & (F.col("y" if kind == C.NUMERIC else "x") == target)
            score = F.when(fits, F.lit(points)).otherwise(score)
    chosen = charts.where(touches).withColumn("score", score).where(F.col("score").isNotNull())
    order = [F.desc("score"), F.asc("kind"), F.asc("columns")]
    return _numbered(chosen, order, limit).select("rank", "kind", "columns", "score")


def _numbered(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """Rank a report-sized table (charts of one table, at most a few hundred rows)."""
    from pyspark.sql import Window as W

    return rows.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order))).where(
        F.col("rank") <= limit
    )


def rank_by_strength(df: DataFrame, target: str, limit: int = MAX_RECOMMENDATIONS) -> DataFrame:
    """Predictors by strength of association with the target.

    Number and number: abs(r) with the Spearman p-value; category and number: eta with the ANOVA p-value; two
    categories: Cramer's V with the chi-square p-value. Missing scores come last.
    """
    kinds = C.eda_kinds(df)
    usable = {(r["kind"], r["x"], r["y"]) for r in available_charts(df).collect()}
    numeric = sorted({x for k, x, _ in usable if k == "histogram"} - {target})
    categorical = sorted({x for k, x, _ in usable if k == "bar_chart"} - {target})
    parts = []
    shape = ("kind", "predictor", "relationship", "strength", "statistic_name", "statistic", "p_value")
    other = lambda a, b: F.when(F.col(a) == target, F.col(b)).otherwise(F.col(a))
    if kinds[target] == C.NUMERIC:
        pairs = [tuple(sorted((n, target))) for n in numeric]
        if pairs:
            tested = R.spearman_test(df, pairs).select("column_a", "column_b", "statistic", "p_value")
            both = X.pair_correlations(df, pairs).join(tested, ["column_a", "column_b"])
            parts.append(
                both.select(
                    F.lit("scatter_plot"), other("column_a", "column_b"), F.lit("numeric-numeric"),
                    F.abs("correlation"), F.lit("spearman_rho"), "statistic", "p_value",
                ).toDF(*shape)
            )
        combos = (categorical, [target], "category_column")
    else:
        combos = ([target], numeric, "numeric_column")
        pairs = [tuple(sorted((c, target))) for c in categorical]
        if pairs:
            tested = H.chi_square_test(df, pairs).select("column_a", "column_b", "statistic", "p_value")
            both = H.cramers_v(df, pairs).join(tested, ["column_a", "column_b"])
            parts.append(
                both.select(
                    F.lit("bar_chart"), other("column_a", "column_b"), F.lit("categorical-categorical"),
                    "effect_size", F.lit("chi_square"), "statistic", "p_value",
                ).toDF(*shape)
            )
    cats, nums, predictor = combos
    if cats and nums:
        keys = ["category_column", "numeric_column"]
        both = H.correlation_ratio(df, cats, nums).join(
            H.anova_test(df, cats, nums).select(*keys, "statistic", "p_value"), keys, "left"
        )
        parts.append(
            both.select(
                F.lit("box_plot"), predictor, F.lit("categorical-numeric"), "effect_size", F.lit("anova_f"),
                "statistic", "p_value",
            ).toDF(*shape)
        )
    rows = reduce(DataFrame.unionByName, parts)
    order = [F.desc_nulls_last("strength"), F.coalesce("p_value", F.lit(2.0)), F.asc("kind"), F.asc("predictor")]
    return _numbered(rows, order, limit).select("rank", *shape)


def kpi_cards(df: DataFrame) -> DataFrame:
    """Row count, averages of the first two numeric columns and the most frequent value of the first category."""
    kinds = C.eda_kinds(df)
    numeric = [c for c in df.columns if kinds[c] == C.NUMERIC][:2]
    category = [c for c in df.columns if kinds[c] == C.CATEGORICAL][:1]
    base = df.agg(
        F.count("*").cast("double").alias("rows"), *[F.avg(C.as_double(df, c)).alias(f"a{i}") for i, c in enumerate(numeric)]
    )
    cards = base.select(
        F.inline(
            F.array(
                F.struct(F.lit("row_count").alias("card"), F.col("rows").alias("value"), F.lit(None).cast("string").alias("label")),
                *[
                    F.struct(F.lit("average").alias("card"), F.col(f"a{i}").alias("value"), F.lit(c).alias("label"))
                    for i, c in enumerate(numeric)
                ],
            )
        )
    )
    for c in category:
        top = P.top_values(df, [c], 1).select(
            F.lit("top_category").alias("card"), F.col("n").cast("double").alias("value"), F.col("value").alias("label")
        )
        cards = cards.unionByName(top)
    return cards


def monthly_trend(df: DataFrame, date: str, value: str | None = None) -> DataFrame:
    """Average of a number (or row count) per calendar month."""
    month = F.date_format(C.quote(date), "yyyy-MM").alias("month")
    measure = F.avg(C.as_double(df, value)) if value else F.count("*").cast("double")
    return df.where(C.quote(date).isNotNull()).groupBy(month).agg(measure.alias("value"), F.count("*").alias("n"))


def filtered_histogram(df: DataFrame, column: str, limit: int = DASHBOARD_BINS) -> DataFrame:
    """Histogram of a filtered table with at most twelve bins; a constant column is one bin."""
    value = C.finite(C.as_double(df, column))
    flat = df.agg(F.min(value).alias("left_edge"), F.max(value).alias("right_edge"), F.count(value).alias("count"))
    single = flat.where((F.col("count") > 0) & (F.col("left_edge") == F.col("right_edge")))
    return X.histograms(df, [column], limit).unionByName(
        single.select(F.lit(column).alias("column"), F.lit(0).alias("bin"), "left_edge", "right_edge", "count")
    )


def upper_median(df: DataFrame, column: str) -> DataFrame:
    """The dashboards' median: the element at floor(n / 2), no interpolation."""
    value = C.finite(C.as_double(df, column))
    middle = ordered.quantiles(df, {column: value}, [0.5], height=lambda total, p: total // 2)
    return middle.select("column", F.col("quantile").alias("median"))


def top_categories(df: DataFrame, column: str, k: int = TOP_IN_FILTER) -> DataFrame:
    """Top values of a filtered table with share, distinct count and missing count."""
    top = X.categorical_summary(df, [column], k)
    missing = P.missing_counts(df, [column]).select("column", "missing_count")
    return top.join(F.broadcast(missing), "column").select(
        "position", "value", "n", "frequency", "unique_count", "missing_count"
    )


def correlation_ranking(df: DataFrame, columns: list[str] | None = None, limit: int = 10) -> DataFrame:
    """Pairs by absolute correlation; pairs without one are left out."""
    pairs = X.correlations(df, columns).where(F.col("correlation").isNotNull())
    return pairs.orderBy(F.desc(F.abs("correlation")), "column_a", "column_b").limit(limit)


def strongest_correlation(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    r = F.abs("correlation")
    pairs = X.correlations(df, columns).where(F.col("correlation").isNotNull() & (F.col("n") >= MIN_CORRELATION_PAIRS))
    best = pairs.orderBy(F.desc(r), "column_a", "column_b").limit(1)
    return best.withColumn("strength", F.when(r > STRONG, "strong").when(r > MODERATE, "moderate").otherwise("weak"))


def grouped_means(df: DataFrame, category: str, numeric: str) -> DataFrame:
    return df.where(C.as_text(df, category).isNotNull()).groupBy(C.as_text(df, category).alias("category")).agg(
        F.avg(C.as_double(df, numeric)).alias("mean"), F.count(C.as_double(df, numeric)).alias("n")
    )


def stacked_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of a x b as a pivot: first ten labels of a, first six of b, by name."""
    cells = X.contingency(df, a, b, cap=None)
    labels = [r["b"] for r in cells.select("b").distinct().orderBy("b").limit(STACK_COLUMNS).collect()]
    wide = cells.groupBy("a").pivot("b", labels).agg(F.sum("n"))
    return wide.na.fill(0, labels).orderBy("a").limit(STACK_ROWS)


def treemap(df: DataFrame, column: str, k: int = 12) -> DataFrame:
    """Share of the most frequent categories among all present rows."""
    return X.categorical_summary(df, [column], k).select("position", "value", "n", F.col("frequency").alias("share"))
