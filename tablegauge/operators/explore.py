"""Exploratory summaries: univariate, bivariate, missingness and distribution shape."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from tablegauge.functions import columns as C, moments
from tablegauge.operators import ordered, profile as P

# fixed values: report limits
MAX_PAIRS = 50
MAX_BINS = 50
TOP_CATEGORIES = 10
SUMMARY_QUANTILES = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}
ROUND = 10


def classify(df: DataFrame) -> DataFrame:
    """(column, kind) from the schema; no job over the data."""
    return df.sparkSession.createDataFrame(sorted(C.eda_kinds(df).items()), "column string, kind string")


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    columns = columns or C.numeric_columns(df)
    spread = ordered.quantile_columns(df, {c: C.as_double(df, c) for c in columns}, SUMMARY_QUANTILES)
    return P.numeric_moments(df, columns).join(F.broadcast(spread), "column", "left").select(
        "column", "count", "mean", "std", "minimum", *SUMMARY_QUANTILES, "maximum"
    )


def categorical_summary(df: DataFrame, columns: list[str], k: int = TOP_CATEGORIES) -> DataFrame:
    """The k most frequent values per column with share of present rows and cardinality ratio."""
    counts = P.value_counts(df, columns)
    totals = counts.groupBy("column").agg(F.count("*").alias("unique_count"), F.sum("n").alias("present"))
    return P.rank_values(counts, k).join(F.broadcast(totals), "column").select(
        "column",
        "position",
        "value",
        "n",
        F.round(F.col("n") / F.col("present"), 6).alias("frequency"),
        "unique_count",
        F.round(F.col("unique_count") / F.col("present"), 6).alias("cardinality_ratio"),
    )


def datetime_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    return P.datetime_profile(df, columns).join(P.distinct_counts(df, columns), "column").select(
        "column", "minimum", "maximum", "count", "unique_count"
    )


def missingness(df: DataFrame) -> DataFrame:
    """Missing count and percentage per column, plus a row for the whole table."""
    per_column = P.missing_counts(df, digits=6)
    whole = per_column.agg(F.sum("n_rows").alias("n_rows"), F.sum("missing_count").alias("missing_count")).select(
        F.lit("*").alias("column"),
        "n_rows",
        "missing_count",
        F.round(
            F.coalesce(F.try_divide(F.lit(100.0) * F.col("missing_count"), F.col("n_rows")), F.lit(0.0)), 6
        ).alias("missing_percentage"),
    )
    return per_column.unionByName(whole)


def name_pairs(columns: list[str], cap: int | None = None) -> list[tuple[str, str]]:
    pairs = list(combinations(sorted(columns), 2))
    return pairs if cap is None else pairs[:cap]


def truncation_notes(df: DataFrame, numeric: list[str], categorical: list[str], cap: int = MAX_PAIRS) -> DataFrame:
    """What the report limits cut: (battery, candidates, kept)."""
    n, c = len(numeric), len(categorical)
    sizes = {
        "numeric_pairs": n * (n - 1) // 2,
        "categorical_numeric": n * c,
        "categorical_pairs": c * (c - 1) // 2,
    }
    rows = [(k, v, min(v, cap)) for k, v in sizes.items() if v > cap]
    return df.sparkSession.createDataFrame(rows, "battery string, candidates int, kept int")


def correlations(df: DataFrame, columns: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """Pearson r over complete pairs, all pairs in one aggregate; NULL when a side is constant."""
    pairs = name_pairs(columns or C.numeric_columns(df), cap)
    return pair_correlations(df, pairs)


PAIRS_PER_PASS = 500


def pair_correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Wide tables take one aggregate per ``PAIRS_PER_PASS`` pairs."""
    passes = [pairs[i : i + PAIRS_PER_PASS] for i in range(0, len(pairs), PAIRS_PER_PASS)] or [[]]
    return reduce(DataFrame.unionByName, [_pair_pass(df, p) for p in passes])


def _pair_pass(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    parts = []
    for i, (a, b) in enumerate(pairs):
        x, y = C.as_double(df, a), C.as_double(df, b)
        both = x.isNotNull() & y.isNotNull()
        parts.append(
            F.struct(
                F.lit(a).alias("column_a"),
                F.lit(b).alias("column_b"),
                F.count_if(both).alias("n"),
                F.round(moments.pearson(x, y), ROUND).alias("correlation"),
            ).alias(f"s{i}")
        )
    return C.stack_rows(df.agg(*parts))


def group_summary(df: DataFrame, category: str, numeric: str, cap: int | None = None) -> DataFrame:
    """Count, mean and exact median of a number per category; with ``cap`` only for the first categories by name."""
    value, label = C.as_double(df, numeric), C.as_text(df, category)
    rows = df.select(label.alias("category"), value.alias("value")).where(C.complete(F.col("category"), F.col("value")))
    basic = rows.groupBy("category").agg(F.count("*").alias("count"), F.avg("value").alias("mean"))
    if cap is not None:
        basic = basic.orderBy("category").limit(cap)
        rows = rows.join(F.broadcast(basic.select("category")), "category", "left_semi")  # at most ``cap`` rows
    medians = ordered.quantiles(rows, {numeric: F.col("value")}, [0.5], {"category": F.col("category")})
    return basic.join(medians.select("category", F.col("quantile").alias("median")), "category").select(
        "category", "count", "mean", "median"
    )


def contingency(df: DataFrame, a: str, b: str, cap: int | None = None) -> DataFrame:
    """Counts of (a, b) over complete rows, sorted; partial counts before the shuffle."""
    cells = (
        df.select(C.as_text(df, a).alias("a"), C.as_text(df, b).alias("b"))
        .where(C.complete(F.col("a"), F.col("b")))
        .groupBy("a", "b")
        .agg(F.count("*").alias("n"))
    )
    return cells if cap is None else cells.orderBy("a", "b").limit(cap)


def shape(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Variance, std, adjusted skewness and kurtosis over finite values."""
    columns = columns or C.numeric_columns(df)
    return C.stack_rows(
        df.agg(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.count(v).alias("count"),
                    F.avg(v).alias("mean"),
                    F.var_samp(v).alias("variance"),
                    F.stddev_samp(v).alias("std"),
                    moments.adjusted_skewness(v).alias("skewness"),
                    moments.adjusted_kurtosis(v).alias("kurtosis"),
                ).alias(f"s{i}")
                for i, (c, v) in enumerate((c, C.finite(C.as_double(df, c))) for c in columns)
            ]
        )
    )


def sturges_bins(n: int, limit: int = MAX_BINS) -> int:
    return 1 if n <= 1 else max(1, min(math.ceil(math.log2(n)) + 1, limit))


def bin_index(value: Column, low: float, high: float, bins: int) -> Column:
    """0-based equal-width bin, last bin closed; the edge test settles rounding at bin borders."""
    width = (high - low) / bins
    edge = lambda i: F.lit(low) + i * F.lit(width)
    rough = F.least(F.floor((value - F.lit(low)) / F.lit(high - low) * F.lit(float(bins))), F.lit(bins - 1))
    down = F.when(value < edge(rough), rough - 1).otherwise(rough)
    return F.when((value >= edge(down + 1)) & (down < bins - 1), down + 1).otherwise(down).cast("int")


def histograms(df: DataFrame, columns: list[str] | None = None, limit: int = MAX_BINS) -> DataFrame:
    """Sturges histogram per column with empty bins: (column, bin, left_edge, right_edge, count).

    First pass: n, min, max of every column (three numbers each). Second pass: counts per bin. Constant or empty
    columns have no bins.
    """
    columns = columns or C.numeric_columns(df)
    values = {c: C.finite(C.as_double(df, c)) for c in columns}
    bounds = df.agg(
        *[f(values[c]).alias(f"{k}{i}") for i, c in enumerate(columns)
          for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    ).first()
    plan = {}
    for i, c in enumerate(columns):
        n, low, high = bounds[f"n{i}"], bounds[f"lo{i}"], bounds[f"hi{i}"]
        if n and low < high:
            plan[c] = (low, high, sturges_bins(n, limit))
    frame = [
        (c, b, low + b * (high - low) / k, low + (b + 1) * (high - low) / k)
        for c, (low, high, k) in plan.items()
        for b in range(k)
    ]
    bins = df.sparkSession.createDataFrame(frame, "column string, bin int, left_edge double, right_edge double")
    if not plan:
        return bins.withColumn("count", F.lit(0).cast("long"))
    rows = C.unpivot_rows(
        df, [], [[F.lit(c).alias("column"), bin_index(values[c], *p).alias("bin")] for c, p in plan.items()]
    )
    counted = rows.where(F.col("bin").isNotNull()).groupBy("column", "bin").agg(F.count("*").alias("count"))
    return F.broadcast(bins).join(counted, ["column", "bin"], "left").select(
        "column",
        "bin",
        F.round("left_edge", ROUND).alias("left_edge"),
        F.round("right_edge", ROUND).alias("right_edge"),
        F.coalesce("count", F.lit(0).cast("long")).alias("count"),
    )


def cross_reference(df: DataFrame, findings: DataFrame, target: str | None = None) -> DataFrame:
    """For each finding the exploratory signal that backs it: (finding_id, column, signal, evidence).

    Signals are computed once for all columns and joined to the findings by (column, signal).
    """
    # fixed values: signal kind per finding type
    signal_of = {
        "missing_values": "missingness",
        "high_skew": "skewness",
        "potential_outliers": "dispersion",
        "potential_type_mismatch": "column_type",
        "inconsistent_categories": "category_cardinality",
        "class_imbalance": "class_balance",
    }
    df = C.normalise_missing(df)
    kinds = C.eda_kinds(df)
    numeric = [c for c, k in kinds.items() if k == C.NUMERIC]
    categorical = [c for c, k in kinds.items() if k == C.CATEGORICAL]
    facts = [
        P.missing_counts(df, digits=6)
        .where(F.col("missing_count") > 0)
        .select(
            "column",
            F.lit("missingness").alias("signal"),
            F.to_json(F.struct("missing_count", "missing_percentage")).alias("evidence"),
        ),
        classify(df).select(
            "column", F.lit("column_type").alias("signal"), F.to_json(F.struct("kind")).alias("evidence")
        ),
    ]
    if numeric:
        facts.append(
            shape(df, numeric)
            .where(F.col("skewness").isNotNull())
            .select(
                "column",
                F.lit("skewness").alias("signal"),
                F.to_json(F.struct(F.round("skewness", 6).alias("skewness"), F.round("kurtosis", 6).alias("kurtosis"))).alias("evidence"),
            )
        )
        facts.append(
            P.numeric_profile(df, numeric)
            .where(F.col("count") > 0)
            .select(
                "column",
                F.lit("dispersion").alias("signal"),
                F.to_json(F.struct("minimum", "q25", "median", "q75", "maximum")).alias("evidence"),
            )
        )
    if categorical:
        cardinality = categorical_summary(df, categorical, 1)
        for signal in ("category_cardinality", "class_balance"):
            chosen = cardinality if signal == "category_cardinality" else cardinality.where(F.col("column") == target)
            facts.append(
                chosen.select(
                    "column",
                    F.lit(signal).alias("signal"),
                    F.to_json(F.struct("unique_count", F.col("value").alias("most_frequent"), "frequency")).alias(
                        "evidence"
                    ),
                )
            )
    signals = facts[0]
    for f in facts[1:]:
        signals = signals.unionByName(f)
    signal = F.lit(None).cast("string")
    for kind, name in signal_of.items():
        signal = F.when(F.col("finding_type") == kind, F.lit(name)).otherwise(signal)
    return (
        findings.withColumn("signal", signal)
        .where(F.col("signal").isNotNull())
        .join(F.broadcast(signals), ["column", "signal"], "left")
        .select("finding_id", "finding_type", "severity", "column", "signal", "evidence")
    )
