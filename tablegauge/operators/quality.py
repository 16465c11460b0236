"""Quality checks. Every check returns rows of one findings schema; thresholds are fixed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablegauge.functions import columns as C, moments, text
from tablegauge.operators import ordered, profile as P

# fixed values: thresholds and penalties of the quality rules
MISSING_LOW, MISSING_MEDIUM, MISSING_HIGH = 5.0, 20.0, 50.0
DUPLICATE_LOW, DUPLICATE_MEDIUM = 1.0, 10.0
PARSE_RATIO = 0.9
CATEGORY_MAX_DISTINCT, CATEGORY_MAX_SHARE = 50, 0.5
FENCE, OUTLIER_LOW, OUTLIER_MIN = 1.5, 5.0, 8
SKEW_LOW, SKEW_MEDIUM, SKEW_MIN = 1.0, 2.0, 8
CLASSES_MIN, CLASSES_MAX = 2, 20
IMBALANCE_LOW, IMBALANCE_MEDIUM, IMBALANCE_HIGH = 1.5, 4.0, 10.0
PENALTY = {"low": 2.0, "medium": 6.0, "high": 15.0, "critical": 35.0}
SEVERITY_ORDER = ["critical", "high", "medium", "low"]

MISSING = "missing_values"
DUPLICATES = "duplicate_rows"
TYPE_MISMATCH = "potential_type_mismatch"
CATEGORIES = "inconsistent_categories"
OUTLIERS = "potential_outliers"
SKEW = "high_skew"
IMBALANCE = "class_imbalance"
FINDING_TYPES = [MISSING, DUPLICATES, TYPE_MISMATCH, CATEGORIES, OUTLIERS, SKEW, IMBALANCE]

# fixed values: the action each finding type asks for
ACTIONS = {
    MISSING: "handle_missing_values",
    DUPLICATES: "remove_duplicate_rows",
    TYPE_MISMATCH: "convert_column_type",
    CATEGORIES: "standardize_category_values",
    OUTLIERS: "investigate_outliers",
    SKEW: "consider_distribution_transform",
    IMBALANCE: "address_class_imbalance",
}
CHECKS = ["missing_values", "duplicate_rows", "data_types", "categorical_consistency", "outliers", "skewness",
          "class_imbalance"]

FINDING_SCHEMA = T.StructType(
    [
        T.StructField("finding_id", T.StringType()),
        T.StructField("finding_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("affected_rows", T.LongType()),
        T.StructField("affected_percentage", T.DoubleType()),
        T.StructField("observed", T.StringType()),
        T.StructField("recommended_action", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("check_order", T.IntegerType()),
    ]
)


def steps(value: Column, *limits: tuple[float, str], last: str) -> Column:
    """First label whose upper limit holds the value."""
    out = F.lit(last)
    for limit, label in reversed(limits):
        out = F.when(value <= limit, F.lit(label)).otherwise(out)
    return out


def percentage(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(F.lit(100.0) * part, whole), F.lit(0.0)), 4)


def as_findings(
    rows: DataFrame,
    kind: str,
    severity: Column,
    column: Column,
    observed: Column,
    affected: Column | None = None,
    share: Column | None = None,
    confidence: Column | None = None,
    order: int | None = None,
) -> DataFrame:
    return rows.select(
        F.concat(F.lit(kind + ":"), F.coalesce(column, F.lit("_dataset_"))).alias("finding_id"),
        F.lit(kind).alias("finding_type"),
        severity.alias("severity"),
        column.cast("string").alias("column"),
        (affected if affected is not None else F.lit(None)).cast("long").alias("affected_rows"),
        (share if share is not None else F.lit(None)).cast("double").alias("affected_percentage"),
        F.to_json(observed).alias("observed"),
        F.lit(ACTIONS[kind]).alias("recommended_action"),
        (confidence if confidence is not None else F.lit(None)).cast("double").alias("confidence"),
        F.lit(order if order is not None else FINDING_TYPES.index(kind)).alias("check_order"),
    )


def missing_findings(missing: DataFrame) -> DataFrame:
    """From the missing-count table: one finding per column with any missing value."""
    pct = F.col("missing_percentage")
    return as_findings(
        missing.where(F.col("missing_count") > 0),
        MISSING,
        steps(pct, (MISSING_LOW, "low"), (MISSING_MEDIUM, "medium"), (MISSING_HIGH, "high"), last="critical"),
        F.col("column"),
        F.struct(
            "missing_count",
            "missing_percentage",
            (F.col("missing_count") == F.col("n_rows")).alias("fully_missing"),
        ),
        F.col("missing_count"),
        pct,
    )


def duplicate_findings(duplicates: DataFrame) -> DataFrame:
    pct = F.col("duplicate_percentage")
    return as_findings(
        duplicates.where(F.col("duplicate_rows") > 0),
        DUPLICATES,
        steps(pct, (DUPLICATE_LOW, "low"), (DUPLICATE_MEDIUM, "medium"), last="high"),
        F.lit(None).cast("string"),
        F.struct(F.col("duplicate_rows").alias("duplicate_row_count"), "duplicate_percentage"),
        F.col("duplicate_rows"),
        pct,
    )


def datetime_text_findings(types: DataFrame) -> DataFrame:
    """Columns stored as text whose values read as dates."""
    found = types.where((F.col("inferred_type") == C.DATETIME) & (F.col("storage_type") == "string"))
    return as_findings(
        found,
        TYPE_MISMATCH,
        F.lit("medium"),
        F.col("column"),
        F.struct(F.col("storage_type").alias("stored_dtype"), F.lit("datetime").alias("looks_like")),
        confidence=F.lit(0.9),
    )


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def parse_ratios(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of non-null text values that parse as numbers, per column, one pass."""
    return C.stack_rows(
        df.agg(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.count(C.quote(c)).alias("n_values"),
                    F.count(text.parse_number(C.quote(c))).alias("n_numeric"),
                ).alias(f"s{i}")
                for i, c in enumerate(columns)
            ]
        )
    ).withColumn("parse_ratio", F.try_divide(F.col("n_numeric"), F.col("n_values")))


def non_numeric_examples(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The k smallest distinct values per column that are not numbers (ordered, unlike first-seen)."""
    rows = C.unpivot_rows(df, [], [[F.lit(c).alias("column"), C.quote(c).alias("value")] for c in columns])
    bad = rows.where(F.col("value").isNotNull() & text.parse_number(F.col("value")).isNull())
    distinct = bad.groupBy("column", "value").agg(F.count("*").alias("n"))
    ranked = P.rank_values(distinct.withColumn("n", F.lit(1).cast("long")), k)
    return ranked.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("examples"))


def numeric_text_findings(df: DataFrame, types: DataFrame) -> DataFrame:
    columns = text_columns(df)
    if not columns:
        return empty_findings(df)
    categorical = types.where(F.col("inferred_type") == C.CATEGORICAL).select("column")
    ratios = parse_ratios(df, columns).where((F.col("n_values") > 0) & (F.col("parse_ratio") >= PARSE_RATIO))
    found = ratios.join(categorical, "column", "left_semi").join(non_numeric_examples(df, columns), "column", "left")
    ratio = F.round("parse_ratio", 4)
    return as_findings(
        found,
        TYPE_MISMATCH,
        F.lit("medium"),
        F.col("column"),
        F.struct(
            F.lit("string").alias("stored_dtype"),
            F.lit("numeric").alias("looks_like"),
            ratio.alias("parse_ratio"),
            F.coalesce("examples", F.array().cast("array<string>")).alias("example_non_numeric_values"),
        ),
        confidence=ratio,
    )


def category_variants(df: DataFrame, columns: list[str]) -> DataFrame:
    """Groups of spellings that agree after strip, collapse and case folding: (column, normalised, variants, n).

    Works on value counts; only columns that look categorical (few distinct values) reach the grouping, so a group
    holds at most 50 spellings.
    """
    counts = P.value_counts(df, columns)
    per_column = counts.groupBy("column").agg(F.count("*").alias("d"), F.sum("n").alias("present"))
    small = (
        C.attach_row(per_column, df.agg(F.count("*").alias("n_rows")))
        .where((F.col("d") <= CATEGORY_MAX_DISTINCT) & (F.col("d") <= F.lit(CATEGORY_MAX_SHARE) * F.col("n_rows")))
        .select("column", "n_rows")
    )
    return (
        counts.join(F.broadcast(small), "column")
        .groupBy("column", "n_rows", text.fold(F.col("value")).alias("normalised"))
        .agg(
            F.array_sort(F.collect_list("value")).alias("variants"),
            F.sum("n").alias("n"),
        )
        .where(F.size("variants") > 1)
    )


def category_findings(df: DataFrame, types: DataFrame) -> DataFrame:
    columns = text_columns(df)
    if not columns:
        return empty_findings(df)
    categorical = types.where(F.col("inferred_type") == C.CATEGORICAL).select("column")
    groups = category_variants(df, columns).join(categorical, "column", "left_semi")
    found = groups.groupBy("column", "n_rows").agg(
        F.count("*").alias("collisions"),
        F.sum("n").alias("affected"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("normalised", "variants")))).alias("variant_groups"),
    )
    return as_findings(
        found,
        CATEGORIES,
        F.when(F.col("collisions") > 1, "medium").otherwise("low"),
        F.col("column"),
        F.struct("variant_groups"),
        F.col("affected"),
        percentage(F.col("affected"), F.col("n_rows")),
        F.lit(0.7),
    )


def outlier_fences(df: DataFrame, columns: list[str]) -> DataFrame:
    """Tukey fences and what lies outside: (column, n, n_rows, q1, q3, lower, upper, outliers, min, max).

    Quartiles come back as two numbers per column and are used as literals, so the second pass is one aggregate.
    """
    values = {c: C.as_double(df, c) for c in columns}
    quartiles = ordered.quantile_values(df, values, [0.25, 0.75])
    columns = [c for c in columns if quartiles[c]]
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column string, n_rows long, n_values long, q1 double, q3 double, lower_fence double, "
            "upper_fence double, outlier_count long, min_outlier double, max_outlier double"
        )
    parts = []
    for i, c in enumerate(columns):
        q1, q3 = quartiles[c][0.25], quartiles[c][0.75]
        low, high = q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1)
        outside = (values[c] < F.lit(low)) | (values[c] > F.lit(high))
        parts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count("*").alias("n_rows"),
                F.count(values[c]).alias("n_values"),
                F.lit(q1).alias("q1"),
                F.lit(q3).alias("q3"),
                F.lit(low).alias("lower_fence"),
                F.lit(high).alias("upper_fence"),
                F.count_if(outside).alias("outlier_count"),
                F.min(F.when(outside, values[c])).alias("min_outlier"),
                F.max(F.when(outside, values[c])).alias("max_outlier"),
            ).alias(f"s{i}")
        )
    return C.stack_rows(df.agg(*parts))


def outlier_findings(df: DataFrame, columns: list[str]) -> DataFrame:
    if not columns:
        return empty_findings(df)
    fences = outlier_fences(df, columns)
    found = fences.where(
        (F.col("n_values") >= OUTLIER_MIN) & (F.col("q3") != F.col("q1")) & (F.col("outlier_count") > 0)
    )
    pct = percentage(F.col("outlier_count"), F.col("n_rows"))
    return as_findings(
        found,
        OUTLIERS,
        steps(pct, (OUTLIER_LOW, "low"), last="medium"),
        F.col("column"),
        F.struct(
            F.lit("iqr").alias("method"),
            F.lit(FENCE).alias("fence_multiplier"),
            "q1",
            "q3",
            "lower_fence",
            "upper_fence",
            "min_outlier",
            "max_outlier",
        ),
        F.col("outlier_count"),
        pct,
    )


def skew_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_values, more_than_two, skewness). Three distinct values exist exactly when something lies strictly
    between min and max, so that test needs the column's min and max, not a distinct count."""
    values = {c: C.as_double(df, c) for c in columns}
    extremes = df.agg(*[f(values[c]).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in
                        (("lo", F.min), ("hi", F.max))]).first()
    return C.stack_rows(
        df.agg(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.count(values[c]).alias("n_values"),
                    F.coalesce(
                        F.max((values[c] > F.lit(extremes[f"lo{i}"])) & (values[c] < F.lit(extremes[f"hi{i}"]))),
                        F.lit(False),
                    ).alias("more_than_two"),
                    moments.adjusted_skewness(values[c]).alias("skewness"),
                ).alias(f"s{i}")
                for i, c in enumerate(columns)
            ]
        )
    )


def skew_findings(df: DataFrame, columns: list[str]) -> DataFrame:
    if not columns:
        return empty_findings(df)
    skew = F.col("skewness")
    found = skew_table(df, columns).where(
        (F.col("n_values") >= SKEW_MIN) & F.col("more_than_two") & (F.abs(skew) >= SKEW_LOW)
    )
    return as_findings(
        found,
        SKEW,
        F.when(F.abs(skew) >= SKEW_MEDIUM, "medium").otherwise("low"),
        F.col("column"),
        F.struct(
            F.round(skew, 4).alias("skewness"),
            F.lit(SKEW_LOW).alias("threshold"),
            F.when(skew > 0, "right/positive").otherwise("left/negative").alias("direction"),
        ),
    )


def imbalance_table(df: DataFrame, target: str) -> DataFrame:
    """One row: class count, majority and minority (ties by label) and their ratio."""
    counts = P.value_counts(df, [target])
    return counts.agg(
        F.count("*").alias("n_classes"),
        F.sum("n").alias("n_labelled"),
        F.max("n").alias("majority"),
        F.min("n").alias("minority"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("majority_class"),
        F.max_by("value", F.struct(-F.col("n"), F.col("value"))).alias("minority_class"),
    ).withColumn("imbalance_ratio", F.try_divide(F.col("majority"), F.col("minority")))


def imbalance_findings(df: DataFrame, target: str | None) -> DataFrame:
    if target is None:
        return empty_findings(df)
    if target not in df.columns:
        raise ValueError(f"target column {target!r} is not a column of the table")
    ratio = F.col("imbalance_ratio")
    found = imbalance_table(df, target).where(
        F.col("n_classes").between(CLASSES_MIN, CLASSES_MAX) & (ratio >= IMBALANCE_LOW)
    )
    return as_findings(
        found,
        IMBALANCE,
        F.when(ratio >= IMBALANCE_HIGH, "high").when(ratio >= IMBALANCE_MEDIUM, "medium").otherwise("low"),
        F.lit(target),
        F.struct(
            "n_classes",
            "majority_class",
            "minority_class",
            F.round(ratio, 4).alias("imbalance_ratio"),
            percentage(F.col("minority"), F.col("n_labelled")).alias("minority_percentage"),
        ),
    )


def empty_findings(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], FINDING_SCHEMA)


def run_checks(df: DataFrame, target: str | None = None, checks: list[str] | None = None) -> DataFrame:
    """Findings of the named checks, in check order; sort with ``order_findings``."""
    df = C.normalise_missing(df)
    names = CHECKS if checks is None else checks
    unknown = [n for n in names if n not in CHECKS]
    if unknown:
        raise ValueError(f"unknown checks: {unknown}")
    numeric = C.numeric_columns(df)
    types = C.settle(P.column_types(df)) if {"data_types", "categorical_consistency"} & set(names) else None
    build = {
        "missing_values": lambda: [missing_findings(P.missing_counts(df))],
        "duplicate_rows": lambda: [duplicate_findings(P.duplicate_rows(df))],
        "data_types": lambda: [datetime_text_findings(types), numeric_text_findings(df, types)],
        "categorical_consistency": lambda: [category_findings(df, types)],
        "outliers": lambda: [outlier_findings(df, numeric)],
        "skewness": lambda: [skew_findings(df, numeric)],
        "class_imbalance": lambda: [imbalance_findings(df, target)],
    }
    parts = [f for n in CHECKS if n in names for f in build[n]()]
    return reduce(DataFrame.unionByName, parts) if parts else empty_findings(df)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITY_ORDER)), severity)


def order_findings(findings: DataFrame) -> DataFrame:
    """Most severe first, then check order, then column."""
    return findings.orderBy(severity_rank(F.col("severity")), "check_order", "column")


def penalty(severity: Column) -> Column:
    out = F.lit(0.0)
    for name, points in PENALTY.items():
        out = F.when(severity == name, F.lit(points)).otherwise(out)
    return out


def summarise(findings: DataFrame) -> DataFrame:
    """One row: counts per severity and type, columns with findings, score."""
    return findings.agg(
        F.count("*").alias("total_findings"),
        *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITY_ORDER],
        *[F.count_if(F.col("finding_type") == t).alias(f"n_{t}") for t in FINDING_TYPES],
        F.count_distinct("column").alias("columns_with_findings"),
        (F.count_if(F.col("severity") == "critical") > 0).alias("has_critical"),
        F.round(
            F.greatest(F.lit(0.0), F.lit(100.0) - F.coalesce(F.sum(penalty(F.col("severity"))), F.lit(0.0))), 2
        ).alias("score"),
    )


def compare_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings per type before and after, labelled improved, regressed or unchanged."""
    count = lambda rows, name: rows.groupBy("finding_type").agg(F.count("*").alias(name))
    joined = count(before, "before").join(count(after, "after"), "finding_type", "full_outer")
    b, a = F.coalesce("before", F.lit(0).cast("long")), F.coalesce("after", F.lit(0).cast("long"))
    return joined.select(
        "finding_type",
        b.alias("before"),
        a.alias("after"),
        F.when(a < b, "improved").when(a > b, "regressed").otherwise("unchanged").alias("change"),
    )


def compare_quality(
    before_df: DataFrame, after_df: DataFrame, before: DataFrame, after: DataFrame, target: str | None = None
) -> DataFrame:
    """Table-level before/after comparison as rows (measure, before, after, change)."""
    lost = sorted(set(before_df.columns) - set(after_df.columns))
    size = lambda d, name: d.agg(F.count("*").cast("double").alias(name))
    cells = lambda d, name: P.total_missing_cells(d).select(F.col("total_missing_cells").cast("double").alias(name))
    score = lambda f, name: summarise(f).select(F.col("score").alias(name))

    def measure(label: str, b: DataFrame, a: DataFrame, worse: Column) -> DataFrame:
        return C.attach_row(b, a).select(
            F.lit(label).alias("measure"),
            "before",
            "after",
            F.when(worse, "regressed").when(F.col("before") == F.col("after"), "unchanged").otherwise("improved").alias(
                "change"
            ),
        )

    rows = [
        measure("score", score(before, "before"), score(after, "after"), F.col("after") < F.col("before")),
        measure(
            "missing_cells", cells(before_df, "before"), cells(after_df, "after"), F.col("after") > F.col("before")
        ),
        measure("rows", size(before_df, "before"), size(after_df, "after"), F.col("after") > F.col("before")),
    ]
    facts = [("columns", float(len(before_df.columns)), float(len(after_df.columns)), "lost" if lost else "unchanged")]
    if target and target not in after_df.columns:
        facts.append(("target_column", 1.0, 0.0, "regressed"))
    rows.append(before_df.sparkSession.createDataFrame(facts, "measure string, before double, after double, change string"))
    return reduce(DataFrame.unionByName, rows)
