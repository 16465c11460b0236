"""Row filters, slicers and feature projections. All are plain predicates, so they reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablegauge.functions import columns as C


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return C.normalise_missing(df).na.drop(subset=columns)


def finite_rows(df: DataFrame, column: str) -> DataFrame:
    return df.where(C.finite(C.as_double(df, column)).isNotNull())


def category_condition(selection: dict[str, list[str]]) -> Column:
    return C.all_of([C.quote(c).cast("string").isin(*v) for c, v in selection.items() if v])


def slice_rows(
    df: DataFrame,
    categories: dict[str, list[str]] | None = None,
    ranges: dict[str, tuple[float | None, float | None]] | None = None,
    dates: dict[str, tuple[str | None, str | None]] | None = None,
    search: str | None = None,
    search_columns: list[str] | None = None,
) -> DataFrame:
    """AND of value lists, numeric ranges (non-numbers fail), date ranges and a case-insensitive text search."""
    conditions: list[Column] = [category_condition(categories)] if categories else []
    for name, (low, high) in (ranges or {}).items():
        value = C.quote(name)
        if not C.is_numeric_type(df.schema[name].dataType):
            value = value.try_cast("double")
        conditions.append(value.isNotNull())
        if low is not None:
            conditions.append(value >= F.lit(low))
        if high is not None:
            conditions.append(value <= F.lit(high))
    for name, (start, end) in (dates or {}).items():
        value = C.quote(name)
        if not C.is_datetime_type(df.schema[name].dataType):
            value = value.try_cast("timestamp_ntz")
        conditions.append(value.isNotNull())
        if start is not None:
            conditions.append(value >= F.lit(start).cast("timestamp_ntz"))
        if end is not None:
            conditions.append(value <= F.lit(end).cast("timestamp_ntz"))
    if search and search_columns:
        hit = F.lit(False)
        for name in search_columns:
            hit = hit | F.coalesce(
                F.contains(F.lower(C.quote(name).cast("string")), F.lit(search.lower())), F.lit(False)
            )
        conditions.append(hit)
    return df.where(C.all_of(conditions))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-blank values, the options of a slicer."""
    value = F.trim(C.quote(column).cast("string"))
    return df.select(value.alias("value")).where(F.col("value") != "").distinct().orderBy("value")


def numeric_bounds(df: DataFrame, column: str) -> DataFrame:
    value = C.finite(C.as_double(df, column))
    return df.agg(F.min(value).alias("minimum"), F.max(value).alias("maximum"))


def feature_groups(df: DataFrame, target: str | None, excluded: list[str] | None = None) -> dict[str, list[str]]:
    """Feature names by role: numeric (with booleans), categorical, excluded. Schema only, no job."""
    excluded = sorted(set(excluded or []) | ({target} if target else set()))
    groups: dict[str, list[str]] = {"numeric": [], "categorical": [], "excluded": []}
    for f in df.schema.fields:
        kind = C.eda_kind(f.dataType)
        if f.name in excluded or kind in (C.DATETIME, C.UNKNOWN):
            groups["excluded"].append(f.name)
        elif kind == C.NUMERIC or f.dataType.simpleString() == "boolean":
            groups["numeric"].append(f.name)
        else:
            groups["categorical"].append(f.name)
    return {k: sorted(v) for k, v in groups.items()}


def project_features(df: DataFrame, target: str | None, excluded: list[str] | None = None) -> DataFrame:
    groups = feature_groups(df, target, excluded)
    return df.select(*[C.quote(c) for c in groups["numeric"] + groups["categorical"]])


def with_target(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is present."""
    return C.normalise_missing(df).where(C.quote(target).isNotNull())


def trim_unobserved_ends(df: DataFrame, target: str, time_column: str) -> DataFrame:
    """Keep the stretch from the first to the last row with a target; gaps inside stay."""
    df = C.normalise_missing(df)
    moment = C.as_number(df, time_column)
    seen = F.when(C.quote(target).isNotNull(), moment)
    ends = df.agg(F.min(seen).alias("first"), F.max(seen).alias("last")).first()
    return df.where(moment.between(F.lit(ends["first"]), F.lit(ends["last"])))


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]
