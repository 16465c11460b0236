"""Column profile: one row per column, from one wide aggregate plus one value count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tablegauge.functions import columns as C
from tablegauge.operators import ordered

# fixed values: text counts as a date when nearly all values look like one and parse
DATE_RATIO = 0.9
DATE_MARK = r"[-/:]"
LETTER = r"[A-Za-z]"
DATE_MAX_LENGTH = 64
# fixed values: accepted date and time layouts, tried in this order
DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy/MM/dd",
    "MM/dd/yyyy",
    "dd-MM-yyyy",
    "d MMM yyyy",
    "MMM d, yyyy",
)
TOP_VALUES = 5
QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def parse_datetime(value: Column) -> Column:
    """Lenient text to timestamp: the first layout that fits the whole value."""
    text = F.trim(value)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS], F.try_to_timestamp(text))


def _share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def numeric_text(value: Column) -> Column:
    return F.expr("try_cast(`{}` AS DOUBLE)".format(value)) if isinstance(value, str) else value.try_cast("double")


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows (column, value, n) over non-null values, as text; partial counts before the shuffle."""
    columns = columns or df.columns
    rows = C.unpivot_rows(
        df, [], [[F.lit(c).alias("column"), C.as_text(df, c).alias("value")] for c in columns]
    )
    return rows.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, columns: list[str] | None = None, rsd: float | None = None) -> DataFrame:
    """Exact distinct non-null values per column; with ``rsd`` a HyperLogLog estimate in one pass."""
    columns = columns or df.columns
    if rsd is not None:
        return C.stack_rows(
            df.agg(
                *[
                    F.struct(
                        F.lit(c).alias("column"), F.approx_count_distinct(C.as_text(df, c), rsd).alias("unique_count")
                    ).alias(f"s{i}")
                    for i, c in enumerate(columns)
                ]
            )
        )
    counted = value_counts(df, columns).groupBy("column").agg(F.count("*").alias("unique_count"))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return every.join(F.broadcast(counted), "column", "left").select(
        "column", F.coalesce("unique_count", F.lit(0).cast("long")).alias("unique_count")
    )


def inferred_kind(df: DataFrame, name: str) -> Column:
    """Aggregate that yields the profile kind of one column."""
    data_type = df.schema[name].dataType
    value = C.quote(name)
    if isinstance(data_type, T.BooleanType):
        kind = F.lit(C.BOOLEAN)
    elif C.is_numeric_type(data_type):
        kind = F.lit(C.NUMERIC)
        value = C.as_double(df, name)
    elif C.is_datetime_type(data_type):
        kind = F.lit(C.DATETIME)
    elif isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        marked = F.greatest(_share(value.rlike(DATE_MARK)), _share(value.rlike(LETTER))) >= DATE_RATIO
        # cheap tests guard the parser: no accepted layout is without a digit or longer than this
        parsed = F.when((F.length(value) <= DATE_MAX_LENGTH) & value.rlike(r"\d"), parse_datetime(value))
        dated = F.count(parsed) >= F.lit(DATE_RATIO) * F.count(value)
        kind = F.when(marked & dated, F.lit(C.DATETIME)).otherwise(F.lit(C.CATEGORICAL))
    else:
        kind = F.lit(C.UNKNOWN)
    return F.when(F.count(value) == 0, F.lit(C.UNKNOWN)).otherwise(kind)


def column_types(df: DataFrame) -> DataFrame:
    """Inferred kind per column (``column, position, storage_type, inferred_type``)."""
    return C.stack_rows(
        df.agg(
            *[
                F.struct(
                    F.lit(f.name).alias("column"),
                    F.lit(i).alias("position"),
                    F.lit(f.dataType.simpleString()).alias("storage_type"),
                    inferred_kind(df, f.name).alias("inferred_type"),
                ).alias(f"s{i}")
                for i, f in enumerate(df.schema.fields)
            ]
        )
    )


def table_header(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(",".join(df.columns)).alias("column_names"),
    )


def missing_counts(df: DataFrame, columns: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Missing values and their percentage for every column, one pass."""
    columns = columns or df.columns
    df = C.normalise_missing(df)
    return C.stack_rows(
        df.agg(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.count("*").alias("n_rows"),
                    F.count_if(C.quote(c).isNull()).alias("missing_count"),
                    F.round(
                        F.coalesce(
                            F.try_divide(F.lit(100.0) * F.count_if(C.quote(c).isNull()), F.count("*")), F.lit(0.0)
                        ),
                        digits,
                    ).alias("missing_percentage"),
                ).alias(f"s{i}")
                for i, c in enumerate(columns)
            ]
        )
    )


def total_missing_cells(df: DataFrame) -> DataFrame:
    df = C.normalise_missing(df)
    nulls = [F.when(C.quote(c).isNull(), F.lit(1)).otherwise(F.lit(0)) for c in df.columns]
    total = nulls[0]
    for n in nulls[1:]:
        total = total + n
    return df.agg(F.coalesce(F.sum(total), F.lit(0)).alias("total_missing_cells"))


def numeric_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, sample std, min and max for numeric columns in one aggregate."""
    return C.stack_rows(
        df.agg(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.count(v).alias("count"),
                    F.avg(v).alias("mean"),
                    F.stddev_samp(v).alias("std"),
                    F.min(v).alias("minimum"),
                    F.max(v).alias("maximum"),
                ).alias(f"s{i}")
                for i, (c, v) in enumerate((c, C.as_double(df, c)) for c in columns)
            ]
        )
    )


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Numeric statistics with exact quartiles, one row per numeric column."""
    columns = columns or C.numeric_columns(df)
    values = {c: C.as_double(df, c) for c in columns}
    spread = ordered.quantile_columns(df, values, QUARTILES)
    return numeric_moments(df, columns).join(F.broadcast(spread), "column", "left").select(
        "column", "count", "mean", "std", "minimum", "q25", "median", "q75", "maximum"
    )


def top_values(df: DataFrame, columns: list[str], k: int = TOP_VALUES) -> DataFrame:
    """The k most frequent values per column, ties by value. The rank limit is applied before the shuffle."""
    return rank_values(value_counts(df, columns), k)


def rank_values(counts: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def categorical_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct count, mode with count and the five most frequent values (as JSON text) per column."""
    counts = value_counts(df, columns)
    top = rank_values(counts, TOP_VALUES)
    listed = top.groupBy("column").agg(
        F.max(F.when(F.col("position") == 1, F.col("value"))).alias("most_frequent"),
        F.max(F.when(F.col("position") == 1, F.col("n"))).alias("most_frequent_count"),
        F.to_json(
            F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda s: s["value"])
        ).alias("sample_values"),
    )
    distinct = counts.groupBy("column").agg(F.count("*").alias("distinct_count"))
    return distinct.join(F.broadcast(listed), "column").select(
        "column", "distinct_count", "most_frequent", "most_frequent_count", "sample_values"
    )


def datetime_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Earliest and latest value; text columns are parsed leniently."""

    def moment(c: str) -> Column:
        value = C.quote(c)
        return value if C.is_datetime_type(df.schema[c].dataType) else parse_datetime(value)

    iso = lambda v: F.date_format(v, "yyyy-MM-dd'T'HH:mm:ss")
    return C.stack_rows(
        df.agg(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    iso(F.min(moment(c))).alias("minimum"),
                    iso(F.max(moment(c))).alias("maximum"),
                    F.count(moment(c)).alias("count"),
                ).alias(f"s{i}")
                for i, c in enumerate(columns)
            ]
        )
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row (NULL equals NULL), with the total.

    Rows are grouped by a 32-byte digest of their typed values, so that the shuffle carries that instead of the row.
    """
    return duplicate_summary(row_groups(df))


def row_groups(df: DataFrame) -> DataFrame:
    """One row per distinct input row: its digest and how often it occurs."""
    digest = row_digest(df)
    return df.select(digest.alias("digest")).groupBy("digest").agg(F.count("*").alias("copies"))


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of the row's typed values, each written with its length, so that no two different rows read alike."""
    return F.unhex(F.sha2(F.concat(*[_sized(canonical(C.quote(f.name), f.dataType)) for f in df.schema.fields]), 256))


def _sized(text: Column) -> Column:
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def canonical(value: Column, kind: T.DataType) -> Column:
    """A value as text: equal values alike, different ones apart. NaN is NULL, -0.0 is 0.0, times have microseconds."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), (value + F.lit(0.0).cast(kind))).cast("string")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(value, lambda x: _sized(canonical(x, kind.elementType))), "")
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.concat(F.lit(""), *[_sized(canonical(value[f.name], f.dataType)) for f in kind.fields]))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.concat(
            _sized(canonical(e["key"], kind.keyType)), _sized(canonical(e["value"], kind.valueType))))
        return F.array_join(F.transform(F.array_sort(entries), _sized), "")
    if isinstance(kind, T.VariantType):
        return F.to_json(value)
    return value.cast("string")


def duplicate_summary(groups: DataFrame) -> DataFrame:
    total, extra = F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))
    return groups.agg(total.alias("n_rows"), extra.alias("duplicate_rows")).select(
        "n_rows",
        "duplicate_rows",
        F.round(F.coalesce(F.try_divide(F.lit(100.0) * F.col("duplicate_rows"), F.col("n_rows")), F.lit(0.0)), 4).alias(
            "duplicate_percentage"
        ),
    )


def column_table(df: DataFrame, rsd: float | None = None) -> DataFrame:
    """The column facts every screen builds on: kind, missing and distinct counts, fractions.

    Columns: column, position, storage_type, inferred_type, is_float, n_rows, n_missing, n_observations, n_unique,
    missing_fraction, unique_fraction.
    """
    df = C.normalise_missing(df)
    floats = [f.name for f in df.schema.fields if C.is_float_type(f.dataType)]
    n_rows, n_missing = F.col("n_rows"), F.col("missing_count")
    observed = n_rows - n_missing
    facts = column_types(df).join(F.broadcast(missing_counts(df)), "column")
    facts = facts.join(F.broadcast(distinct_counts(df, rsd=rsd)), "column")
    return facts.select(
        "column",
        "position",
        "storage_type",
        "inferred_type",
        F.col("column").isin(floats).alias("is_float"),
        "n_rows",
        n_missing.alias("n_missing"),
        observed.alias("n_observations"),
        F.col("unique_count").alias("n_unique"),
        "missing_percentage",
        F.round(F.coalesce(F.try_divide(n_missing, n_rows), F.lit(0.0)), 6).alias("missing_fraction"),
        F.round(F.coalesce(F.try_divide(F.col("unique_count"), observed), F.lit(0.0)), 6).alias("unique_fraction"),
    )


def column_statistics(df: DataFrame, column: str) -> DataFrame:
    """Before/after facts of one column: count, missing, unique, and numeric min, max, mean, median."""
    df = C.normalise_missing(df.select(C.quote(column)))
    base = missing_counts(df).join(distinct_counts(df), "column")
    if C.eda_kinds(df)[column] != C.NUMERIC:
        nothing = F.lit(None).cast("double")
        return base.select(
            "column",
            (F.col("n_rows") - F.col("missing_count")).alias("count"),
            "missing_count",
            "unique_count",
            *[nothing.alias(n) for n in ("minimum", "maximum", "mean", "median")],
        )
    stats = numeric_profile(df, [column]).drop("count")
    return base.join(stats, "column", "left").select(
        "column",
        (F.col("n_rows") - F.col("missing_count")).alias("count"),
        "missing_count",
        "unique_count",
        "minimum",
        "maximum",
        "mean",
        "median",
    )


def profile(df: DataFrame) -> DataFrame:
    """Full profile: column facts plus the statistics of each column's kind."""
    df = C.normalise_missing(df)
    facts = column_table(df)
    numeric = C.numeric_columns(df)
    others = [c for c in df.columns if c not in numeric and not C.is_datetime_type(df.schema[c].dataType)]
    dated = [c for c in df.columns if C.is_datetime_type(df.schema[c].dataType)]
    out = facts
    if numeric:
        out = out.join(F.broadcast(numeric_profile(df, numeric)), "column", "left")
    if others:
        out = out.join(F.broadcast(categorical_profile(df, others)), "column", "left")
    if dated:
        ranges = datetime_profile(df, dated).select(
            "column", F.col("minimum").alias("earliest"), F.col("maximum").alias("latest")
        )
        out = out.join(F.broadcast(ranges), "column", "left")
    return out
