"""Column kinds read from the schema, and small column expressions shared by every operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC = "numeric"
CATEGORICAL = "categorical"
DATETIME = "datetime"
BOOLEAN = "boolean"
UNKNOWN = "unknown"


def quote(name: str) -> Column:
    """Reference a column whose name may hold dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric_type(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_float_type(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType))


def is_datetime_type(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_nested_type(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def eda_kind(data_type: T.DataType) -> str:
    """Kind by storage type alone; text is never sniffed here."""
    if is_datetime_type(data_type):
        return DATETIME
    if isinstance(data_type, T.BooleanType):
        return CATEGORICAL
    if is_numeric_type(data_type):
        return NUMERIC
    if is_nested_type(data_type) or isinstance(data_type, T.NullType):
        return UNKNOWN
    return CATEGORICAL


def eda_kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: eda_kind(f.dataType) for f in df.schema.fields}


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    return [name for name, k in eda_kinds(df).items() if k == kind]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of_kind(df, NUMERIC)


def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN, NULL and absent are one thing in reports, so NaN becomes NULL at the door."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(quote(c)), quote(c)) for c in floats}) if floats else df


def as_double(df: DataFrame, name: str) -> Column:
    """Numeric or boolean column as double, NaN read as NULL."""
    value = quote(name).cast("double")
    return F.when(~F.isnan(value), value) if is_float_type(df.schema[name].dataType) else value


def finite(value: Column) -> Column:
    """Keep finite numbers, turn everything else into NULL (so aggregates skip it)."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def epoch_seconds(df: DataFrame, name: str) -> Column:
    """Timestamp as seconds since 1970 in UTC, independent of the session time zone."""
    data_type = df.schema[name].dataType
    if isinstance(data_type, T.DateType):
        return F.datediff(quote(name), F.lit("1970-01-01").cast("date")).cast("double") * F.lit(86400.0)
    if isinstance(data_type, T.TimestampNTZType):
        micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), quote(name))
        return micros.cast("double") / F.lit(1e6)
    return F.unix_micros(quote(name)).cast("double") / F.lit(1e6)


def as_number(df: DataFrame, name: str) -> Column:
    """Double view of a numeric, boolean or datetime column."""
    return epoch_seconds(df, name) if is_datetime_type(df.schema[name].dataType) else as_double(df, name)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def complete(*columns: Column) -> Column:
    return all_of([c.isNotNull() for c in columns])


def as_text(df: DataFrame, name: str) -> Column:
    """Value as text for counting; -0.0 and 0.0 are one value."""
    value = quote(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        value = F.when(~F.isnan(value), value + F.lit(0.0))
    if is_nested_type(df.schema[name].dataType):
        return F.to_json(value)
    return value.cast("string")


def present(df: DataFrame, name: str) -> Column:
    """Whether a value is there, without turning it into text."""
    data_type = df.schema[name].dataType
    value = quote(name)
    return value.isNotNull() & ~F.isnan(value) if isinstance(data_type, (T.FloatType, T.DoubleType)) else value.isNotNull()


def ln(value: Column) -> Column:
    """Natural logarithm of doubles, minus infinity for 0; Spark alone has null there."""
    return F.when(value == 0, F.lit(float("-inf"))).otherwise(F.ln(value))


def signed_round(value: Column, digits: int) -> Column:
    """Rounding that keeps the sign of a negative value that becomes zero, as SQL's does; Spark's gives 0.0 there."""
    near = F.round(value, digits)
    return F.when((near == 0) & (value < 0), F.lit(-0.0)).otherwise(near)


def round_scaled(value: Column, digits: int) -> Column:
    """Rounding as SQL does it: the product with a power of ten, halves away from zero, with the sign of a zero. Spark's rounds the
    shortest decimal text of a double, which falls on the other side of some halves."""
    scale = F.lit(10.0**digits)
    size = F.abs(value) * scale
    whole = F.floor(size).cast("double")
    near = F.signum(value) * (whole + F.when(size - whole >= 0.5, 1.0).otherwise(0.0)) / scale
    return F.when(size < 2.0**52, near).when(size < float("inf"), value * scale / scale).otherwise(value)


def unpivot_rows(df: DataFrame, keys: list[Column], parts: list[list[Column]]) -> DataFrame:
    """One output row per part: every part is a list of equally named and typed columns."""
    return df.select(*keys, F.inline(F.array(*[F.struct(*p) for p in parts])))


def stack_rows(rows: DataFrame) -> DataFrame:
    """Turn one row of equal structs into one row per struct (for wide aggregates)."""
    return rows.select(F.inline(F.array(*[quote(c) for c in rows.columns])))


def attach_row(rows: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row table (numbers, texts, short arrays) as literals; no join, no shuffle.

    Without a row there is nothing to attach and the result is empty.
    """
    found = one.first()
    types = {f.name: f.dataType for f in one.schema.fields}
    if found is None:
        return rows.withColumns({n: F.lit(None).cast(t) for n, t in types.items()}).where(F.lit(False))
    return rows.withColumns({n: F.lit(found[n]).cast(t) for n, t in types.items()})


def settle(rows: DataFrame) -> DataFrame:
    """Compute a report-sized table (rows per column or pair, never per data row) once and hand it on as literal rows,
    so that later joins do not scan the data again."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)
