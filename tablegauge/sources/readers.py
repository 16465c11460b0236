"""Sources: CSV with typed rejects, format dispatch, and missing-value tokens."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablegauge.functions import columns as C, text

# fixed values: texts read as missing in CSV files
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]
FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "json", ".parquet": "parquet", ".orc": "orc"}
CORRUPT = "_corrupt_record"


class IngestionError(ValueError):
    reason = "ingestion_error"


class MissingSource(IngestionError):
    reason = "missing"


class WrongFormat(IngestionError):
    reason = "wrong_format"


class InvalidCsv(IngestionError):
    reason = "invalid_csv"


def detect_format(path: str) -> str:
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in FORMATS:
        raise WrongFormat(f"cannot tell the format of {path!r}; known suffixes: {sorted(FORMATS)}")
    return FORMATS[suffix]


def read_dataset(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read by suffix or by an explicit format name."""
    fmt = fmt or detect_format(path)
    try:
        return read_csv(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path)
    except Exception as error:  # the analyzer names the cause; only the class of the error is decided here
        if "PATH_NOT_FOUND" in str(error):
            raise MissingSource(f"no such file or folder: {path!r}") from error
        raise


def _raw_csv(spark: SparkSession, path: str, multiline: bool, keep_corrupt: bool) -> DataFrame:
    """All columns as text, with rows that do not fit the header marked."""
    options = dict(header=True, multiLine=multiline, escape='"', enforceSchema=False)
    try:
        names = spark.read.options(**options).csv(path).columns
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise MissingSource(f"no such file or folder: {path!r}") from error
        raise InvalidCsv(f"{path!r} cannot be read as CSV: {error}") from error
    if not names:
        raise InvalidCsv(f"{path!r} has no header")
    fields = [T.StructField(n, T.StringType()) for n in names] + [T.StructField(CORRUPT, T.StringType())]
    # every field is parsed whatever columns a query reads, or short and long rows would pass unnoticed
    options |= dict(enforceSchema=True, columnPruning=False)
    raw = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT).schema(
        T.StructType(fields)
    ).csv(path)
    return raw if keep_corrupt else raw.drop(CORRUPT)


def csv_rejects(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Rows that do not fit the header: (record, reason)."""
    raw = _raw_csv(spark, path, multiline, keep_corrupt=True)
    width = len(raw.columns) - 1
    bare = F.regexp_replace(CORRUPT, '"(?:[^"]|"")*"', "")  # a comma inside quotes is no separator
    separators = F.length(bare) - F.length(F.translate(bare, ",", ""))
    first = C.quote(raw.columns[0])
    reason = F.when(first.isNull(), "no_fields").when(separators >= width, "too_many_fields").otherwise("too_few_fields")
    return raw.where(F.col(CORRUPT).isNotNull()).select(
        F.col(CORRUPT).alias("record"), reason.alias("reason"), first.alias("first_field")
    )


def reject_report(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return csv_rejects(spark, path, multiline).groupBy("reason").agg(
        F.count("*").alias("rejected")
    )


def nullify_tokens(df: DataFrame, tokens: list[str] = MISSING_TOKENS) -> DataFrame:
    """Missing-value texts become NULL in every text column."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~C.quote(c).isin(tokens), C.quote(c)) for c in texts})


def infer_text_types(df: DataFrame) -> DataFrame:
    """Give text columns the narrowest type all their values fit (bigint, double, boolean), from one aggregate."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    trimmed = {c: F.trim(C.quote(c)) for c in texts}
    facts = df.agg(
        *[
            F.struct(
                F.count(C.quote(c)).alias("n"),
                F.count(text.parse_whole(C.quote(c))).alias("whole"),
                F.count(text.parse_number(C.quote(c))).alias("number"),
                F.count_if(F.lower(trimmed[c]).isin("true", "false")).alias("flag"),
            ).alias(f"s{i}")
            for i, c in enumerate(texts)
        ]
    ).first()
    changes = {}
    for i, c in enumerate(texts):
        f = facts[i]
        if f["n"] == 0:
            continue
        if f["flag"] == f["n"]:
            changes[c] = F.lower(trimmed[c]).cast("boolean")
        elif f["whole"] == f["n"]:
            changes[c] = trimmed[c].cast("bigint")
        elif f["number"] == f["n"]:
            changes[c] = trimmed[c].cast("double")
    return df.withColumns(changes) if changes else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, multiline: bool = False,
             strict: bool = True) -> DataFrame:
    """CSV with header. With a schema it is read in one pass; otherwise types are inferred from the values.

    ``strict`` refuses a file with rows that do not fit the header; else such rows are kept as far as they go.
    """
    if not path.rstrip("/").lower().endswith(".csv") and os.path.splitext(path)[1]:
        raise WrongFormat(f"{path!r} is not a CSV file")
    if schema is not None:
        mode = "FAILFAST" if strict else "PERMISSIVE"
        return spark.read.options(header=True, mode=mode, multiLine=multiline, escape='"').schema(schema).csv(path)
    raw = _raw_csv(spark, path, multiline, keep_corrupt=True)
    if strict:
        first = C.quote(raw.columns[0])
        check = raw.agg(F.count_if(F.col(CORRUPT).isNotNull()).alias("bad"), F.count(first).alias("n")).first()
        if check["bad"]:
            raise InvalidCsv(f"{path!r}: {check['bad']} rows do not fit the header; see csv_rejects")
    return C.normalise_missing(infer_text_types(nullify_tokens(raw.drop(CORRUPT))))
