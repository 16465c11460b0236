"""Cleaning: rules that turn findings into operations, the transforms, and gated sequential execution."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablegauge.functions import columns as C, text
from tablegauge.operators import ordered, profile as P, quality as Q
from tablegauge.session import staged

# fixed values: operation names, statuses and rule thresholds
SAFE_IMPUTE_PCT = 5.0
HIGH_MISSING_PCT = 50.0
STATUSES = ["recommended", "review_required", "not_safe_to_automate"]
IMPUTE_NUMBER = "impute_missing_numeric"
IMPUTE_CATEGORY = "impute_missing_categorical"
IMPUTE_DATE = "impute_missing_datetime"
HANDLE_MISSING = "handle_missing_values"
DROP_COLUMN = "drop_high_missing_column"
DEDUPLICATE = "remove_exact_duplicate_rows"
TO_NUMBER = "convert_text_to_numeric"
TO_DATE = "convert_text_to_datetime"
TRIM = "trim_category_whitespace"
STANDARDISE = "standardize_category_formatting"
LOG = "transform_distribution_log"
REVIEW_TRANSFORM = "review_distribution_transform"
REVIEW_OUTLIERS = "review_outliers"
IMBALANCE_ADVICE = "recommend_imbalance_strategy"
ADVICE = [HANDLE_MISSING, IMPUTE_DATE, REVIEW_TRANSFORM, REVIEW_OUTLIERS, IMBALANCE_ADVICE]
NEEDS_FIT = [IMPUTE_NUMBER, IMPUTE_CATEGORY, LOG]
VARIANTS_TYPE = "struct<variant_groups:map<string,array<string>>>"

# fixed values: strftime directives and their Spark patterns
STRFTIME = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss",
    "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%a": "EEE", "%A": "EEEE",
}


# --- planning -----------------------------------------------------------------------------------------------------


def plan(findings: DataFrame, facts: DataFrame) -> DataFrame:
    """Operations for findings. ``facts`` is a column table with ``inferred_type`` and (optional) ``minimum``.

    Columns: operation_id, operation_type, category, status, column, source_finding_id, strategy, parameters,
    affected_rows, affected_percentage, confidence, needs_fit_scope. Ordered by status in ``order_plan``.
    """
    if "minimum" not in facts.columns:
        facts = facts.withColumn("minimum", F.lit(None).cast("double"))
    kinds = facts.select("column", "inferred_type", "minimum")
    rows = findings.join(F.broadcast(kinds), "column", "left")  # one row per column of the table
    kind, pct, observed = F.col("inferred_type"), F.col("affected_percentage"), F.col("observed")
    seen = lambda path: F.get_json_object(observed, "$." + path)

    is_number = kind == C.NUMERIC
    is_category = kind.isin(C.CATEGORICAL, C.BOOLEAN)
    strategy = F.when(is_number, "median").when(is_category, "mode")
    fully = F.coalesce(seen("fully_missing") == "true", F.lit(False))
    ratio = seen("parse_ratio").cast("double")
    looks = seen("looks_like")
    groups = F.from_json(observed, VARIANTS_TYPE)["variant_groups"]
    spacing_only = F.forall(
        F.map_values(groups), lambda v: F.size(F.array_distinct(F.transform(v, text.strip))) == 1
    )
    positive = F.coalesce(F.col("minimum") > 0, F.lit(False))

    def operation(kind_: Column, status: Column, confidence: Column, parameters: Column, strategy_: Column = None) -> Column:
        return F.struct(
            kind_.alias("operation_type"),
            status.alias("status"),
            (strategy_ if strategy_ is not None else F.lit(None)).cast("string").alias("strategy"),
            F.to_json(parameters).alias("parameters"),
            confidence.cast("double").alias("confidence"),
        )

    lit = F.lit
    safe = (pct <= SAFE_IMPUTE_PCT) & strategy.isNotNull()
    impute = operation(
        F.when(is_number, IMPUTE_NUMBER).when(is_category, IMPUTE_CATEGORY).when(kind == C.DATETIME, IMPUTE_DATE)
        .otherwise(HANDLE_MISSING),
        F.when(safe, "recommended").otherwise("review_required"),
        F.when(safe, 0.6).otherwise(0.4),
        F.struct(strategy.alias("strategy"), lit("train_split").alias("fit_on")),
        strategy,
    )
    drop = operation(
        lit(DROP_COLUMN), lit("not_safe_to_automate"), lit(None), F.struct(pct.alias("missing_percentage"))
    )
    none = lit(None).cast(rows.select(impute.alias("o")).schema["o"].dataType)
    finding = F.col("finding_type")
    made = (
        F.when(finding == Q.MISSING, F.array(F.when(~fully, impute).otherwise(none),
                                             F.when(fully | (pct >= HIGH_MISSING_PCT), drop).otherwise(none)))
        .when(
            finding == Q.DUPLICATES,
            F.array(operation(lit(DEDUPLICATE), lit("recommended"), lit(0.85), F.struct(lit("first").alias("keep")))),
        )
        .when(
            (finding == Q.TYPE_MISMATCH) & (looks == "numeric"),
            F.array(operation(
                lit(TO_NUMBER), F.when(ratio >= 1.0, "recommended").otherwise("review_required"), ratio,
                F.struct(ratio.alias("observed_parse_ratio"), lit("abort_and_report").alias("on_unparseable")),
            )),
        )
        .when(
            (finding == Q.TYPE_MISMATCH) & (looks == "datetime"),
            F.array(operation(
                lit(TO_DATE), lit("review_required"), F.col("confidence"),
                F.struct(lit(None).cast("string").alias("format"), lit("report_do_not_coerce").alias("on_unparseable")),
            )),
        )
        .when(
            finding == Q.CATEGORIES,
            F.array(operation(
                F.when(spacing_only, TRIM).otherwise(STANDARDISE),
                F.when(spacing_only, "recommended").otherwise("review_required"),
                F.col("confidence"),
                F.struct(groups.alias("variant_groups"), lit("most_frequent_variant").alias("canonical_choice")),
            )),
        )
        .when(
            finding == Q.SKEW,
            F.array(operation(
                F.when(positive, LOG).otherwise(REVIEW_TRANSFORM), lit("review_required"), F.when(positive, 0.5),
                F.struct(F.col("minimum").alias("observed_minimum"), positive.alias("plain_log_applicable")),
            )),
        )
        .when(
            finding == Q.OUTLIERS,
            F.array(operation(
                lit(REVIEW_OUTLIERS), lit("review_required"), lit(None),
                F.struct(seen("lower_fence").cast("double").alias("lower"), seen("upper_fence").cast("double").alias("upper")),
            )),
        )
        .when(
            finding == Q.IMBALANCE,
            F.array(operation(
                lit(IMBALANCE_ADVICE), lit("review_required"), lit(None),
                F.struct(seen("imbalance_ratio").cast("double").alias("imbalance_ratio")),
            )),
        )
    )
    exploded = rows.select("*", F.explode(made).alias("op")).where(F.col("op").isNotNull())
    op = F.col("op.operation_type")
    return exploded.select(
        F.concat(op, lit(":"), F.coalesce("column", lit("_dataset_"))).alias("operation_id"),
        op.alias("operation_type"),
        F.when(op == REVIEW_OUTLIERS, "investigation")
        .when(op == IMBALANCE_ADVICE, "modeling_recommendation")
        .otherwise("data_transformation")
        .alias("category"),
        F.col("op.status").alias("status"),
        "column",
        F.col("finding_id").alias("source_finding_id"),
        F.col("op.strategy").alias("strategy"),
        F.col("op.parameters").alias("parameters"),
        "affected_rows",
        "affected_percentage",
        F.col("op.confidence").alias("confidence"),
        op.isin(*NEEDS_FIT, HANDLE_MISSING, IMPUTE_DATE, REVIEW_TRANSFORM, IMBALANCE_ADVICE).alias("needs_fit_scope"),
    )


def order_plan(operations: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    return operations.orderBy(rank, "operation_id")


def plan_for(df: DataFrame, target: str | None = None) -> DataFrame:
    """Findings of a table and the operations they call for."""
    numeric = C.numeric_columns(df)
    facts = P.column_types(df)
    if numeric:
        facts = facts.join(F.broadcast(P.numeric_moments(df, numeric).select("column", "minimum")), "column", "left")
    return plan(Q.run_checks(df, target), facts)


def summarise_plan(operations: DataFrame) -> DataFrame:
    return operations.agg(
        F.count("*").alias("total_operations"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES],
        *[
            F.count_if(F.col("category") == c).alias(f"n_{c}")
            for c in ("data_transformation", "investigation", "modeling_recommendation")
        ],
        F.array_join(F.array_sort(F.collect_set("column")), ",").alias("columns_affected"),
        F.count_if((F.col("status") == "recommended") & (F.col("category") == "data_transformation")).alias(
            "auto_applicable_count"
        ),
    )


def plan_counts(operations: DataFrame) -> DataFrame:
    return operations.groupBy("operation_type", "status", "category").agg(F.count("*").alias("n"))


def fingerprint(operations: DataFrame) -> DataFrame:
    """Deterministic id of a plan: SHA-256 over its operations in a fixed order."""
    one = F.to_json(F.struct("operation_id", "status", "parameters"))
    return operations.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(one))), 256).alias("plan_fingerprint"))


# --- transforms (each returns a new lazy DataFrame) ----------------------------------------------------------------


class CleaningRefused(ValueError):
    """A transform whose precondition does not hold; the table is left as it was."""


def fit_rows(df: DataFrame, fit: Column | None) -> DataFrame:
    """Rows statistics may be fitted on: all, or those of the training predicate."""
    return df if fit is None else df.where(fit)


def median_of(df: DataFrame, column: str, fit: Column | None = None) -> float | None:
    scope = fit_rows(df, fit)
    return ordered.quantile_values(scope, {column: C.as_double(df, column)}, [0.5])[column].get(0.5)


def mode_of(df: DataFrame, column: str, fit: Column | None = None) -> str | None:
    """Most frequent value, ties to the smallest text."""
    first = P.value_counts(fit_rows(df, fit), [column]).orderBy(F.desc("n"), "value").limit(1).collect()
    return first[0]["value"] if first else None


def impute_median(df: DataFrame, column: str, fit: Column | None = None) -> DataFrame:
    value = median_of(df, column, fit)
    if value is None:
        raise CleaningRefused(f"{column!r} has no value to take a median of")
    data_type = df.schema[column].dataType
    number = C.as_double(df, column)
    if isinstance(data_type, T.IntegralType) and not float(value).is_integer():
        return df.withColumn(column, F.coalesce(number, F.lit(value)))
    return df.withColumn(column, F.coalesce(number, F.lit(value)).cast(data_type))


def impute_mode(df: DataFrame, column: str, fit: Column | None = None) -> DataFrame:
    value = mode_of(df, column, fit)
    if value is None:
        raise CleaningRefused(f"{column!r} has no value to take a mode of")
    return df.withColumn(column, F.coalesce(C.quote(column), F.lit(value).cast(df.schema[column].dataType)))


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One row of every set of identical rows; NULL equals NULL."""
    return df.dropDuplicates()


def text_to_number(df: DataFrame, column: str) -> DataFrame:
    """All-or-nothing conversion; integers when every value is one."""
    trimmed = F.trim(C.quote(column))
    number = text.parse_number(C.quote(column))
    report = df.agg(
        F.count_if(C.quote(column).isNotNull() & number.isNull()).alias("bad"),
        F.min(F.when(number.isNull(), C.quote(column))).alias("example"),
        (F.count(text.parse_whole(C.quote(column))) == F.count(C.quote(column))).alias("whole"),
    ).first()
    if report["bad"]:
        raise CleaningRefused(f"{column!r}: {report['bad']} values are not numbers, e.g. {report['example']!r}")
    return df.withColumn(column, trimmed.cast("bigint") if report["whole"] else number)


def spark_pattern(strftime: str) -> str:
    """strftime format as a Spark datetime pattern; other letters are quoted."""
    out, i, literal = "", 0, ""
    while i < len(strftime):
        token = strftime[i : i + 2]
        if token in STRFTIME:
            out += (f"'{literal}'" if literal else "") + STRFTIME[token]
            literal, i = "", i + 2
            continue
        if token.startswith("%"):
            raise CleaningRefused(f"date format directive {token!r} is not supported")
        if strftime[i].isalpha():
            literal += strftime[i]
        else:
            out += (f"'{literal}'" if literal else "") + strftime[i]
            literal = ""
        i += 1
    return out + (f"'{literal}'" if literal else "")


def text_to_timestamp(df: DataFrame, column: str, strftime: str | None) -> DataFrame:
    """Conversion with an explicit format only; any value that does not fit stops it."""
    if not strftime:
        raise CleaningRefused(f"{column!r}: no date format given, and formats are never guessed")
    moment = F.try_to_timestamp(F.trim(C.quote(column)), F.lit(spark_pattern(strftime)))
    bad = df.agg(F.count_if(C.quote(column).isNotNull() & moment.isNull()).alias("bad")).first()["bad"]
    if bad:
        raise CleaningRefused(f"{column!r}: {bad} values do not fit the format {strftime!r}")
    return df.withColumn(column, moment)


def trim_whitespace(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, text.collapse(C.quote(column)))


def spelling_map(df: DataFrame, column: str) -> DataFrame:
    """(value, canonical) for spellings that agree after normalisation: the most frequent wins, ties by text.

    Columns with many distinct values yield no rows (see ``quality.category_variants``), so the map is at most 50 rows.
    """
    variants = Q.category_variants(df, [column]).select("normalised", F.explode("variants").alias("value"))
    counted = P.value_counts(df, [column]).join(F.broadcast(variants), "value")
    best = counted.groupBy("normalised").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("canonical")
    )
    return variants.join(best, "normalised").select("value", "canonical")


def standardise_spellings(df: DataFrame, column: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Replace variants by their canonical spelling, or by an explicit mapping; other values are untouched."""
    if mapping is not None:
        pairs = df.sparkSession.createDataFrame(sorted(mapping.items()), "__from string, __to string")
    else:
        pairs = spelling_map(df, column).toDF("__from", "__to")
    joined = df.join(F.broadcast(pairs), C.quote(column) == F.col("__from"), "left")
    return joined.withColumn(column, F.coalesce(F.col("__to"), C.quote(column))).select(*map(C.quote, df.columns))


def log_transform(df: DataFrame, column: str, zeros: bool = False) -> DataFrame:
    """Logarithm of all values, or none: zeros are refused like negative values unless ``zeros`` asks for minus infinity."""
    value = C.as_double(df, column)
    bad = df.agg(F.count_if(value < 0 if zeros else value <= 0).alias("bad")).first()["bad"]
    if bad:
        raise CleaningRefused(f"{column!r}: {bad} values are {'' if zeros else 'zero or '}negative, the logarithm is not defined")
    return df.withColumn(column, C.ln(value))


def drop_column(df: DataFrame, column: str, target: str | None = None) -> DataFrame:
    if column == target:
        raise CleaningRefused(f"{column!r} is the target and is never dropped")
    return df.drop(column)


# --- gated execution ----------------------------------------------------------------------------------------------


@dataclass
class RunOptions:
    """What a run may do: approved operation ids, recommended ones, the training predicate, parameter overrides."""

    approved: set[str] = field(default_factory=set)
    run_recommended: bool = False
    fit: Column | None = None
    allow_full_fit: bool = False
    overrides: dict[str, dict] = field(default_factory=dict)
    target: str | None = None
    cut_lineage: bool = True


LOG_SCHEMA = (
    "step int, operation_id string, operation_type string, column string, status string, reason string, "
    "rows_before long, rows_after long, missing_before long, missing_after long, changed long"
)


def refusal(df: DataFrame, op: dict, options: RunOptions) -> str | None:
    """Why an operation may not run, or None."""
    if op["operation_type"] in ADVICE:
        return "advice only, nothing to transform"
    allowed = op["operation_id"] in options.approved or (options.run_recommended and op["status"] == "recommended")
    if not allowed:
        return "not approved"
    if not op["source_finding_id"]:
        return "no source finding"
    if op["operation_type"] != DEDUPLICATE and op["column"] not in df.columns:
        return f"column {op['column']!r} is not in the table"
    if op["operation_type"] in NEEDS_FIT and options.fit is None and not options.allow_full_fit:
        return "must be fitted on training rows: give a training predicate or allow the full fit"
    return None


FIT = "__fit"


def changed_values(before: DataFrame, column: str, new: Column) -> DataFrame:
    """How many values an expression would change (NULL-safe), in one pass over the column."""
    return before.agg(F.count_if(~C.quote(column).eqNullSafe(new)).alias("changed"))


def spelling_maps(df: DataFrame, columns: list[str]) -> dict[str, dict[str, str]]:
    """``spelling_map`` of many columns at once: at most 50 spellings a column."""
    variants = Q.category_variants(df, columns).select("column", "normalised", F.explode("variants").alias("value"))
    counted = P.value_counts(df, columns).join(F.broadcast(variants), ["column", "value"])
    best = counted.groupBy("column", "normalised").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("canonical"))
    out: dict[str, dict[str, str]] = {c: {} for c in columns}
    for r in variants.join(best, ["column", "normalised"]).collect():
        out[r["column"]][r["value"]] = r["canonical"]
    return out


def waves(operations: list[tuple[int, dict]]) -> list[list[tuple[int, dict]]]:
    """Groups that can run together. Operations on different columns do not see each other, so the n-th operation of every
    column is in the n-th group; row removal sees all columns and is a group of its own between them."""
    out: list[list[tuple[int, dict]]] = []
    first, depth = 0, {}
    for step, op in operations:
        if op["operation_type"] == DEDUPLICATE:
            out.append([(step, op)])
            first, depth = len(out), {}
            continue
        key = op["column"] if op["column"] is not None else op["operation_id"]
        at = first + depth.get(key, 0)
        depth[key] = depth.get(key, 0) + 1
        if at == len(out):
            out.append([])
        out[at].append((step, op))
    return out


def _fitted(df: DataFrame, todo: list[tuple[int, dict]], options: RunOptions) -> dict[int, Column | str | None]:
    """By step: the new column, None where the column is dropped, or as text why the operation cannot run. One job per kind of
    fit, whatever the number of columns."""
    of = lambda *kinds: [(step, op["column"]) for step, op in todo if op["operation_type"] in kinds]
    scope = df.where(FIT) if FIT in df.columns else df
    out: dict[int, Column | str | None] = {}
    numbers, modes = of(IMPUTE_NUMBER), of(IMPUTE_CATEGORY)
    medians = ordered.quantile_values(scope, {c: C.as_double(df, c) for _, c in numbers}, [0.5]) if numbers else {}
    for step, c in numbers:
        value, kind, number = medians[c].get(0.5), df.schema[c].dataType, C.as_double(df, c)
        if value is None:
            out[step] = f"{c!r} has no value to take a median of"
        elif isinstance(kind, T.IntegralType) and not float(value).is_integer():
            out[step] = F.coalesce(number, F.lit(value))
        else:
            out[step] = F.coalesce(number, F.lit(value)).cast(kind)
    usual = {r["column"]: r["value"] for r in P.top_values(scope, [c for _, c in modes], 1).collect()} if modes else {}
    for step, c in modes:
        out[step] = f"{c!r} has no value to take a mode of" if usual.get(c) is None else F.coalesce(C.quote(c), F.lit(usual[c]).cast(df.schema[c].dataType))
    moments: dict[int, Column] = {}
    for step, op in todo:
        if op["operation_type"] == TO_DATE:
            strftime = options.overrides.get(op["operation_id"], {}).get("format")
            try:
                if not strftime:
                    raise CleaningRefused(f"{op['column']!r}: no date format given, and formats are never guessed")
                moments[step] = F.try_to_timestamp(F.trim(C.quote(op["column"])), F.lit(spark_pattern(strftime)))
            except CleaningRefused as stopped:
                out[step] = str(stopped)
    checks = {}
    for step, c in of(TO_NUMBER, TO_DATE, LOG):
        if step in out:
            continue
        value, number = C.quote(c), text.parse_number(C.quote(c)) if (step, c) in of(TO_NUMBER) else None
        if number is not None:
            checks[step] = F.struct(
                F.count_if(value.isNotNull() & number.isNull()).alias("bad"), F.min(F.when(number.isNull(), value)).alias("example"),
                (F.count(text.parse_whole(value)) == F.count(value)).alias("whole"))
        elif step in moments:
            checks[step] = F.struct(F.count_if(value.isNotNull() & moments[step].isNull()).alias("bad"))
        else:
            checks[step] = F.struct(F.count_if(C.as_double(df, c) <= 0).alias("bad"))
    found = df.agg(*[check.alias(f"s{step}") for step, check in checks.items()]).first() if checks else {}
    for step, op in todo:
        kind, c = op["operation_type"], op["column"]
        report = found[f"s{step}"] if step in checks else None
        if kind == TO_NUMBER:
            out[step] = (f"{c!r}: {report['bad']} values are not numbers, e.g. {report['example']!r}" if report["bad"] else
                         F.trim(C.quote(c)).cast("bigint") if report["whole"] else text.parse_number(C.quote(c)))
        elif step in moments:
            strftime = options.overrides[op["operation_id"]]["format"]
            out[step] = f"{c!r}: {report['bad']} values do not fit the format {strftime!r}" if report["bad"] else moments[step]
        elif kind == LOG:
            out[step] = f"{c!r}: {report['bad']} values are zero or negative, the logarithm is not defined" if report["bad"] else F.ln(C.as_double(df, c))
        elif kind == TRIM:
            out[step] = text.collapse(C.quote(c))
        elif kind == DROP_COLUMN:
            out[step] = f"{c!r} is the target and is never dropped" if c == options.target else None
    spellings = [(step, op) for step, op in todo if op["operation_type"] == STANDARDISE]
    given = {step: options.overrides.get(op["operation_id"], {}).get("explicit_mapping") for step, op in spellings}
    unknown = [op["column"] for step, op in spellings if given[step] is None]
    maps = spelling_maps(df, unknown) if unknown else {}
    for step, op in spellings:
        mapping, value = given[step] if given[step] is not None else maps[op["column"]], C.quote(op["column"])
        pairs = F.create_map(*[F.lit(x) for pair in sorted(mapping.items()) for x in pair]) if mapping else None
        out[step] = F.coalesce(F.try_element_at(pairs, value), value) if mapping else value
    return out


def _run_wave(df: DataFrame, wave: list[tuple[int, dict]], options: RunOptions) -> tuple[DataFrame, list[dict]]:
    """Run operations on different columns: fits, then one pass that compares all old and new columns, then the change."""
    log, todo = [], []
    entry = lambda step, op: dict(step=step, operation_id=op["operation_id"], operation_type=op["operation_type"], column=op["column"])
    for step, op in wave:
        if reason := refusal(df, op, options):
            log.append(entry(step, op) | dict(status="skipped", reason=reason))
        else:
            todo.append((step, op))
    made = _fitted(df, todo, options) if todo else {}
    ready = [(step, op) for step, op in todo if not isinstance(made[step], str)]
    log += [entry(step, op) | dict(status="failed", reason=made[step]) for step, op in todo if isinstance(made[step], str)]
    if not ready:
        return df, log
    gaps = lambda c: F.count_if(c.isNull())
    row = df.agg(F.count("*").alias("n"), *[
        F.struct(gaps(C.quote(op["column"])).alias("b"), *([] if made[step] is None else [gaps(made[step]).alias("a")])).alias(f"s{step}")
        for step, op in ready]).first()
    new, gone = {}, []
    for step, op in ready:
        column, kind = op["column"], op["operation_type"]
        before, after = row[f"s{step}"]["b"], None if made[step] is None else row[f"s{step}"]["a"]
        facts = dict(rows_before=row["n"], rows_after=row["n"], missing_before=before, missing_after=after)
        problems = []
        if after is not None and after > before:
            problems.append(f"{column!r} gained {after - before} missing values")
        if after is not None and kind in (IMPUTE_NUMBER, IMPUTE_CATEGORY) and after >= before:
            problems.append(f"imputation left {after} missing values in {column!r}")
        if problems:
            log.append(entry(step, op) | facts | dict(status="rejected", reason="; ".join(problems)))
            continue
        log.append(entry(step, op) | facts | dict(status="executed", reason=None))
        if made[step] is None:
            gone.append(column)
        else:
            new[column] = made[step]
    return (df.withColumns(new) if new else df).drop(*map(C.quote, gone)), log


def run_plan(df: DataFrame, operations: list[dict], options: RunOptions) -> tuple[DataFrame, DataFrame]:
    """Run the allowed operations in order. Returns the cleaned table and the operation log.

    Every operation sees the output of those before it on its column; a refused or failing operation leaves the table as it
    was. Operations on different columns run together (see ``waves``), so the number of passes follows from the longest chain on
    one column, not from the number of columns. The training predicate is read on the rows as they come. Row removal is a
    full shuffle, so its result is written before later passes read it again.
    """
    df = C.normalise_missing(df)
    if options.fit is not None:
        df = df.withColumn(FIT, options.fit)
    log: list[dict] = []
    for wave in waves(list(enumerate(operations, start=1))):
        step, op = wave[0]
        if op["operation_type"] != DEDUPLICATE:
            df, entries = _run_wave(df, wave, options)
            log += entries
            continue
        entry = dict(step=step, operation_id=op["operation_id"], operation_type=op["operation_type"], column=op["column"])
        if reason := refusal(df, op, options):
            log.append(entry | dict(status="skipped", reason=reason))
            continue
        groups = P.duplicate_rows(df).first()
        log.append(entry | dict(rows_before=groups["n_rows"], rows_after=groups["n_rows"] - groups["duplicate_rows"],
                                changed=groups["duplicate_rows"], status="executed", reason=None))
        df = drop_duplicate_rows(df)
        if options.cut_lineage:
            df = staged(df, "deduplicated")
    names = [part.split()[0] for part in LOG_SCHEMA.split(", ")]
    rows = [tuple(e.get(n) for n in names) for e in sorted(log, key=lambda e: e["step"])]
    return df.drop(FIT), df.sparkSession.createDataFrame(rows, LOG_SCHEMA)


def operation_rows(operations: DataFrame) -> list[dict]:
    """The plan as driver rows: at most a few operations per column."""
    return [r.asDict() for r in order_plan(operations).collect()]


def execution_id(operations: list[dict], options: RunOptions) -> str:
    import hashlib

    allowed = sorted(
        o["operation_id"]
        for o in operations
        if o["operation_id"] in options.approved or (options.run_recommended and o["status"] == "recommended")
    )
    return hashlib.sha256(json.dumps([allowed, options.overrides], sort_keys=True).encode()).hexdigest()[:16]
