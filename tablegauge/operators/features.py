"""Feature inventory, structural selection, transform choice, calendar, lag and rolling features, preprocessing."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, RobustScaler, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tablegauge.functions import columns as C, moments
from tablegauge.operators import explore as X, ordered, profile as P, quality as Q
from tablegauge.operators.screens import identifier_like

# fixed values: limits of the feature rules
HIGH_MISSING = 0.8
LOW_VARIETY = 2
HIGH_CARDINALITY = 50
REDUNDANT = 0.95
MIN_CORRELATION_ROWS = 3
SKEW, STRONG_SKEW = 1.0, 2.0
RANGE_RATIO = 1000.0
SCALE_FROM = 1000.0
SYMMETRY = 0.1
LAGS = (1, 2, 3, 7, 14)
WINDOWS = (7, 30)
MIN_TEMPORAL_ROWS = 50
TEMPORAL_MARGIN = 10
MAX_ONE_HOT = 30
ROBUST_FROM = 0.05
CALENDAR_PARTS = ("year", "month", "day", "day_of_week", "day_of_year", "quarter")
# fixed values: part -> (period, offset) of the cyclical pair
CYCLES = {"month": (12, 1), "day_of_week": (7, 0), "hour": (24, 0)}


# --- inventory and selection --------------------------------------------------------------------------------------


def inventory(facts: DataFrame, target: str | None = None) -> DataFrame:
    """Every column with its role: candidate, or excluded and why."""
    reason = (
        F.when(F.col("column") == F.lit(target), "target")
        .when(F.col("n_observations") == 0, "all_missing")
        .when(F.col("n_unique") <= 1, "constant")
        .when(identifier_like(), "identifier_like")
    )
    return facts.select(
        "column", "inferred_type", "n_unique", "missing_fraction", "unique_fraction",
        reason.isNull().alias("candidate"), reason.alias("excluded_because"),
    )


def column_fingerprints(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, kind, nulls, digest): equal digests are necessary for equal columns. One pass, no shuffle of rows.

    The row's own hash salts each value, so equal multisets in another order differ.
    """
    views = {c: _comparable(df, c) for c in columns}
    row = F.xxhash64(*[C.as_text(df, c) for c in df.columns])
    return C.stack_rows(
        df.agg(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.lit(_value_class(df, c)).alias("value_class"),
                    F.count_if(views[c].isNull()).alias("nulls"),
                    F.sum(F.xxhash64(views[c], row).cast("decimal(38,0)")).cast("string").alias("digest"),
                ).alias(f"s{i}")
                for i, c in enumerate(columns)
            ]
        )
    )


def _value_class(df: DataFrame, column: str) -> str:
    data_type = df.schema[column].dataType
    if C.is_numeric_type(data_type) or data_type.simpleString() == "boolean":
        return "number"
    return "time" if C.is_datetime_type(data_type) else "text"


def _comparable(df: DataFrame, column: str) -> Column:
    """Values as compared for duplication: numbers as double (non-finite as NULL), times as seconds, else text."""
    kind = _value_class(df, column)
    if kind == "number":
        return C.finite(C.as_double(df, column)) + F.lit(0.0)
    return C.epoch_seconds(df, column) if kind == "time" else C.as_text(df, column)


def duplicate_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, duplicate_of): equal row by row to a column earlier by name.

    Fingerprints (a few bytes per column) propose the groups; every proposed pair is then verified on the rows.
    """
    columns = sorted(columns or df.columns)
    groups: dict[tuple, list[str]] = {}
    for r in column_fingerprints(df, columns).collect():
        groups.setdefault((r["value_class"], r["nulls"], r["digest"]), []).append(r["column"])
    proposed = [(c, sorted(g)[0]) for g in groups.values() for c in sorted(g)[1:]]
    schema = "column string, duplicate_of string"
    if not proposed:
        return df.sparkSession.createDataFrame([], schema)
    checked = df.agg(
        *[
            F.count_if(~_comparable(df, a).eqNullSafe(_comparable(df, b))).alias(f"p{i}")
            for i, (a, b) in enumerate(proposed)
        ]
    ).first()
    rows = [p for i, p in enumerate(proposed) if checked[f"p{i}"] == 0]
    return df.sparkSession.createDataFrame(sorted(rows), schema)


def redundant_pairs(df: DataFrame, columns: list[str], threshold: float = REDUNDANT) -> DataFrame:
    """(column, anchor, correlation): by name order, the first of strongly correlated columns is the anchor.

    Correlations come from one aggregate; the walk over names runs on that pair table.
    """
    columns = sorted(columns)
    strength = {
        (r["column_a"], r["column_b"]): r["correlation"]
        for r in X.pair_correlations(df, X.name_pairs(columns, None)).collect()
        if r["correlation"] is not None and r["n"] >= MIN_CORRELATION_ROWS
    } if len(columns) > 1 else {}
    anchors, rows = [], []
    for c in columns:
        match = next((a for a in anchors if abs(strength.get((a, c), 0.0)) >= threshold), None)
        if match is None:
            anchors.append(c)
        else:
            rows.append((c, match, strength[match, c]))
    return df.sparkSession.createDataFrame(rows, "column string, anchor string, correlation double")


def select_features(df: DataFrame, target: str | None = None, facts: DataFrame | None = None) -> DataFrame:
    """(column, action, reason, related): retain, review or drop, from structure alone."""
    facts = C.settle(facts if facts is not None else P.column_table(df))
    stock = inventory(facts, target).where("candidate")
    names = [r["column"] for r in stock.select("column").collect()]
    duplicates = duplicate_columns(df.select(*map(C.quote, names)), names) if len(names) > 1 else None
    kind, distinct = F.col("inferred_type"), F.col("n_unique")
    rows = stock
    if duplicates is not None:
        rows = rows.join(F.broadcast(duplicates), "column", "left")
    else:
        rows = rows.withColumn("duplicate_of", F.lit(None).cast("string"))
    action = (
        F.when(F.col("duplicate_of").isNotNull(), F.struct(F.lit("drop").alias("action"), F.lit("duplicate").alias("reason"), F.col("duplicate_of").alias("related")))
        .when(F.col("missing_fraction") >= HIGH_MISSING, _verdict("review", "high_missingness"))
        .when((kind == C.NUMERIC) & (distinct <= LOW_VARIETY), _verdict("review", "low_variety"))
        .when((kind == C.CATEGORICAL) & (distinct >= HIGH_CARDINALITY), _verdict("review", "high_cardinality"))
    )
    decided = C.settle(rows.select("column", "inferred_type", action.alias("verdict")))
    open_numbers = [
        r["column"] for r in decided.where(F.col("verdict").isNull() & (F.col("inferred_type") == C.NUMERIC)).collect()
    ]
    redundant = redundant_pairs(df, open_numbers)
    final = decided.join(F.broadcast(redundant), "column", "left").select(
        "column",
        F.coalesce(
            "verdict",
            F.when(F.col("anchor").isNotNull(), F.struct(F.lit("review").alias("action"), F.lit("redundant").alias("reason"), F.col("anchor").alias("related"))),
            _verdict("retain", "no_structural_reason"),
        ).alias("v"),
    )
    return final.select("column", "v.action", "v.reason", "v.related")


def _verdict(action: str, reason: str) -> Column:
    return F.struct(
        F.lit(action).alias("action"), F.lit(reason).alias("reason"), F.lit(None).cast("string").alias("related")
    )


# --- transforms ---------------------------------------------------------------------------------------------------


def transform_choices(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, operation) rows: at most one reshaping transform, then abs and scale, from one aggregate."""
    columns = columns or C.numeric_columns(df)
    facts = C.stack_rows(
        df.agg(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.count(v).alias("n"),
                    F.min(v).alias("low"),
                    F.max(v).alias("high"),
                    F.avg(v).alias("mean"),
                    F.stddev_pop(v).alias("sd"),
                    moments.adjusted_skewness(v).alias("skew"),
                    (F.count_if(v == 0) > 0).alias("has_zero"),
                ).alias(f"s{i}")
                for i, (c, v) in enumerate((c, C.finite(C.as_double(df, c))) for c in columns)
            ]
        )
    )
    low, high, skew = F.col("low"), F.col("high"), F.col("skew")
    strong = F.coalesce(skew >= STRONG_SKEW, F.lit(False))
    reshape = (
        F.when((low > 0) & ((high / F.nullif(low, F.lit(0.0)) >= RANGE_RATIO) | strong), "log")
        .when((high < 0) & F.coalesce(F.abs(skew) >= STRONG_SKEW, F.lit(False)), "reciprocal")
        .when((low <= 0) & (low > -1) & (F.col("has_zero") | (low < 0)) & strong, "log1p")
        .when((low >= 0) & (skew >= SKEW) & (skew < STRONG_SKEW), "sqrt")
    )
    symmetric = (low < 0) & (high > 0) & (F.col("sd") > 0) & (F.abs("mean") <= F.lit(SYMMETRY) * F.col("sd"))
    large = F.greatest(F.abs(low), F.abs(high)) > SCALE_FROM
    listed = F.array(
        reshape, F.when(symmetric, F.lit("abs")), F.when(reshape.isNull() & large, F.lit("scale"))
    )
    return facts.where(F.col("n") >= 2).select("column", F.explode(F.array_compact(listed)).alias("operation"))


def apply_transforms(df: DataFrame, choices: list[tuple[str, str]]) -> DataFrame:
    """Add ``<column>__<operation>`` for every reshaping choice; ``scale`` is left to the fitted scaler. Where a function has a pole
    the result is infinite, outside its domain it is null."""
    shapes = {
        "log": C.ln,
        "log1p": lambda v: F.when(v == -1, F.lit(float("-inf"))).otherwise(F.log1p(v)),
        "sqrt": F.sqrt,
        "abs": F.abs,
        # by IEEE rules: infinite for 0, with its sign
        "reciprocal": lambda v: F.when(v == 0, F.pow(v, F.lit(-1.0))).otherwise(F.lit(1.0) / F.nullif(v, F.lit(0.0))),
    }
    return df.withColumns(
        {f"{c}__{op}": shapes[op](C.as_double(df, c)) for c, op in choices if op in shapes}
    )


def calendar_choices(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, part, cyclical): parts to derive; the hour only when some value has a time of day."""
    with_time = [
        F.struct(
            F.lit(c).alias("column"),
            F.coalesce(
                F.max((F.hour(m) != 0) | (F.minute(m) != 0) | (F.second(m) != 0)), F.lit(False)
            ).alias("timed"),
            F.count(m).alias("n"),
        ).alias(f"s{i}")
        for i, (c, m) in enumerate((c, C.quote(c)) for c in columns)
    ]
    parts = F.array(
        *[F.struct(F.lit(p).alias("part"), F.lit(p in CYCLES).alias("cyclical")) for p in (*CALENDAR_PARTS, "hour")]
    )
    rows = C.stack_rows(df.agg(*with_time)).where(F.col("n") > 0)
    return rows.select("column", "timed", F.inline(parts)).where((F.col("part") != "hour") | F.col("timed")).drop("timed")


def calendar_part(value: Column, part: str) -> Column:
    parts = {
        "year": F.year, "month": F.month, "day": F.dayofmonth, "day_of_week": F.weekday,
        "day_of_year": F.dayofyear, "quarter": F.quarter, "hour": F.hour,
    }
    return parts[part](value).cast("double")


def calendar_features(df: DataFrame, column: str, parts: list[str], cyclical: list[str] = ()) -> DataFrame:
    """Add ``<column>__<part>`` and, for cyclical parts, ``_sin`` / ``_cos`` pairs."""
    out = {}
    for p in parts:
        value = calendar_part(C.quote(column), p)
        out[f"{column}__{p}"] = value
        if p in cyclical:
            period, offset = CYCLES[p]
            angle = (value - F.lit(float(offset))) * F.lit(2.0 * math.pi / period)
            out[f"{column}__{p}_sin"], out[f"{column}__{p}_cos"] = F.sin(angle), F.cos(angle)
    return df.withColumns(out)


# --- lags and rolling windows -------------------------------------------------------------------------------------


def lag_plan(df: DataFrame, target: str, time: str, exogenous: list[str] = (), wide_lags: bool = False) -> DataFrame:
    """(column, feature, size) rows worth building: enough rows for each order or window."""
    n = df.count()
    rows: list[tuple[str, str, int]] = []
    if n >= MIN_TEMPORAL_ROWS:
        if target != time:
            rows += [(target, "lag", k) for k in LAGS if n > k + TEMPORAL_MARGIN]
            rows += [(target, f"rolling_{s}", w) for w in WINDOWS for s in ("mean", "std") if n > w + TEMPORAL_MARGIN]
        orders = LAGS if wide_lags else (1,)
        rows += [(c, "lag", k) for c in sorted(exogenous) if c not in (target, time) for k in orders
                 if n > k + TEMPORAL_MARGIN]
    return df.sparkSession.createDataFrame(rows, "column string, feature string, size int")


def temporal_columns(column: str, lags: tuple[int, ...], windows: tuple[int, ...], window: W) -> dict[str, Column]:
    """Lag and rolling expressions over a window ordered by time; the current row is never part of a window."""
    out = {f"{column}__lag_{k}": F.lag(C.quote(column), k).over(window) for k in lags}
    for w in windows:
        past = window.rowsBetween(-w, -1)
        full = F.count(C.quote(column)).over(past) == w
        out[f"{column}__rolling_mean_{w}"] = F.when(full, F.avg(C.quote(column)).over(past))
        out[f"{column}__rolling_std_{w}"] = F.when(full, F.stddev_samp(C.quote(column)).over(past))
    return out


def temporal_features(df: DataFrame, column: str, time: str, series: list[str], lags: tuple[int, ...] = LAGS,
                      windows: tuple[int, ...] = WINDOWS, tie: str | None = None) -> DataFrame:
    """Lag and rolling features per series. One shuffle by series key serves all of them.

    For a table that is a single long series, or a few very long ones, use ``temporal_features_sliced``.
    """
    order = [C.quote(time)] + ([C.quote(tie)] if tie else [])
    window = W.partitionBy(*map(C.quote, series)).orderBy(*order)
    return df.withColumns(temporal_columns(column, lags, windows, window))


def series_positions(df: DataFrame, time: str, series: list[str] = (), tie: str | None = None,
                     slices: int | None = None, name: str = "__pos") -> DataFrame:
    """Add each row's 0-based position in time within its series, without sorting a whole series in one task.

    The time axis is cut into slices by a sketch; positions are the rows in earlier slices (a small table) plus the
    row number inside the slice. ``tie`` orders equal times and makes the result repeatable.
    """
    edges = ordered.sketch_edges(df, {"t": C.as_number(df, time)}, slices or ordered.bucket_count(df))["t"]
    cut = ordered.assign_buckets(df.withColumn("__t", C.as_number(df, time)), {"__t": edges}, "_slice")
    cut = cut.where(F.col("__t").isNotNull()).withColumn("__slice", F.col("__t_slice").cast("int")).drop("__t_slice", "__t")
    keys = [C.quote(k) for k in series]
    sizes = cut.groupBy(*keys, "__slice").agg(F.count("*").alias("__n"))
    earlier = W.partitionBy(*(keys or [F.lit(0)])).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__slice", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    order = [C.quote(time)] + ([C.quote(tie)] if tie else [])
    inside = F.row_number().over(W.partitionBy(*keys, F.col("__slice")).orderBy(*order))
    joined = cut.withColumn("__rn", inside).join(offsets, [*series, "__slice"])
    return joined.withColumn(name, F.col("__offset") + F.col("__rn") - 1).drop("__offset", "__rn", "__slice")


def temporal_features_sliced(df: DataFrame, column: str, time: str, series: list[str] = (), lags: tuple[int, ...] = LAGS,
                             windows: tuple[int, ...] = WINDOWS, tie: str | None = None,
                             block_rows: int = 1_000_000) -> DataFrame:
    """The same features for series too long for one task.

    Rows are numbered in time and grouped into blocks of at least the longest reach ``h``; the last ``h`` rows of a
    block are copied to the next one, so every window is answered inside one block.
    """
    reach = max([*lags, *windows])
    size = max(block_rows, reach)
    placed = series_positions(df, time, series, tie).withColumn("__block", F.floor(F.col("__pos") / size))
    homes = F.when(F.col("__pos") % size >= size - reach, F.array("__block", F.col("__block") + 1)).otherwise(
        F.array("__block")
    )
    both = placed.withColumn("__home", F.explode(homes))
    window = W.partitionBy(*[C.quote(k) for k in series], F.col("__home")).orderBy("__pos")
    built = both.withColumns(temporal_columns(column, lags, windows, window))
    return built.where(F.col("__home") == F.col("__block")).select(
        *map(C.quote, df.columns), *temporal_columns(column, lags, windows, window)
    )


# --- preprocessing ------------------------------------------------------------------------------------------------


def requirements(df: DataFrame, target: str | None = None, facts: DataFrame | None = None) -> DataFrame:
    """(column, operation): impute when anything is missing, encode categories, scale where the scale rule says so."""
    facts = C.settle(facts if facts is not None else P.column_table(df))
    kept = C.settle(select_features(df, target, facts).where("action <> 'drop'").select("column"))
    rows = inventory(facts, target).join(F.broadcast(kept), "column", "left_semi")
    numbers = [r["column"] for r in rows.where(F.col("inferred_type") == C.NUMERIC).select("column").collect()]
    scaled = transform_choices(df, numbers).where("operation = 'scale'") if numbers else None
    impute = rows.where(F.col("missing_fraction") > 0).select("column", F.lit("imputation").alias("operation"))
    encode = rows.where(F.col("inferred_type") == C.CATEGORICAL).select("column", F.lit("encoding").alias("operation"))
    out = impute.unionByName(encode)
    return out.unionByName(scaled.select("column", F.lit("scaling").alias("operation"))) if scaled is not None else out


def outlier_share(df: DataFrame, columns: list[str]) -> float:
    """Pooled share of values outside the IQR fences, over columns with a non-zero spread."""
    fences = Q.outlier_fences(df, columns).where(F.col("q3") != F.col("q1"))
    total = fences.agg(F.sum("outlier_count").alias("o"), F.sum("n_values").alias("n")).first()
    return (total["o"] or 0) / total["n"] if total["n"] else 0.0


def log_target(df: DataFrame, target: str) -> DataFrame:
    """Whether a regression target is fitted on the log scale: biased skew over 1 and no negative value."""
    y = C.as_double(df, target)
    facts = df.agg(F.skewness(y).alias("skew"), F.min(y).alias("low"))
    return facts.select(
        F.lit(target).alias("target"), "skew", "low",
        F.coalesce((F.col("skew") > 1.0) & (F.col("low") >= 0), F.lit(False)).alias("use_log"),
    )


def _literal(text: str) -> str:
    """The text as a SQL literal that needs no escapes."""
    return f"CAST(X'{text.encode().hex()}' AS STRING)"


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


class Preprocessor:
    """Fills, groups rare categories, encodes, assembles and scales; everything is fitted on the training rows.

    The fitted facts are small (a median and a top-30 list per column). All of them are in the stages of one ``PipelineModel``
    (``model``), the fills and groups as a SQL stage, so that saving it saves the preprocessing whole.
    """

    def __init__(self, numeric: list[str], categorical: list[str], max_categories: int = MAX_ONE_HOT,
                 robust: bool | None = None, output: str = "features"):
        self.numeric, self.categorical, self.output = list(numeric), list(categorical), output
        self.max_categories, self.robust = max_categories, robust
        self.medians: dict[str, float] = {}
        self.top: dict[str, list[str]] = {}
        self.model: PipelineModel | None = None

    def fit(self, train: DataFrame) -> "Preprocessor":
        train = C.normalise_missing(train)
        if self.numeric:
            found = ordered.quantile_values(train, {c: C.as_double(train, c) for c in self.numeric}, [0.5])
            self.medians = {c: found[c].get(0.5, 0.0) for c in self.numeric}
        if self.categorical:
            for r in P.top_values(train, self.categorical, self.max_categories).orderBy("position").collect():
                self.top.setdefault(r["column"], []).append(r["value"])
        if self.robust is None:
            self.robust = bool(self.numeric) and outlier_share(train, self.numeric) > ROBUST_FROM
        stages = [self._fill_stage(train)]
        cats = range(len([c for c in self.categorical if self.top.get(c)]))
        if cats:
            stages += [
                StringIndexer(inputCols=[f"__c{i}" for i in cats], outputCols=[f"__i{i}" for i in cats],
                              handleInvalid="keep", stringOrderType="alphabetAsc"),
                OneHotEncoder(inputCols=[f"__i{i}" for i in cats], outputCols=[f"__h{i}" for i in cats],
                              dropLast=False, handleInvalid="keep"),
            ]
        parts = []
        if self.numeric:
            stages.append(VectorAssembler(inputCols=[f"__n{i}" for i in range(len(self.numeric))], outputCol="__numbers"))
            scaler = RobustScaler if self.robust else StandardScaler
            stages.append(scaler(inputCol="__numbers", outputCol="__scaled", withCentering=True)
                          if self.robust else scaler(inputCol="__numbers", outputCol="__scaled", withMean=True))
            parts.append("__scaled")
        parts += [f"__h{i}" for i in cats]
        stages.append(VectorAssembler(inputCols=parts, outputCol=self.output))
        self.model = Pipeline(stages=stages).fit(train)
        return self

    def _fill_stage(self, train: DataFrame) -> SQLTransformer:
        """Filled numbers and grouped categories as extra columns; unseen or rare values become NULL, then 'keep'."""
        extra = []
        for i, c in enumerate(self.numeric):
            value = f"NULLIF(CAST({_name(c)} AS DOUBLE), CAST('NaN' AS DOUBLE))"
            extra.append(f"COALESCE({value}, CAST('{self.medians[c]!r}' AS DOUBLE)) AS __n{i}")
        for i, (c, labels) in enumerate((c, self.top[c]) for c in self.categorical if self.top.get(c)):
            kind = train.schema[c].dataType
            value = f"TO_JSON({_name(c)})" if C.is_nested_type(kind) else f"CAST({_name(c)} AS STRING)"
            if C.is_float_type(kind) and kind.typeName() != "decimal":
                value = f"CAST(NULLIF({_name(c)}, CAST('NaN' AS DOUBLE)) + CAST(0 AS {kind.typeName()}) AS STRING)"
            value, known = f"COALESCE({value}, {_literal(labels[0])})", ", ".join(map(_literal, labels))
            extra.append(f"CASE WHEN {value} IN ({known}) THEN {value} END AS __c{i}")
        return SQLTransformer(statement=", ".join(["SELECT *", *extra]) + " FROM __THIS__")

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(C.normalise_missing(df))
        return out.select(*map(C.quote, df.columns), self.output)
