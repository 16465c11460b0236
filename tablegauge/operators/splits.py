"""Split plans and reproducible holdouts. Membership follows from a row key, never from row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tablegauge.functions import columns as C
from tablegauge.operators import ordered, profile as P, screens as S

# fixed values: shares and size limits of the split rules
SEED = 42
SHARES = (0.7, 0.15, 0.15)
SMALL_SHARES = (0.8, 0.0, 0.2)
MIN_ROWS_FOR_VALIDATION = 200
MIN_CLASS = 2
UNITS = 10_000


def split_plan(df: DataFrame, task: str, target: str | None = None) -> DataFrame:
    """One row: strategy, shares, stratify, keep time order."""
    n = F.count("*").alias("n_rows")
    if task in (S.BINARY, S.MULTICLASS) and target:
        counts = P.value_counts(df, [target]).agg(F.count("*").alias("k"), F.min("n").alias("smallest"))
        facts = C.attach_row(df.agg(n), counts)
        stratify = (F.col("k") >= 2) & (F.col("smallest") >= MIN_CLASS)
    else:
        facts, stratify = df.agg(n), F.lit(False)
    small = F.col("n_rows") < MIN_ROWS_FOR_VALIDATION
    share = lambda i: F.when(small, F.lit(SMALL_SHARES[i])).otherwise(F.lit(SHARES[i]))
    ordered_in_time = task == S.FORECASTING
    strategy = F.lit("time_ordered_holdout") if ordered_in_time else F.when(stratify, "stratified_holdout").otherwise(
        "random_holdout"
    )
    return facts.select(
        strategy.alias("strategy"),
        share(0).alias("train_fraction"),
        share(1).alias("validation_fraction"),
        share(2).alias("test_fraction"),
        F.coalesce(stratify, F.lit(False)).alias("stratify"),
        F.lit(ordered_in_time).alias("keep_time_order"),
    )


def hash_unit(key: Column, seed: int = SEED) -> Column:
    """0..9999 from the MD5 of key and seed: the same on any cluster size and in any engine."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % UNITS


def _label(position: Column, total: Column | float, shares: tuple[float, float, float]) -> Column:
    train, validation, _ = shares
    return (
        F.when(position < F.lit(train) * total, "train")
        .when(position < F.lit(train + validation) * total, "validation")
        .otherwise("test")
    )


def random_holdout(df: DataFrame, key: str, shares: tuple[float, float, float] = SHARES, seed: int = SEED) -> DataFrame:
    """Add ``split`` from the row key's hash; no shuffle."""
    unit = hash_unit(C.quote(key), seed)
    return df.withColumn("split", _label(unit, F.lit(float(UNITS)), shares))


def stratified_holdout(df: DataFrame, key: str, target: str, shares: tuple[float, float, float] = SHARES,
                       seed: int = SEED, exact: bool = False) -> DataFrame:
    """Add ``split`` with the shares held inside every class.

    By default each class is split by hash (expected shares, no shuffle). ``exact`` gives every class its exact share:
    rows are numbered inside (class, hash range) and offset by the rows of lower ranges, so a class with most of the
    rows is still spread over many tasks.
    """
    if not exact:
        unit = hash_unit(F.concat_ws("|", C.as_text(df, target), C.quote(key).cast("string")), seed)
        return df.withColumn("split", _label(unit, F.lit(float(UNITS)), shares))
    unit = hash_unit(C.quote(key), seed)
    ranges = ordered.bucket_count(df)
    marked = df.withColumns({"__unit": unit, "__range": F.floor(unit * ranges / UNITS)})
    sizes = marked.groupBy(C.quote(target), "__range").agg(F.count("*").alias("__n"))
    over = W.partitionBy(C.quote(target))
    offsets = sizes.select(
        C.quote(target).alias("__class"),
        F.col("__range").alias("__r"),
        F.coalesce(F.sum("__n").over(over.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
        F.sum("__n").over(over).alias("__size"),
    )
    inside = W.partitionBy(C.quote(target), F.col("__range")).orderBy("__unit", C.quote(key))
    numbered = marked.withColumn("__rn", F.row_number().over(inside) - 1)
    joined = numbered.join(
        offsets, C.quote(target).eqNullSafe(F.col("__class")) & (F.col("__range") == F.col("__r"))
    )
    position = F.col("__off") + F.col("__rn")
    return joined.withColumn("split", _label(position, F.col("__size").cast("double"), shares)).select(
        *map(C.quote, df.columns), "split"
    )


def time_holdout(df: DataFrame, time: str, shares: tuple[float, float, float] = SHARES) -> DataFrame:
    """Add ``split`` by time: rows up to the exact time of the share's last row are train, and so on.

    Cut times are two numbers found by exact ranks; rows of one time never straddle a cut.
    """
    seconds = C.as_number(df, time)
    train, validation, _ = shares
    cuts = ordered.quantiles(
        df, {"t": seconds}, [train, train + validation], height=lambda total, p: max(0, int(total * p + 1e-9) - 1)
    )
    found = {round(r["probability"], 9): r["quantile"] for r in cuts.collect()}
    first, second = found[round(train, 9)], found[round(train + validation, 9)]
    return df.withColumn(
        "split", F.when(seconds <= F.lit(first), "train").when(seconds <= F.lit(second), "validation").otherwise("test")
    )


def chronology(df: DataFrame, time: str, series: list[str] = ()) -> DataFrame:
    """What sorting by time relies on: parseable and distinct times, and repeated times per series."""
    moment = C.quote(time)
    if not C.is_datetime_type(df.schema[time].dataType):
        moment = P.parse_datetime(moment)
    stamped = df.select(*[C.quote(k) for k in series], C.quote(time).alias("__raw"), moment.alias("__t"))
    per_time = stamped.groupBy(*series, "__t").agg(
        F.count("*").alias("n"), F.count("__raw").alias("present"), F.count("__t").alias("parsed")
    )
    distinct = per_time.groupBy("__t").agg(
        F.sum("n").alias("n"), F.sum("present").alias("present"), F.sum("parsed").alias("parsed"),
        F.sum(F.when(F.col("__t").isNotNull(), F.col("n") - 1).otherwise(0)).alias("repeated"),
    )
    one = distinct.agg(
        F.sum("n").alias("n_rows"),
        (F.sum("present") - F.sum("parsed")).alias("unparseable"),
        F.count("__t").alias("distinct_times"),
        F.sum("repeated").alias("repeated_times"),
    )
    ok = (F.col("unparseable") == 0) & (F.col("distinct_times") >= 2)
    return one.withColumn("usable", ok)


def hash_fold(df: DataFrame, key: str, folds: int = 5, seed: int = SEED, stratify: str | None = None) -> DataFrame:
    """Add integer ``fold`` for cross validation from the row key's hash (inside each class when stratified)."""
    source = F.concat_ws("|", C.as_text(df, stratify), C.quote(key).cast("string")) if stratify else C.quote(key)
    return df.withColumn("fold", (hash_unit(source, seed + 1) % folds).cast("int"))
