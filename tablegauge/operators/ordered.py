"""Exact order statistics without moving a column into one task.

A bare ``Window.orderBy(x)`` or ``percentile`` brings all distinct values of a column to one task. Here a small
quantile sketch gives bucket edges (a bounded list per column on the driver). Edges only steer balance: the
running counts below are exact whatever the edges are. Values are first collapsed to (value, count), so a hot value
is one row; a value that repeats among the sketch quantiles gets a bucket of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tablegauge.functions.columns import unpivot_rows

MIN_BUCKETS = 32
MAX_BUCKETS = 4096


def bucket_count(df: DataFrame) -> int:
    """Number of ranges a column is cut into: follows the cluster's shuffle width, within fixed bounds."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(MIN_BUCKETS, min(MAX_BUCKETS, 4 * width))


def cut_points(quantiles: list[float]) -> list[float]:
    """Strictly increasing edges; a repeated quantile marks a hot value, which is fenced off on both sides."""
    edges: set[float] = set()
    for i, q in enumerate(quantiles):
        if not math.isfinite(q):
            continue
        edges.add(q)
        if i and quantiles[i - 1] == q:
            edges.add(math.nextafter(q, math.inf))
    return [-math.inf, *(sorted(edges) or [0.0]), math.inf]


def hot_values(edges: list[float]) -> list[float]:
    """Values that have a bucket of their own: those the sketch saw in several of its quantiles."""
    return [a for a, b in zip(edges, edges[1:]) if b == math.nextafter(a, math.inf)]


SKETCH_GROUPS = 512


def sketch_edges(df: DataFrame, values: dict[str, Column], buckets: int | None = None) -> dict[str, list[float]]:
    """Bucket edges per column from one pass: map tasks sketch, groups of tasks are merged in parallel, and the merge of
    those at most ``SKETCH_GROUPS`` sketches is all that one task does.

    Sketches are random within their error; edges steer balance only, so that results do not depend on them."""
    buckets = buckets or bucket_count(df)
    names = list(values)
    accuracy = F.lit(min(8 * buckets, 32_768))
    finite = {n: F.when(~F.isnan(values[n].cast("double")), values[n].cast("double")) for n in names}
    grouped = df.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("_group")).agg(
        *[F.kll_sketch_agg_double(finite[n], accuracy).alias(f"s{i}") for i, n in enumerate(names)],
        *[F.count(finite[n]).alias(f"n{i}") for i, n in enumerate(names)])
    merged = grouped.agg(
        *[F.kll_merge_agg_double(F.when(F.col(f"n{i}") > 0, F.col(f"s{i}")), accuracy).alias(f"s{i}") for i in range(len(names))],
        *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(names))])
    ranks = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    row = merged.select(*[
        F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", ranks)).alias(f"e{i}") for i in range(len(names))]).first()
    return {n: cut_points(list(row[i] or [])) for i, n in enumerate(names)}


def assign_buckets(df: DataFrame, columns: dict[str, list[float]], suffix: str = "__bucket") -> DataFrame:
    """Add ``<column><suffix>`` for double columns of ``df``, by binary search over the edges."""
    names = list(columns)
    stage = Bucketizer(
        splitsArray=[columns[n] for n in names],
        inputCols=names,
        outputCols=[n + suffix for n in names],
        handleInvalid="keep",
    )
    return stage.transform(df)


def long_values(
    df: DataFrame,
    values: dict[str, Column],
    keys: dict[str, Column] | None = None,
    edges: dict[str, list[float]] | None = None,
) -> DataFrame:
    """Rows (keys..., column, bucket, x) for every non-null value of every listed column."""
    keys = keys or {}
    edges = edges or sketch_edges(df, values)
    names = list(values)
    inner = {n: f"v{i}" for i, n in enumerate(names)}
    flat = df.select(*[c.alias(k) for k, c in keys.items()], *[values[n].alias(inner[n]) for n in names])
    marked = assign_buckets(flat, {inner[n]: edges[n] for n in names})
    rows = unpivot_rows(
        marked,
        [F.col(k) for k in keys],
        [
            [
                F.lit(n).alias("column"),
                F.col(inner[n] + "__bucket").cast("int").alias("bucket"),
                F.col(inner[n]).alias("x"),
            ]
            for n in names
        ],
    )
    return rows.where(F.col("x").isNotNull() & ~F.isnan("x"))


def running_counts(
    counts: DataFrame, keys: list[str], value: str = "x", bucket: str = "bucket", weight: str = "n"
) -> DataFrame:
    """Add ``below`` (weight at smaller values of the same key) and ``total`` (weight of the key).

    ``counts`` holds one row per (keys, value). Offsets between buckets come from a table of one row per
    (key, bucket); inside a bucket the running sum is an ordinary window.
    """
    per_bucket = counts.groupBy(*keys, bucket).agg(F.sum(weight).alias("__in_bucket"))
    over_key = W.partitionBy(*keys)
    offsets = per_bucket.select(
        *keys,
        bucket,
        F.coalesce(
            F.sum("__in_bucket").over(over_key.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("__before"),
        F.sum("__in_bucket").over(over_key).alias("total"),
    )
    inside = W.partitionBy(*keys, bucket).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ranked = counts.withColumn("__inner", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return (
        ranked.join(offsets, [*keys, bucket])
        .withColumn("below", F.col("__before") + F.col("__inner"))
        .drop("__before", "__inner")
    )


def average_ranks(counts: DataFrame, keys: list[str], weight: str = "n") -> DataFrame:
    """Add ``avg_rank``: the mean of the 1-based positions that equal values share."""
    return running_counts(counts, keys, weight=weight).withColumn(
        "avg_rank", F.col("below") + (F.col(weight) + F.lit(1)) / F.lit(2.0)
    )


def quantiles(
    df: DataFrame,
    values: dict[str, Column],
    probabilities: list[float],
    keys: dict[str, Column] | None = None,
    edges: dict[str, list[float]] | None = None,
    height: Callable[[int, float], float] = lambda total, p: (total - 1) * p,
) -> DataFrame:
    """Exact linear-interpolated quantiles as rows (keys..., column, probability, quantile).

    ``height`` gives the 0-based (fractional) position of a probability among ``total`` values (unkeyed use only).

    Rows are counted per bucket first, which tells the bucket of every wanted position; only rows of those buckets
    are shuffled afterwards, collapsed to (value, count).
    """
    edges = edges or sketch_edges(df, values)
    if keys:
        return _keyed_quantiles(df, values, probabilities, keys, edges)
    rows = long_values(df, values, None, edges)
    histogram = {n: {} for n in values}  # at most columns x buckets numbers
    for r in rows.groupBy("column", "bucket").agg(F.count("*").alias("n")).collect():
        histogram[r["column"]][r["bucket"]] = r["n"]
    targets = []
    for name, counts in histogram.items():
        total = sum(counts.values())
        for p in probabilities if total else []:
            at = height(total, float(p))
            for side, position in (("lo", math.floor(at)), ("hi", math.ceil(at))):
                start = 0
                for bucket in sorted(counts):
                    if position < start + counts[bucket]:
                        targets.append((name, bucket, start, float(p), position, side, float(at - math.floor(at))))
                        break
                    start += counts[bucket]
    wanted = df.sparkSession.createDataFrame(
        targets,
        "column string, bucket int, before long, probability double, position long, side string, fraction double",
    )
    inner = {n: f"v{i}" for i, n in enumerate(values)}
    flat = df.select(*[values[n].alias(inner[n]) for n in values])
    chosen = {}
    for name in values:
        x = F.col(inner[name])
        ranges = sorted({t[1] for t in targets if t[0] == name})
        bucket = F.lit(None).cast("int")
        for b in ranges:  # few literal ranges per column, which also reach the scan as filters
            low, high = edges[name][b], edges[name][b + 1]
            inside = (x >= F.lit(low)) & ((x < F.lit(high)) if high < math.inf else ~F.isnan(x))
            bucket = F.when(inside, F.lit(b)).otherwise(bucket)
        chosen[name] = bucket
    narrowed = unpivot_rows(
        flat, [], [[F.lit(n).alias("column"), chosen[n].alias("bucket"), F.col(inner[n]).alias("x")] for n in values]
    ).where(F.col("bucket").isNotNull())
    return _pick_positions(narrowed, F.broadcast(wanted), ["column"])


def _pick_positions(rows: DataFrame, targets: DataFrame, names: list[str]) -> DataFrame:
    """Values at the wanted positions: running counts inside the chosen buckets only."""
    inside = W.partitionBy(*names, "bucket").orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    candidates = (
        rows.groupBy(*names, "bucket", "x")
        .agg(F.count("*").alias("m"))
        .withColumn("ahead", F.coalesce(F.sum("m").over(inside), F.lit(0)))
    )
    start = F.col("before") + F.col("ahead")
    picks = candidates.join(targets, [*names, "bucket"]).where(
        (F.col("position") >= start) & (F.col("position") < start + F.col("m"))
    )
    ends = picks.groupBy(*names, "probability").agg(
        F.max(F.when(F.col("side") == "lo", F.col("x"))).alias("lo"),
        F.max(F.when(F.col("side") == "hi", F.col("x"))).alias("hi"),
        F.max("fraction").alias("fraction"),
    )
    return ends.select(
        *names,
        "probability",
        F.when(F.col("lo") == F.col("hi"), F.col("lo"))
        .otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("fraction"))
        .alias("quantile"),
    )


def _keyed_quantiles(
    df: DataFrame,
    values: dict[str, Column],
    probabilities: list[float],
    keys: dict[str, Column],
    edges: dict[str, list[float]],
) -> DataFrame:
    """Quantiles per key. The number of keys is unknown, so bucket counts stay distributed."""
    names = [*keys, "column"]
    rows = long_values(df, values, keys, edges)
    over_key = W.partitionBy(*names)
    placed = (
        rows.groupBy(*names, "bucket")
        .agg(F.count("*").alias("n"))
        .select(
            *names,
            "bucket",
            "n",
            F.coalesce(
                F.sum("n").over(over_key.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
            ).alias("before"),
            F.sum("n").over(over_key).alias("total"),
        )
    )
    height = lambda p: (F.col("total") - 1) * F.lit(float(p))
    wanted = unpivot_rows(
        placed,
        [*map(F.col, names), F.col("bucket"), F.col("n"), F.col("before")],
        [
            [
                F.lit(float(p)).alias("probability"),
                position(height(p)).cast("long").alias("position"),
                F.lit(side).alias("side"),
                (height(p) - F.floor(height(p))).alias("fraction"),
            ]
            for p in probabilities
            for side, position in (("lo", F.floor), ("hi", F.ceil))
        ],
    ).where((F.col("position") >= F.col("before")) & (F.col("position") < F.col("before") + F.col("n")))
    buckets = wanted.select(*names, "bucket").distinct()
    return _pick_positions(rows.join(buckets, [*names, "bucket"]), wanted.drop("n"), names)


def quantile_columns(
    df: DataFrame,
    values: dict[str, Column],
    named: dict[str, float],
    keys: dict[str, Column] | None = None,
) -> DataFrame:
    """Quantiles as one row per (keys, column) with a column per name."""
    rows = quantiles(df, values, sorted(set(named.values())), keys)
    return rows.groupBy(*(keys or {}), "column").agg(
        *[F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(n) for n, p in named.items()]
    )


def quantile_values(df: DataFrame, values: dict[str, Column], probabilities: list[float]) -> dict[str, dict[float, float]]:
    """Quantiles on the driver: (columns x probabilities) numbers, for use as literals."""
    out: dict[str, dict[float, float]] = {n: {} for n in values}
    for r in quantiles(df, values, probabilities).collect():
        out[r["column"]][r["probability"]] = r["quantile"]
    return out
