"""Explanations of a fitted model: permutation importance, partial dependence, Shapley values.

Rows are expanded (row x repeat x feature) by explode and scored in one ``transform``. Shuffled values come from a
cyclic shift in a hashed row order, so a permutation is an equi-join on row positions, never a sort in one task.
"""

from __future__ import annotations

import random
from hashlib import md5

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tablegauge.functions import columns as C
from tablegauge.operators import ordered
from tablegauge.operators.splits import UNITS, hash_unit
from tablegauge.session import staged

SEED = 42  # fixed value
REPEATS = 10  # fixed value
GRID = 20  # fixed value
ROUND = 6


def hashed_positions(df: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """Add ``pos``: 0..n-1 in the order of a seeded hash of the key. Hash ranges are even, so tasks are too."""
    ranges = ordered.bucket_count(df)
    marked = df.withColumn("__u", hash_unit(F.col(key), seed))
    marked = marked.withColumn("__b", F.floor(F.col("__u") * ranges / UNITS).cast("int"))
    sizes = marked.groupBy("__b").agg(F.count("*").alias("__n"))
    earlier = W.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    offsets = sizes.select("__b", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"))
    inside = F.row_number().over(W.partitionBy("__b").orderBy("__u", key))
    numbered = marked.withColumn("__rn", inside).join(F.broadcast(offsets), "__b")
    return numbered.withColumn("pos", F.col("__off") + F.col("__rn") - 1).drop("__u", "__b", "__rn", "__off")


def with_donors(df: DataFrame, key: str, repeats: int, seed: int = SEED) -> DataFrame:
    """Every row once per repeat with the feature array of another row (``donor``), a permutation per repeat."""
    arrays = df.select(key, "label", vector_to_array("features").alias("v"))
    placed = staged(hashed_positions(arrays, key, seed), "positions")
    n = placed.count()
    rng = random.Random(seed)
    shifts = [rng.randrange(1, n) if n > 1 else 0 for _ in range(repeats)]
    # a donor travels to the row that takes it, so that all repeats of a row are in one task from then on
    sent = placed.select(
        "pos", "v", F.posexplode(F.array(*[F.lit(s).cast("long") for s in shifts])).alias("repeat", "shift"),
    ).select(F.pmod(F.col("pos") - F.col("shift"), F.lit(max(n, 1))).alias("pos"), F.struct("repeat", F.col("v").alias("donor")).alias("gift"))
    given = sent.groupBy("pos").agg(F.collect_list("gift").alias("gifts"))  # one per repeat
    return placed.select("pos", "label", "v").join(given, "pos").select("pos", "label", "v", F.inline("gifts")).select(
        "pos", "repeat", "label", "v", "donor")


def _scores(rows: DataFrame, keys: list[str], scoring: str) -> DataFrame:
    y, p = F.col("label").cast("double"), F.col("prediction")
    value = {
        "r2": 1.0 - F.avg((y - p) * (y - p)) / F.nullif(F.var_pop(y), F.lit(0.0)),
        "neg_rmse": -F.sqrt(F.avg((y - p) * (y - p))),
        "accuracy": F.avg((y == p).cast("double")),
    }[scoring]
    return rows.groupBy(*keys).agg(value.alias("score"))


def _shifts(n: int, repeats: int, width: int, seed: int) -> list[int]:
    """How far repeat r moves feature f in the hashed order of ``n`` rows, at r * width + f: a permutation each, from a digest."""
    if n < 2:
        return [0] * (repeats * width)
    return [int(md5(f"{r}|{f}|{seed}".encode()).hexdigest()[:8], 16) % (n - 1) + 1 for r in range(repeats) for f in range(width)]


def swapped_rows(df: DataFrame, key: str, width: int, repeats: int, seed: int = SEED) -> DataFrame:
    """(repeat, feature, label, features): every row once per repeat and feature, with that feature's value from another row.

    A value travels alone to each row that takes it: features x repeats numbers are shuffled per row. Whole vectors are put
    together only behind that shuffle, in the task that scores them."""
    placed = staged(hashed_positions(df.select(key, "label", vector_to_array("features").alias("v")), key, seed), "positions")
    n = placed.count()
    shifts = F.array(*[F.lit(s).cast("long") for s in _shifts(n, repeats, width, seed)])
    values = placed.select("pos", F.posexplode("v").alias("feature", "value")).where(F.col("feature") < width)
    moved = values.select("pos", "feature", "value", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")).select(
        F.pmod(F.col("pos") - F.get(shifts, F.col("repeat") * width + F.col("feature")), F.lit(max(n, 1))).alias("pos"),
        F.struct("repeat", "feature", "value").alias("swap"))
    given = moved.groupBy("pos").agg(F.collect_list("swap").alias("swaps"))  # features x repeats of them
    rows = placed.select("pos", "label", "v").join(given, "pos").select("label", "v", F.explode("swaps").alias("swap"))
    own = F.transform("v", lambda x, i: F.when(i == F.col("swap.feature"), F.col("swap.value")).otherwise(x))
    return rows.select("swap.repeat", "swap.feature", "label", array_to_vector(own).alias("features"))


def permutation_importance(model, df: DataFrame, features: list[str], key: str, repeats: int = REPEATS,
                           scoring: str = "r2", seed: int = SEED) -> DataFrame:
    """(rank, feature, importance, std): mean drop of the score when one feature's values change rows. ``key`` is unique."""
    swapped = swapped_rows(df, key, len(features), repeats, seed)
    base = _scores(model.transform(df), [], scoring).select(F.col("score").alias("base"))
    drops = C.attach_row(_scores(model.transform(swapped), ["feature", "repeat"], scoring), base)
    gap = F.col("base") - F.col("score")
    named = F.element_at(F.array(*map(F.lit, features)), F.col("feature") + 1)
    result = drops.groupBy("feature").agg(
        F.round(F.avg(gap), ROUND).alias("importance"), F.round(F.stddev_pop(gap), ROUND).alias("std")
    )
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "position")  # one row per feature
    return result.select(named.alias("feature"), F.col("feature").alias("position"), "importance", "std").select(
        F.row_number().over(order).alias("rank"), "feature", "importance", "std"
    )


def dependence_grid(df: DataFrame, position: int, points: int = GRID) -> list[float]:
    """All values when there are few, else an even grid between the 5 % and 95 % points of the feature."""
    value = F.get(vector_to_array("features"), F.lit(position))
    flat = df.select(value.alias("x"))
    few = flat.groupBy("x").agg(F.count("*").alias("n")).limit(points).collect()  # stops at ``points`` rows
    if len(few) < points:
        return sorted(r["x"] for r in few)
    # positions of the 0.4 / 0.4 plotting rule
    ends = ordered.quantiles(
        flat, {"x": F.col("x")}, [0.05, 0.95],
        height=lambda n, p: min(max(n * p + 0.4 + 0.2 * p, 1.0), float(n)) - 1.0,
    ).collect()
    low, high = sorted(r["quantile"] for r in ends)
    return [low + (high - low) * i / (points - 1) for i in range(points)]


def partial_dependence(model, df: DataFrame, position: int, grid: list[float] | None = None, points: int = GRID,
                       output: Column | None = None) -> DataFrame:
    """(value, mean_prediction): average prediction with one feature set to each grid value for every row."""
    grid = grid if grid is not None else dependence_grid(df, position, points)
    arrays = df.select(vector_to_array("features").alias("v"))
    expanded = arrays.select("v", F.explode(F.array(*map(F.lit, grid))).alias("value")).select(
        "value",
        array_to_vector(F.transform("v", lambda x, i: F.when(i == position, F.col("value")).otherwise(x))).alias("features"),
    )
    scored = model.transform(expanded)
    return scored.groupBy("value").agg(F.avg(output if output is not None else F.col("prediction")).alias("mean_prediction"))


def linear_shapley(model, df: DataFrame, features: list[str]) -> DataFrame:
    """Mean absolute Shapley value per feature of a linear model: coefficient times distance from the mean."""
    weights = [float(c) for c in model.coefficients]
    arrays = df.select(vector_to_array("features").alias("v"))
    means = arrays.agg(*[F.avg(F.get("v", F.lit(i))).alias(f"m{i}") for i in range(len(features))]).first()
    parts = arrays.agg(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.avg(F.abs(F.lit(weights[i]) * (F.get("v", F.lit(i)) - F.lit(means[i])))).alias("mean_abs_shapley"),
            ).alias(f"s{i}")
            for i, f in enumerate(features)
        ]
    )
    return _rank_shapley(parts.select(F.inline(F.array(*[f"s{i}" for i in range(len(features))]))))


def sampled_shapley(model, df: DataFrame, features: list[str], key: str, orders: int = 8, seed: int = SEED) -> DataFrame:
    """Mean absolute Shapley value of any model, by sampled feature orders.

    For each (row, order, prefix length) a row is built whose first features in the order are its own and the others
    a donor's; consecutive predictions differ by one feature's contribution.
    """
    width = len(features)
    rng = random.Random(seed)
    plans = [rng.sample(range(width), width) for _ in range(orders)]
    rows = with_donors(df, key, orders, seed)
    plan = F.element_at(F.array(*[F.array(*map(F.lit, p)) for p in plans]), F.col("repeat") + 1)
    staged = rows.withColumn("plan", plan).select(
        "pos", "repeat", "plan", "v", "donor", F.explode(F.sequence(F.lit(0), F.lit(width))).alias("taken")
    )
    mixed = staged.select(
        "pos", "repeat", "plan", "taken",
        array_to_vector(
            F.transform(
                "v",
                lambda x, i: F.when(F.array_position("plan", i) <= F.col("taken"), x).otherwise(F.get("donor", i)),
            )
        ).alias("features"),
    )
    # a prediction counts for the feature that came last into its row and against the one that comes next: all rows of a
    # position meet in one sum per feature, which each task adds up before the shuffle
    last, following = F.get("plan", F.col("taken") - 1), F.get("plan", F.col("taken"))
    sign = lambda i: F.when(last == i, 1.0).when(following == i, -1.0)
    per_pos = model.transform(mixed).groupBy("pos").agg(*[(F.sum(sign(i) * F.col("prediction")) / orders).alias(f"g{i}") for i in range(width)])
    per_row = C.unpivot_rows(per_pos, [], [[F.lit(i).alias("feature"), F.col(f"g{i}").alias("value")] for i in range(width)])
    named = F.element_at(F.array(*map(F.lit, features)), F.col("feature") + 1)
    mean = per_row.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs_shapley"))
    return _rank_shapley(mean.select(named.alias("feature"), "mean_abs_shapley"))


def _rank_shapley(rows: DataFrame) -> DataFrame:
    order = W.partitionBy(F.lit(0)).orderBy(F.desc("mean_abs_shapley"), "feature")  # one row per feature
    return rows.select(
        F.row_number().over(order).alias("rank"), "feature", F.round("mean_abs_shapley", ROUND).alias("mean_abs_shapley")
    )
