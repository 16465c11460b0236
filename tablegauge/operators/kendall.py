"""Kendall tau-b without comparing all pairs of rows.

Rows are collapsed to distinct (x, y) with counts and placed on a grid of x ranges by y ranges. The sign sum over all
pairs splits into three exact parts:

* pairs in different x ranges and different y ranges: running sums over the grid counts;
* pairs in the same x range: counted inside each x range;
* pairs in the same y range but different x ranges: counted inside each y range.

A range is a bounded slice of the column; a hot value is a range of its own, and equal values never form a
concordant or discordant pair, so such ranges are skipped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from tablegauge.functions import columns as C, tails
from tablegauge.operators import ordered
from tablegauge.operators.hypothesis import ALPHA, _status, with_p_value
from tablegauge.operators.ranktests import MIN_PAIRS, _pair_rows

RANGE_ROWS = 2_000_000  # rows one range should hold, which bounds the memory of a block
MAX_RANGES = 16_384  # the grid has at most the square of this many cells


def signed_pairs(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Sum of n_i n_j sign(x_i - x_j) sign(y_i - y_j) over unordered pairs, by splitting on the bits of the y rank."""
    _, rank = np.unique(y, return_inverse=True)
    _, x = np.unique(x, return_inverse=True)
    order = np.argsort(x, kind="stable")
    rank, x, n = rank[order], x[order], n[order].astype(float)
    total = 0.0
    for bit in range(int(rank.max(initial=0)).bit_length()):
        group = rank >> (bit + 1)
        at = np.argsort(group, kind="stable")  # keeps x order inside a group
        g, xs, w = group[at], x[at], n[at]
        upper = ((rank[at] >> bit) & 1).astype(bool)
        low = np.concatenate([[0.0], np.cumsum(np.where(upper, 0.0, w))])
        run_start = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (xs[1:] != xs[:-1])])
        run_end = np.r_[run_start[1:], len(g)]
        run_of = np.repeat(np.arange(len(run_start)), run_end - run_start)
        group_start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        group_end = np.r_[group_start[1:], len(g)]
        group_of = np.repeat(np.arange(len(group_start)), group_end - group_start)
        before = low[run_start[run_of]] - low[group_start[group_of]]
        after = low[group_end[group_of]] - low[run_end[run_of]]
        total += float(np.sum(np.where(upper, w * (before - after), 0.0)))
    return total


def _block_sum(block: pd.DataFrame) -> pd.DataFrame:
    value = signed_pairs(block["x"].to_numpy(), block["y"].to_numpy(), block["n"].to_numpy())
    return pd.DataFrame({"pair": [block["pair"].iloc[0]], "s": [value]})


def kendall(df: DataFrame, a: str, b: str) -> DataFrame:
    """tau-b with its tie terms: (column_a, column_b, n, status, statistic, s, ...)."""
    return kendall_pairs(df, [(a, b)])


def kendall_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``kendall`` of many pairs of columns; the steps, and so the jobs, are the same for one pair and for all."""
    buckets = max(ordered.bucket_count(df), min(MAX_RANGES, df.count() // RANGE_ROWS))
    rows, edges = _pair_rows(df, pairs, buckets)

    # ranges that hold a single value are all ties on that axis
    def open_ranges(value: str, bucket: str) -> DataFrame:
        span = rows.groupBy("pair", bucket).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        return F.broadcast(span.where(F.col("lo") < F.col("hi")).select("pair", bucket))  # at most one row per bucket and pair

    in_x = rows.join(open_ranges("x", "bx"), ["pair", "bx"], "left_semi").select("pair", "bx", "x", "y", "n")
    in_y = (
        rows.join(open_ranges("y", "by"), ["pair", "by"], "left_semi")
        .groupBy("pair", "by", F.col("bx").cast("double").alias("x"), "y")
        .agg(F.sum("n").alias("n"))
    )
    same_x = in_x.groupBy("pair", "bx").applyInPandas(_block_sum, "pair int, s double")
    same_y = in_y.groupBy("pair", "by").applyInPandas(_block_sum, "pair int, s double")

    # grid: for each cell, weight strictly left and below minus strictly left and above
    grid = rows.groupBy("pair", "bx", "by").agg(F.sum("n").cast("double").alias("n"))
    sizes = df.sparkSession.createDataFrame(
        [(i, len(edges[a]) - 2, len(edges[b]) - 2) for i, (a, b) in enumerate(pairs)], "pair int, last_x int, last_y int")
    cells = sizes.select("pair", "last_y", F.explode(F.sequence(F.lit(0), "last_x")).alias("bx")).select(
        "pair", "bx", F.explode(F.sequence(F.lit(0), "last_y")).alias("by"))
    full = cells.join(grid, ["pair", "bx", "by"], "left").select("pair", "bx", "by", F.coalesce("n", F.lit(0.0)).alias("n"))
    row = W.partitionBy("pair", "by").orderBy("bx").rowsBetween(W.unboundedPreceding, -1)
    left = full.withColumn("left", F.coalesce(F.sum("n").over(row), F.lit(0.0)))
    column = W.partitionBy("pair", "bx").orderBy("by")
    crossed = left.select(
        "pair",
        (
            F.col("n")
            * (
                F.coalesce(F.sum("left").over(column.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
                - F.coalesce(F.sum("left").over(column.rowsBetween(1, W.unboundedFollowing)), F.lit(0.0))
            )
        ).alias("s"),
    )
    signed = same_x.unionByName(same_y).unionByName(crossed).groupBy("pair").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"))

    def ties(value: str, suffix: str) -> DataFrame:
        t = F.col("n").cast("double")
        return (
            rows.groupBy("pair", value)
            .agg(F.sum("n").alias("n"))
            .groupBy("pair")
            .agg(
                F.sum(t).alias(f"n_{suffix}"),
                F.sum(t * (t - 1) / 2).alias(f"t_{suffix}"),
                F.sum(t * (t - 1) * (t - 2)).alias(f"t3_{suffix}"),
                F.sum(t * (t - 1) * (2 * t + 5)).alias(f"v_{suffix}"),
            )
        )

    # tables of one row per pair
    names = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, column_a string, column_b string")
    one = names.join(signed, "pair", "left").join(ties("x", "x"), "pair", "left").join(ties("y", "y"), "pair", "left")
    n = F.coalesce("n_x", F.lit(0.0))
    possible = n * (n - 1) / 2
    ok = (n >= MIN_PAIRS) & (F.col("t_x") < possible) & (F.col("t_y") < possible)
    tau = F.col("s") / F.nullif(F.sqrt((possible - F.col("t_x")) * (possible - F.col("t_y"))), F.lit(0.0))
    return one.select(
        "column_a",
        "column_b",
        n.cast("long").alias("n"),
        _status(ok).alias("status"),
        F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), tau))).alias("statistic"),
        "s",
        *[f"{p}_{side}" for p in ("t", "t3", "v") for side in ("x", "y")],
    )


def kendall_test(df: DataFrame, a: str, b: str, alpha: float = ALPHA) -> DataFrame:
    """Normal approximation with tie-corrected variance."""
    return kendall_tests(df, [(a, b)], alpha)


def kendall_tests(df: DataFrame, pairs: list[tuple[str, str]], alpha: float = ALPHA) -> DataFrame:
    n = F.col("n").cast("double")
    base = (n * (n - 1) * (2 * n + 5) - F.col("v_x") - F.col("v_y")) / 18.0
    second = 2.0 * F.col("t_x") * F.col("t_y") / (n * (n - 1))
    third = F.col("t3_x") * F.col("t3_y") / F.nullif(9.0 * n * (n - 1) * (n - 2), F.lit(0.0))
    z = F.col("s") / F.nullif(F.sqrt(base + second + F.coalesce(third, F.lit(0.0))), F.lit(0.0))
    result = kendall_pairs(df, pairs).withColumn("z", z)
    return with_p_value(result, tails.normal_p_value(F.col("z")), alpha).withColumn(
        "method", F.lit("normal approximation")
    )
