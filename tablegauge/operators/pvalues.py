"""Multiple-testing correction inside families of p-values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

METHODS = ("bonferroni", "holm", "benjamini_hochberg")


def adjust(tests: DataFrame, p: str = "p_value", family: str | None = None, method: str = "holm",
           alpha: float = 0.05, order: str | None = None) -> DataFrame:
    """Add ``adjusted_p`` and ``significant``. NULL p-values stay NULL and do not count.

    A family is the set of tests of one report (pairs of columns), so a window over it is bounded by the report, not
    by the data.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, got {method!r}")
    keyed = tests.withColumn("__family", F.col(family) if family else F.lit("all"))
    present = keyed.where(F.col(p).isNotNull())
    absent = keyed.where(F.col(p).isNull())
    whole = W.partitionBy("__family")
    tie = [F.col(order)] if order else []
    ranked = present.withColumn("__m", F.count("*").over(whole)).withColumn(
        "__rank", F.row_number().over(whole.orderBy(F.col(p), *tie))
    )
    m, rank = F.col("__m"), F.col("__rank")
    if method == "bonferroni":
        raw = F.col(p) * m
    elif method == "holm":
        stepped = F.col(p) * (m - rank + 1)
        raw = F.max(stepped).over(whole.orderBy("__rank").rowsBetween(W.unboundedPreceding, 0))
    else:
        stepped = F.col(p) * m / rank
        raw = F.min(stepped).over(whole.orderBy(F.desc("__rank")).rowsBetween(W.unboundedPreceding, 0))
    adjusted = ranked.withColumn("adjusted_p", F.least(F.lit(1.0), raw)).drop("__m", "__rank")
    both = adjusted.unionByName(absent.withColumn("adjusted_p", F.lit(None).cast("double")))
    return both.withColumn("significant", F.col("adjusted_p") < F.lit(alpha)).drop("__family")
