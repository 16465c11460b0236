"""Rank-based tests on distributed average ranks.

Rows are collapsed to (value, group or pair, count) first, so equal rows travel once. Ranks come from
``ordered.average_ranks``; no step sorts a column in one task. P-values use the tie-corrected normal, t or
chi-square approximations (``method`` says which).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tablegauge.functions import columns as C, tails
from tablegauge.operators import explore, ordered
from tablegauge.operators.hypothesis import ALPHA, _status, with_p_value
from tablegauge.session import staged

MIN_PAIRS = 3  # fixed value
MIN_GROUP = 2  # fixed value
#: Distinct values of a column up to which its ranks go to every task (16 bytes each).
FEW_VALUES = 10_000
#: Rows of one part when ranks are joined to them, and parts beyond which map tasks would hold their rows in memory to sort them.
RANKED_ROWS, RANKED_PARTS = 500_000, 200
BATTERY_SCHEMA = "test string, column_a string, column_b string, n long, status string, statistic double, p_value double"


def _pair_rows(
    df: DataFrame, pairs: list[tuple[str, str]], buckets: int | None = None
) -> tuple[DataFrame, dict[str, list[float]]]:
    """Distinct complete (pair, x, y) with counts and bucket numbers of both sides."""
    names = sorted({c for p in pairs for c in p})
    values = {c: C.as_double(df, c) for c in names}
    edges = ordered.sketch_edges(df, values, buckets)
    inner = {c: f"v{i}" for i, c in enumerate(names)}
    flat = ordered.assign_buckets(
        df.select(*[values[c].alias(inner[c]) for c in names]), {inner[c]: edges[c] for c in names}
    )
    rows = C.unpivot_rows(
        flat,
        [],
        [
            [
                F.lit(i).alias("pair"),
                F.col(inner[a]).alias("x"),
                F.col(inner[a] + "__bucket").cast("int").alias("bx"),
                F.col(inner[b]).alias("y"),
                F.col(inner[b] + "__bucket").cast("int").alias("by"),
            ]
            for i, (a, b) in enumerate(pairs)
        ],
    ).where(C.complete(F.col("x"), F.col("y")))
    return rows.groupBy("pair", "bx", "x", "by", "y").agg(F.count("*").alias("n")), edges


def _side_ranks(rows: DataFrame, value: str, bucket: str, rank: str) -> DataFrame:
    counts = rows.groupBy("pair", F.col(bucket).alias("bucket"), F.col(value).alias("x")).agg(F.sum("n").alias("n"))
    return ordered.average_ranks(counts, ["pair"]).select(
        "pair", F.col("x").alias(value), F.col("avg_rank").alias(rank)
    )


def _attach_rank(rows: DataFrame, ranks: DataFrame, value: str, rank: str, hot: Column, spread: int) -> DataFrame:
    """Join ranks to rows by value. Rows of hot values are spread over ``spread`` keys; their rank (one row per value)
    is repeated for each."""
    other = "y" if value == "x" else "x"
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    salted = ranks.select("pair", value, rank, F.explode(salts).alias("__salt"))
    salt = F.when(hot, F.pmod(F.xxhash64(other), F.lit(spread))).otherwise(F.lit(0)).cast("int")
    return rows.withColumn("__salt", salt).join(salted, ["pair", value, "__salt"]).drop("__salt")


def _is_hot(pairs: list[tuple[str, str]], edges: dict[str, list[float]], side: int, value: str) -> Column:
    out = F.lit(False)
    for i, pair in enumerate(pairs):
        values = ordered.hot_values(edges[pair[side]])
        if values:
            out = out | ((F.col("pair") == i) & F.col(value).isin(values))
    return out


def spearman(df: DataFrame, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Spearman rho: Pearson correlation of the average ranks over complete pairs.

    Ranks of a column without gaps are the same in every pair: those columns are ranked once, all together, and the sums of
    all their pairs are one aggregate. Pairs with a gap on either side are ranked over their own complete rows."""
    pairs = pairs if pairs is not None else explore.name_pairs(C.numeric_columns(df))
    names = sorted({c for p in pairs for c in p})
    if not names:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, n long, status string, statistic double")
    gaps = df.agg(F.count("*").alias("n"), *[F.count(C.as_double(df, c)).alias(f"c{i}") for i, c in enumerate(names)]).first()
    whole = {c for i, c in enumerate(names) if gaps[f"c{i}"] == gaps["n"]}
    shared = [p for p in pairs if whole.issuperset(p)]
    if len({c for p in shared for c in p}) < 3:  # with one pair nothing is shared
        shared = []
    own = [p for p in pairs if p not in shared]
    parts = [_name_pairs(sums, some) for sums, some in (
        (_shared_sums(df, shared), shared) if shared else (None, []), (_own_sums(df, own), own) if own else (None, [])) if some]
    joined = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    ok = (F.col("n") >= MIN_PAIRS) & (F.col("var_x") > 0) & (F.col("var_y") > 0)
    rho = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cov") / F.sqrt(F.col("var_x") * F.col("var_y"))))
    return joined.select("column_a", "column_b", "n", _status(ok).alias("status"), F.when(ok, rho).alias("statistic"))


def _own_sums(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(pair, n, cov, var_x, var_y) of pairs that are ranked each over their complete rows."""
    rows, edges = _pair_rows(df, pairs)
    spread = ordered.bucket_count(df)
    ranked = rows
    for side, (value, bucket, rank) in enumerate((("x", "bx", "rx"), ("y", "by", "ry"))):
        ranks = _side_ranks(rows, value, bucket, rank)
        ranked = _attach_rank(ranked, ranks, value, rank, _is_hot(pairs, edges, side, value), spread)
    weighted = lambda v: F.sum(F.col("n") * v) / F.sum("n")
    middle = (F.sum("n") + 1) / F.lit(2.0)  # the mean rank is (N + 1) / 2 on both sides
    rx, ry = F.col("rx"), F.col("ry")
    varies = lambda c: F.min(c) < F.max(c)
    return ranked.groupBy("pair").agg(
        F.sum("n").alias("n"),
        (weighted(rx * ry) - middle * middle).alias("cov"),
        F.when(varies("x"), weighted(rx * rx) - middle * middle).alias("var_x"),
        F.when(varies("y"), weighted(ry * ry) - middle * middle).alias("var_y"),
    )


def rank_rows(df: DataFrame, names: list[str]) -> DataFrame:
    """Average ranks ``r0, r1, ...`` of the columns, row by row; the rank of a missing value is null.

    All columns go through one ranking. Ranks of a column with few distinct values are attached to the rows where they are; a
    column with many takes one shuffle of the rows, over as many parts as their number asks for. Rows of hot values, which the sketch
    tells, take their rank from a small table instead."""
    values = {c: C.as_double(df, c) for c in names}
    copy = staged(df.select(*[values[c].alias(f"v{i}") for i, c in enumerate(names)]), "ranked-values")
    copied = {c: F.col(f"v{i}") for i, c in enumerate(names)}
    edges = ordered.sketch_edges(copy, copied)
    rows = ordered.long_values(copy, copied, None, edges)
    number = F.array_position(F.array(*map(F.lit, names)), F.col("column")).cast("int") - 1
    counts = rows.groupBy(number.alias("i"), "bucket", "x").agg(F.count("*").alias("n"))
    ranks = staged(ordered.average_ranks(counts, ["i"]).select("i", "x", "avg_rank"), "ranks")
    distinct = {r["i"]: r["n"] for r in ranks.groupBy("i").agg(F.count("*").alias("n")).collect()}  # one row per column
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = max(width, min(RANKED_PARTS, math.ceil(copy.count() / RANKED_ROWS)))
    out = copy.withColumn("__row", F.monotonically_increasing_id())
    # columns with few values first: they need no shuffle
    for i in sorted(range(len(names)), key=lambda i: (distinct.get(i, 0) > FEW_VALUES, i)):
        own = ranks.where(F.col("i") == i).select("x", F.col("avg_rank").alias(f"r{i}"))
        if distinct.get(i, 0) <= FEW_VALUES:
            out = out.join(F.broadcast(own.withColumnRenamed("x", f"v{i}")), f"v{i}", "left").drop(f"v{i}")
            continue
        hot = own.where(F.col("x").isin(ordered.hot_values(edges[names[i]])))  # less than a bucket each
        out = out.join(F.broadcast(hot.select(F.col("x").alias(f"v{i}"), F.col(f"r{i}").alias("__hot"))), f"v{i}", "left")
        spread = F.col("__hot").isNotNull() | F.col(f"v{i}").isNull()
        out = out.withColumns({"__x": F.when(~spread, F.col(f"v{i}")), "__salt": F.when(spread, F.col("__row")).otherwise(0)})
        cold = own.select(F.col("x").alias("__x"), F.col(f"r{i}").alias("__cold"), F.lit(0).cast("bigint").alias("__salt"))
        out = out.drop(f"v{i}").repartition(parts, "__x", "__salt").join(cold.repartition(parts, "__x", "__salt"), ["__x", "__salt"], "left")
        out = out.withColumn(f"r{i}", F.coalesce("__hot", "__cold")).drop("__x", "__salt", "__hot", "__cold")
    return out.select(*[f"r{i}" for i in range(len(names))])


def _shared_sums(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(pair, n, cov, var_x, var_y) of columns without gaps, from one table of ranks and one aggregate."""
    names = sorted({c for p in pairs for c in p})
    of = {c: f"r{i}" for i, c in enumerate(names)}
    middle = (F.count("*") + 1) / F.lit(2.0)
    spread = lambda a, b: F.avg(F.col(of[a]) * F.col(of[b])) - middle * middle
    varies = lambda c: F.min(of[c]) < F.max(of[c])
    return C.stack_rows(rank_rows(df, names).agg(*[
        F.struct(F.lit(i).alias("pair"), F.count("*").alias("n"), spread(a, b).alias("cov"), F.when(varies(a), spread(a, a)).alias("var_x"),
                 F.when(varies(b), spread(b, b)).alias("var_y")).alias(f"p{i}")
        for i, (a, b) in enumerate(pairs)]))


def _name_pairs(rows: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    names = rows.sparkSession.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, column_a string, column_b string"
    )
    return rows.join(F.broadcast(names), "pair")


def spearman_test(df: DataFrame, pairs: list[tuple[str, str]] | None = None, alpha: float = ALPHA) -> DataFrame:
    rho, n = F.col("statistic"), F.col("n")
    t = rho * F.sqrt((n - 2) / F.nullif(1.0 - rho * rho, F.lit(0.0)))
    p = F.when(F.abs(rho) == 1.0, F.lit(0.0)).otherwise(tails.t_p_value(t, (n - 2).cast("double")))
    return with_p_value(spearman(df, pairs), p, alpha).withColumn("method", F.lit("t approximation"))


def _label_counts(df: DataFrame, combos: list[tuple[str, str]]) -> DataFrame:
    """(combo, label, bucket, x, n): rows of every combination of a category and a number, collapsed to distinct values."""
    numbers, categories = sorted({n for _, n in combos}), sorted({c for c, _ in combos})
    values = {c: C.as_double(df, c) for c in numbers}
    edges = ordered.sketch_edges(df, values)
    inner, label = {c: f"v{i}" for i, c in enumerate(numbers)}, {c: f"l{i}" for i, c in enumerate(categories)}
    flat = df.select(*[values[c].alias(inner[c]) for c in numbers], *[C.as_text(df, c).alias(label[c]) for c in categories])
    marked = ordered.assign_buckets(flat, {inner[c]: edges[c] for c in numbers})
    rows = C.unpivot_rows(marked, [], [
        [F.lit(i).alias("combo"), F.col(label[c]).alias("label"), F.col(inner[n] + "__bucket").cast("int").alias("bucket"), F.col(inner[n]).alias("x")]
        for i, (c, n) in enumerate(combos)])
    kept = rows.where(F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.isnan("x"))
    return kept.groupBy("combo", "label", "bucket", "x").agg(F.count("*").alias("n"))


def _label_ranks(counts: DataFrame, min_group: int) -> DataFrame:
    """(combo, label, n, rank_sum, tie_part): rank sums over all kept labels; tie parts add up to the sum of t^3 - t.

    Labels below ``min_group`` rows are left out before ranking.
    """
    if min_group > 1:
        kept = counts.groupBy("combo", "label").agg(F.sum("n").alias("size")).where(F.col("size") >= min_group)
        counts = counts.join(kept.select("combo", "label"), ["combo", "label"], "left_semi")
    per_value = counts.groupBy("combo", "bucket", "x").agg(F.sum("n").alias("n"))
    ranks = ordered.average_ranks(per_value, ["combo"]).select("combo", "bucket", "x", "avg_rank", F.col("n").cast("double").alias("t"))
    return (
        counts.join(ranks, ["combo", "bucket", "x"])  # rows are (label, value) counts: a hot value is one row per label
        .groupBy("combo", "label")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.col("avg_rank")).alias("rank_sum"),
            F.sum(F.col("n") * (F.col("t") * F.col("t") - 1.0)).alias("tie_part"),
        )
    )


def _name_combos(rows: DataFrame, combos: list[tuple[str, str]]) -> DataFrame:
    names = rows.sparkSession.createDataFrame(
        [(i, c, n) for i, (c, n) in enumerate(combos)], "combo int, category_column string, numeric_column string")
    return names.join(rows, "combo", "left")  # one row per combination


def mann_whitney(df: DataFrame, category: str, numeric: str) -> DataFrame:
    """U of the first label in sort order; exactly two labels, each with two rows or more."""
    combos = [(category, numeric)]
    return _mann_whitney(_label_counts(df, combos), combos)


def _mann_whitney(counts: DataFrame, combos: list[tuple[str, str]]) -> DataFrame:
    wide = _label_ranks(counts, 1).groupBy("combo").agg(
        F.count("*").alias("n_groups"),
        F.min("label").alias("label_a"),
        F.min_by("n", "label").alias("n_a"),
        F.max_by("n", "label").alias("n_b"),
        F.min_by("rank_sum", "label").alias("rank_sum_a"),
        F.sum("tie_part").alias("tie_term"),
        F.sum("n").alias("n"),
    )
    wide = _name_combos(wide, combos).withColumn("n_groups", F.coalesce("n_groups", F.lit(0)))
    ok = (F.col("n_groups") == 2) & (F.least("n_a", "n_b") >= MIN_GROUP)
    n_a = F.col("n_a").cast("double")
    u = F.col("rank_sum_a") - n_a * (n_a + 1.0) / 2.0
    return wide.select(
        "category_column",
        "numeric_column",
        "n_groups",
        "label_a",
        "n_a",
        "n_b",
        "n",
        "tie_term",
        _status(ok).alias("status"),
        F.when(ok, u).alias("statistic"),
    )


def mann_whitney_z() -> Column:
    """Tie-corrected normal score of U with continuity correction (two-sided: from the larger U)."""
    a, b, n = (F.col(c).cast("double") for c in ("n_a", "n_b", "n"))
    larger = F.greatest(F.col("statistic"), a * b - F.col("statistic"))
    spread = F.sqrt(a * b / 12.0 * (n + 1.0 - F.col("tie_term") / F.nullif(n * (n - 1.0), F.lit(0.0))))
    return (larger - a * b / 2.0 - 0.5) / F.nullif(spread, F.lit(0.0))


def mann_whitney_test(df: DataFrame, category: str, numeric: str, alpha: float = ALPHA) -> DataFrame:
    return _mann_whitney_p(mann_whitney(df, category, numeric), alpha)


def _mann_whitney_p(result: DataFrame, alpha: float) -> DataFrame:
    result = result.withColumn("z", mann_whitney_z())
    p = F.when(F.col("statistic").isNotNull(), F.least(F.lit(1.0), 2.0 * tails.normal_p_value(F.col("z"), "greater")))
    return with_p_value(result, p, alpha).withColumn("method", F.lit("normal approximation"))


def kruskal(df: DataFrame, category: str, numeric: str) -> DataFrame:
    """Tie-corrected H over labels with two rows or more."""
    combos = [(category, numeric)]
    return _kruskal(_label_counts(df, combos), combos)


def _kruskal(counts: DataFrame, combos: list[tuple[str, str]]) -> DataFrame:
    parts = _label_ranks(counts, MIN_GROUP).groupBy("combo").agg(
        F.count("*").alias("n_groups"),
        F.sum("n").alias("n"),
        F.sum("tie_part").alias("tie_term"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("spread"),
    )
    parts = _name_combos(parts, combos).withColumn("n_groups", F.coalesce("n_groups", F.lit(0)))
    n = F.col("n").cast("double")
    correction = 1.0 - F.col("tie_term") / F.nullif(n * n * n - n, F.lit(0.0))
    ok = (F.col("n_groups") >= 2) & (correction > 0)
    h = (12.0 / (n * (n + 1.0)) * F.col("spread") - 3.0 * (n + 1.0)) / F.nullif(correction, F.lit(0.0))
    return parts.select(
        "category_column",
        "numeric_column",
        "n",
        "n_groups",
        _status(ok).alias("status"),
        F.when(ok, h).alias("statistic"),
        (F.col("n_groups") - 1).alias("degrees_of_freedom"),
    )


def kruskal_test(df: DataFrame, category: str, numeric: str, alpha: float = ALPHA) -> DataFrame:
    return _kruskal_p(kruskal(df, category, numeric), alpha)


def _kruskal_p(result: DataFrame, alpha: float) -> DataFrame:
    p = tails.chi2_p_value(F.col("statistic"), F.col("degrees_of_freedom").cast("double"))
    return with_p_value(result, p, alpha).withColumn("method", F.lit("chi-square approximation"))


def _differences(df: DataFrame, a: str, b: str) -> Column:
    return C.finite(C.as_double(df, a) - C.as_double(df, b))


def wilcoxon(df: DataFrame, a: str, b: str, alternative: str = "two-sided") -> DataFrame:
    """Signed-rank sums of a - b with zeros dropped; two-sided statistic is the smaller sum, else the positive one."""
    if alternative not in ("two-sided", "greater", "less"):
        raise ValueError(f"alternative must be two-sided, greater or less, got {alternative!r}")
    diff = df.select(_differences(df, a, b).alias("d")).where(F.col("d").isNotNull())
    nonzero = diff.where(F.col("d") != 0)
    size = {"d": F.abs(F.col("d"))}
    edges = ordered.sketch_edges(nonzero, size)
    rows = ordered.long_values(nonzero, size, {"positive": F.col("d") > 0}, edges)
    counts = rows.groupBy("column", "bucket", "x").agg(
        F.count("*").alias("n"), F.count_if("positive").alias("n_positive")
    )
    ranks = ordered.average_ranks(counts, ["column"])
    tie = F.col("n").cast("double")
    sums = ranks.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.sum(F.col("n_positive") * F.col("avg_rank")).alias("w_plus"),
        F.sum((F.col("n") - F.col("n_positive")) * F.col("avg_rank")).alias("w_minus"),
        F.sum(tie * tie * tie - tie).alias("tie_term"),
    )
    zeros = diff.agg(F.count_if(F.col("d") == 0).alias("n_zero"))
    ok = F.col("n") >= MIN_PAIRS
    chosen = F.least("w_plus", "w_minus") if alternative == "two-sided" else F.col("w_plus")
    return C.attach_row(sums, zeros).select(
        F.lit(a).alias("column_a"),
        F.lit(b).alias("column_b"),
        F.lit(alternative).alias("alternative"),
        "n",
        "n_zero",
        "w_plus",
        "w_minus",
        "tie_term",
        _status(ok).alias("status"),
        F.when(ok, chosen).alias("statistic"),
    )


def wilcoxon_test(df: DataFrame, a: str, b: str, alternative: str = "two-sided", alpha: float = ALPHA) -> DataFrame:
    n = F.col("n").cast("double")
    spread = F.sqrt((n * (n + 1.0) * (2.0 * n + 1.0) - F.col("tie_term") / 2.0) / 24.0)
    z = (F.col("statistic") - n * (n + 1.0) / 4.0) / F.nullif(spread, F.lit(0.0))
    result = wilcoxon(df, a, b, alternative).withColumn("z", z)
    return with_p_value(result, tails.normal_p_value(F.col("z"), alternative), alpha).withColumn(
        "method", F.lit("normal approximation")
    )


def sign_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    d = _differences(df, a, b)
    counted = df.agg(
        F.count_if(d > 0).alias("n_positive"), F.count_if(d < 0).alias("n_negative"), F.count_if(d == 0).alias("n_zero")
    )
    n = F.col("n_positive") + F.col("n_negative")
    ok = n >= MIN_PAIRS
    return counted.select(
        F.lit(a).alias("column_a"),
        F.lit(b).alias("column_b"),
        n.alias("n"),
        "n_positive",
        "n_negative",
        "n_zero",
        _status(ok).alias("status"),
        F.when(ok, F.col("n_positive").cast("double")).alias("statistic"),
    )


def sign_test(df: DataFrame, a: str, b: str, alternative: str = "two-sided", alpha: float = ALPHA) -> DataFrame:
    p = F.when(
        F.col("status") == "completed", tails.binomial_p_value(F.col("n_positive"), F.col("n"), alternative)
    )
    return with_p_value(sign_counts(df, a, b), p, alpha)


def friedman(df: DataFrame, columns: list[str]) -> DataFrame:
    """Friedman chi-square over related columns; ranks are taken inside each row, so nothing is shuffled."""
    if len(columns) < 3:
        raise ValueError("the Friedman test needs at least three columns")
    k = len(columns)
    flat = df.select(*[C.finite(C.as_double(df, c)).alias(f"v{i}") for i, c in enumerate(columns)])
    flat = flat.where(C.complete(*[F.col(f"v{i}") for i in range(k)]))

    def less(i: int) -> Column:
        return sum((F.when(F.col(f"v{j}") < F.col(f"v{i}"), 1).otherwise(0) for j in range(k) if j != i), F.lit(0))

    def equal(i: int) -> Column:
        return sum((F.when(F.col(f"v{j}") == F.col(f"v{i}"), 1).otherwise(0) for j in range(k)), F.lit(0))

    # rank in row = smaller values + (ties + 1) / 2; each member of a tie of size t adds t^2 - 1 to the tie term
    sums = flat.agg(
        F.count("*").alias("n"),
        *[F.sum(less(i) + (equal(i) + 1) / F.lit(2.0)).alias(f"r{i}") for i in range(k)],
        F.sum(sum((equal(i) * equal(i) - 1 for i in range(k)), F.lit(0)).cast("double")).alias("tie_term"),
    )
    n = F.col("n").cast("double")
    spread = sum((F.col(f"r{i}") * F.col(f"r{i}") for i in range(k)), F.lit(0.0))
    correction = 1.0 - F.col("tie_term") / F.nullif(n * (k * (k * k - 1.0)), F.lit(0.0))
    ok = (F.col("n") >= MIN_PAIRS) & (correction > 0)
    value = (12.0 / (n * (k * (k + 1.0))) * spread - 3.0 * n * (k + 1.0)) / F.nullif(correction, F.lit(0.0))
    return sums.select(
        F.lit(",".join(columns)).alias("columns"),
        "n",
        F.lit(k).alias("n_groups"),
        _status(ok).alias("status"),
        F.when(ok, value).alias("statistic"),
        F.lit(k - 1).alias("degrees_of_freedom"),
    )


def friedman_test(df: DataFrame, columns: list[str], alpha: float = ALPHA) -> DataFrame:
    p = tails.chi2_p_value(F.col("statistic"), F.col("degrees_of_freedom").cast("double"))
    return with_p_value(friedman(df, columns), p, alpha)


def rank_battery(
    df: DataFrame, numerics: list[str], categories: list[str], cap: int | None = None, alpha: float = ALPHA
) -> DataFrame:
    """Spearman and Kendall over number pairs, Mann-Whitney and Kruskal-Wallis over category x number.

    The steps do not depend on how many pairs there are: all pairs of a kind go through one plan, and both label tests
    read one table of distinct (combination, label, value) counts."""
    from tablegauge.operators import kendall

    keep = ("test", "column_a", "column_b", "n", "status", "statistic", "p_value")
    pairs = explore.name_pairs(numerics, cap)
    combos = [(c, n) for c in sorted(categories) for n in sorted(numerics)][:cap]
    parts = []
    if pairs:
        parts.append(spearman_test(df, pairs, alpha).withColumn("test", F.lit("spearman")))
        parts.append(kendall.kendall_tests(df, pairs, alpha).withColumn("test", F.lit("kendall")))
    if combos:
        counts = staged(_label_counts(df, combos), "label-counts")
        for result, name in ((_mann_whitney_p(_mann_whitney(counts, combos), alpha), "mann_whitney_u"),
                             (_kruskal_p(_kruskal(counts, combos), alpha), "kruskal_wallis")):
            parts.append(result.withColumnsRenamed({"category_column": "column_a", "numeric_column": "column_b"}).withColumn("test", F.lit(name)))
    if not parts:
        return df.sparkSession.createDataFrame([], BATTERY_SCHEMA)
    out = parts[0].select(*keep)
    for p in parts[1:]:
        out = out.unionByName(p.select(*keep))
    return out
