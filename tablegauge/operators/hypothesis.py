"""Parametric tests and effect sizes, each from one grouped aggregate over the table.

Results carry ``status``: a value that cannot be computed is NULL with status ``unavailable``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablegauge.functions import columns as C, moments, tails
from tablegauge.operators import explore, ordered

ALPHA = 0.05
MI_BINS = 10  # fixed value: quantile bins of a number


def _status(ok: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), "completed").otherwise("unavailable")


def with_p_value(result: DataFrame, p: Column, alpha: float = ALPHA) -> DataFrame:
    """Append ``p_value`` and ``significant``; runs on finished statistics only."""
    return result.withColumn("p_value", p).withColumn("significant", F.col("p_value") < F.lit(alpha))


def welch(df: DataFrame, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Welch t statistic and degrees of freedom over complete pairs, all pairs in one aggregate."""
    pairs = pairs if pairs is not None else explore.name_pairs(C.numeric_columns(df))
    parts = []
    for i, (a, b) in enumerate(pairs):
        x, y = C.as_double(df, a), C.as_double(df, b)
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        parts.append(
            F.struct(
                F.lit(a).alias("column_a"),
                F.lit(b).alias("column_b"),
                F.count(x).alias("n"),
                F.avg(x).alias("mean_a"),
                F.avg(y).alias("mean_b"),
                F.var_samp(x).alias("var_a"),
                F.var_samp(y).alias("var_b"),
            ).alias(f"s{i}")
        )
    rows = C.stack_rows(df.agg(*parts))
    n = F.col("n").cast("double")
    ok = (F.col("n") >= 2) & (F.col("var_a") > 0) & (F.col("var_b") > 0)
    se_a, se_b = F.col("var_a") / n, F.col("var_b") / n
    t = (F.col("mean_a") - F.col("mean_b")) / F.sqrt(se_a + se_b)
    dof = (se_a + se_b) * (se_a + se_b) / ((se_a * se_a + se_b * se_b) / (n - 1))
    return rows.select(
        "column_a",
        "column_b",
        "n",
        _status(ok).alias("status"),
        F.when(ok, t).alias("statistic"),
        F.when(ok, dof).alias("degrees_of_freedom"),
    )


def welch_test(df: DataFrame, pairs: list[tuple[str, str]] | None = None, alpha: float = ALPHA) -> DataFrame:
    return with_p_value(welch(df, pairs), tails.t_p_value(F.col("statistic"), F.col("degrees_of_freedom")), alpha)


def group_moments(df: DataFrame, categories: list[str], numerics: list[str]) -> DataFrame:
    """(category_column, label, numeric_column, n, mean, ss) for every category x number combination.

    One scan: rows are repeated once per category column (not per pair), and partially aggregated before the shuffle.
    """
    numbers = [C.as_double(df, c).alias(f"v{i}") for i, c in enumerate(numerics)]
    rows = C.unpivot_rows(
        df, numbers, [[F.lit(c).alias("category_column"), C.as_text(df, c).alias("label")] for c in categories]
    ).where(F.col("label").isNotNull())
    grouped = rows.groupBy("category_column", "label").agg(
        *[
            F.struct(
                F.lit(c).alias("numeric_column"),
                F.count(f"v{i}").alias("n"),
                F.avg(f"v{i}").alias("mean"),
                F.coalesce(F.var_samp(f"v{i}") * (F.count(f"v{i}") - 1), F.lit(0.0)).alias("ss"),
            ).alias(f"s{i}")
            for i, c in enumerate(numerics)
        ]
    )
    stacked = grouped.select(
        "category_column", "label", F.inline(F.array(*[f"s{i}" for i in range(len(numerics))]))
    )
    return stacked.where(F.col("n") > 0)


def _between(groups: DataFrame) -> DataFrame:
    """Per combination: k, N, grand mean, between and within sums of squares."""
    keys = ["category_column", "numeric_column"]
    grand = groups.groupBy(*keys).agg(
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"),
    )
    gap = F.col("mean") - F.col("grand")
    return (
        groups.join(F.broadcast(grand), keys)  # one row per combination
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n_groups"),
            F.sum("n").alias("n"),
            F.sum(F.col("n") * gap * gap).alias("ss_between"),
            F.sum("ss").alias("ss_within"),
        )
    )


def anova(df: DataFrame, categories: list[str], numerics: list[str]) -> DataFrame:
    """One-way F statistic; groups below two rows are left out."""
    parts = _between(group_moments(df, categories, numerics).where(F.col("n") >= 2))
    df1, df2 = F.col("n_groups") - 1, F.col("n") - F.col("n_groups")
    ok = (F.col("n_groups") >= 2) & (F.col("ss_within") > 0)
    return parts.select(
        "category_column",
        "numeric_column",
        "n",
        "n_groups",
        _status(ok).alias("status"),
        F.when(ok, (F.col("ss_between") / df1) / (F.col("ss_within") / df2)).alias("statistic"),
        df1.alias("df_between"),
        df2.alias("df_within"),
    )


def anova_test(df: DataFrame, categories: list[str], numerics: list[str], alpha: float = ALPHA) -> DataFrame:
    p = tails.f_p_value(
        F.col("statistic"), F.col("df_between").cast("double"), F.col("df_within").cast("double")
    )
    return with_p_value(anova(df, categories, numerics), p, alpha)


def correlation_ratio(df: DataFrame, categories: list[str], numerics: list[str]) -> DataFrame:
    """Eta = sqrt(SSB / SST) over all groups."""
    parts = _between(group_moments(df, categories, numerics))
    total = F.col("ss_between") + F.col("ss_within")
    ok = (F.col("n_groups") >= 2) & (total > 0)
    return parts.select(
        "category_column",
        "numeric_column",
        "n",
        "n_groups",
        _status(ok).alias("status"),
        F.when(ok, F.least(F.lit(1.0), F.sqrt(F.col("ss_between") / total))).alias("effect_size"),
    )


def pair_cells(df: DataFrame, pairs: list[tuple[Column, Column, str, str]]) -> DataFrame:
    """Contingency cells of several (a, b) pairs: (column_a, column_b, a, b, n), complete rows only."""
    rows = C.unpivot_rows(
        df,
        [],
        [
            [F.lit(na).alias("column_a"), F.lit(nb).alias("column_b"), a.alias("a"), b.alias("b")]
            for a, b, na, nb in pairs
        ],
    )
    return (
        rows.where(C.complete(F.col("a"), F.col("b")))
        .groupBy("column_a", "column_b", "a", "b")
        .agg(F.count("*").alias("n"))
    )


def with_margins(cells: DataFrame) -> DataFrame:
    """Add row, column and pair totals to contingency cells, by grouped joins (no per-pair window)."""
    keys = ["column_a", "column_b"]
    rows = cells.groupBy(*keys, "a").agg(F.sum("n").alias("row_total"))
    cols = cells.groupBy(*keys, "b").agg(F.sum("n").alias("col_total"))
    size = rows.groupBy(*keys).agg(
        F.sum("row_total").alias("total"), F.count("*").alias("n_rows"), F.min("row_total").alias("min_row")
    )
    width = cols.groupBy(*keys).agg(F.count("*").alias("n_cols"), F.min("col_total").alias("min_col"))
    sizes = F.broadcast(size.join(width, keys))  # one row per pair
    return cells.join(rows, [*keys, "a"]).join(cols, [*keys, "b"]).join(sizes, keys)


def _chi_square_parts(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    cells = pair_cells(df, [(C.as_text(df, a), C.as_text(df, b), a, b) for a, b in pairs])
    n = F.col("n").cast("double")
    share = n * n / (F.col("row_total").cast("double") * F.col("col_total"))
    return (
        with_margins(cells)
        .groupBy("column_a", "column_b", "total", "n_rows", "n_cols", "min_row", "min_col")
        .agg((F.col("total") * (F.sum(share) - 1.0)).alias("chi2"))
    )


def chi_square(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Chi-square of independence without continuity correction; works from the cells that exist."""
    ok = (F.col("n_rows") >= 2) & (F.col("n_cols") >= 2)
    return _chi_square_parts(df, pairs).select(
        "column_a",
        "column_b",
        F.col("total").alias("n"),
        _status(ok).alias("status"),
        F.when(ok, F.greatest(F.col("chi2"), F.lit(0.0))).alias("statistic"),
        F.when(ok, (F.col("n_rows") - 1) * (F.col("n_cols") - 1)).alias("degrees_of_freedom"),
        (F.col("min_row").cast("double") * F.col("min_col") / F.col("total")).alias("min_expected"),
    ).withColumn("low_expected", F.col("min_expected") < 5.0)


def chi_square_test(df: DataFrame, pairs: list[tuple[str, str]], alpha: float = ALPHA) -> DataFrame:
    p = tails.chi2_p_value(F.col("statistic"), F.col("degrees_of_freedom").cast("double"))
    return with_p_value(chi_square(df, pairs), p, alpha)


def cramers_v(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    side = F.least(F.col("n_rows"), F.col("n_cols")) - 1
    ok = side >= 1
    value = F.sqrt(F.greatest(F.col("chi2"), F.lit(0.0)) / (F.col("total") * side))
    return _chi_square_parts(df, pairs).select(
        "column_a",
        "column_b",
        F.col("total").alias("n"),
        _status(ok).alias("status"),
        F.when(ok, F.least(F.lit(1.0), value)).alias("effect_size"),
    )


def mutual_information(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Plug-in mutual information in nats; numbers are cut into ten quantile bins first.

    Bin edges of all pairs come from one quantile job (complete rows of each pair) and are used as literals.
    """
    kinds = C.eda_kinds(df)
    flat, numbers = {}, []
    for i, (a, b) in enumerate(pairs):
        both = C.present(df, a) & C.present(df, b)
        for side, name in enumerate((a, b)):
            key = f"v{i}_{side}"
            if kinds[name] == C.NUMERIC:
                numbers.append(key)
                flat[key] = F.when(both, C.as_double(df, name))
            else:
                flat[key] = F.when(both, C.as_text(df, name))
    views = {key: F.col(key) for key in flat}
    df = df.select(*[value.alias(key) for key, value in flat.items()])
    if numbers:
        cuts = ordered.quantile_values(df, {key: F.col(key) for key in numbers}, [j / MI_BINS for j in range(MI_BINS + 1)])
        for key in numbers:
            code = F.when(F.col(key).isNotNull(), F.lit(0))
            for e in sorted(set(cuts[key].values()))[1:-1]:
                code = code + F.when(F.col(key) > F.lit(e), 1).otherwise(0)
            views[key] = code.cast("string")
    cells = with_margins(pair_cells(df, [(views[f"v{i}_0"], views[f"v{i}_1"], a, b) for i, (a, b) in enumerate(pairs)]))
    p = F.col("n") / F.col("total")
    ratio = F.col("n").cast("double") * F.col("total") / (F.col("row_total").cast("double") * F.col("col_total"))
    return (
        cells.groupBy("column_a", "column_b", F.col("total").alias("n_observations"))
        .agg(F.greatest(F.lit(0.0), F.sum(p * F.log(ratio))).alias("effect_size"))
        .select("column_a", "column_b", F.col("n_observations").alias("n"), "effect_size")
    )


def test_battery(
    df: DataFrame, numerics: list[str], categories: list[str], cap: int | None = None, alpha: float = ALPHA
) -> DataFrame:
    """Welch, ANOVA and chi-square over all pairs as rows (test, column_a, column_b, statistic, df, p_value)."""
    numeric_pairs = explore.name_pairs(numerics, cap)
    category_pairs = explore.name_pairs(categories, cap)
    parts = []
    as_row = lambda d, test, a, b, dof: d.select(
        F.lit(test).alias("test"), F.col(a).alias("column_a"), F.col(b).alias("column_b"), "n", "status",
        "statistic", F.col(dof).cast("double").alias("degrees_of_freedom"), "p_value",
    )
    if numeric_pairs:
        parts.append(as_row(welch_test(df, numeric_pairs, alpha), "welch", "column_a", "column_b", "degrees_of_freedom"))
    if numerics and categories:
        both = anova_test(df, sorted(categories), sorted(numerics), alpha)
        order = both if cap is None else both.orderBy("category_column", "numeric_column").limit(cap)
        parts.append(as_row(order, "anova", "category_column", "numeric_column", "df_between"))
    if category_pairs:
        parts.append(as_row(chi_square_test(df, category_pairs, alpha), "chi_square", "column_a", "column_b", "degrees_of_freedom"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def effect_battery(df: DataFrame, numerics: list[str], categories: list[str], cap: int | None = None) -> DataFrame:
    """Cramer's V, eta and binned mutual information over all pairs."""
    category_pairs = explore.name_pairs(categories, cap)
    parts = []
    if category_pairs:
        v = cramers_v(df, category_pairs)
        parts.append(v.select(F.lit("cramers_v").alias("effect"), "column_a", "column_b", "n", "effect_size"))
    if numerics and categories:
        eta = correlation_ratio(df, sorted(categories), sorted(numerics))
        eta = eta if cap is None else eta.orderBy("category_column", "numeric_column").limit(cap)
        parts.append(
            eta.select(
                F.lit("correlation_ratio").alias("effect"),
                F.col("category_column").alias("column_a"),
                F.col("numeric_column").alias("column_b"),
                "n",
                "effect_size",
            )
        )
    mi = mutual_information(df, explore.name_pairs([*numerics, *categories], cap))
    parts.append(mi.select(F.lit("mutual_information").alias("effect"), "column_a", "column_b", "n", "effect_size"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
