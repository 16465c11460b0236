"""Moment statistics with the sample corrections used in reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def safe_divide(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def adjusted_skewness(value: Column) -> Column:
    """Bias-adjusted Fisher-Pearson G1; NULL below three values or on a constant."""
    n = F.count(value).cast("double")
    varied = F.min(value) < F.max(value)
    return F.when(varied & (n >= 3), F.skewness(value) * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def adjusted_kurtosis(value: Column) -> Column:
    """Bias-adjusted excess G2; NULL below four values or on a constant."""
    n = F.count(value).cast("double")
    varied = F.min(value) < F.max(value)
    scaled = (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * F.kurtosis(value) + 6.0)
    return F.when(varied & (n >= 4), scaled)


def pearson(x: Column, y: Column) -> Column:
    """Correlation over the rows where both are present; NULL when either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    varied = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(varied, safe_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))
