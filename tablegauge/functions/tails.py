"""Tail probabilities for result rows.

Statistics are aggregated by Spark; these functions only turn a handful of finished statistics into
p-values. They use the published continued fractions for the incomplete beta and gamma functions.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F

_TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 10000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + numerator / c
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_sf(a: float, x: float) -> float:
    """Upper regularised incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - total * front
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, 100000):
        numerator = -i * (i - a)
        b += 2.0
        d = numerator * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + numerator / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h * front


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2.0, 0.5, df / (df + t * t))


def f_sf(f: float, df1: float, df2: float) -> float:
    return beta_cdf(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2.0, x / 2.0)


def _half_power(n: float) -> float:
    return math.exp(-n * math.log(2.0))


def binomial_half(successes: float, trials: float, alternative: str) -> float:
    """Exact binomial test with p = 1/2."""
    at_least = lambda k: 1.0 if k <= 0 else beta_cdf(k, trials - k + 1.0, 0.5)
    if alternative == "greater":
        return at_least(successes)
    if alternative == "less":
        return 1.0 if successes >= trials else 1.0 - at_least(successes + 1.0)
    if trials > 0 and (successes == 0 or successes == trials):
        return min(1.0, 2.0 * _half_power(trials))
    return min(1.0, 2.0 * min(at_least(successes), 1.0 - at_least(successes + 1.0)))


def digamma(x: float) -> float:
    total = 0.0
    while x < 10.0:
        total -= 1.0 / x
        x += 1.0
    inv = 1.0 / (x * x)
    # fixed values: asymptotic series of digamma
    series = inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv * (1 / 240 - inv * (1 / 132)))))
    return total + math.log(x) - 0.5 / x - series


def _column(function, *args: Column) -> Column:
    @F.pandas_udf("double")
    def tail(*series: pd.Series) -> pd.Series:
        out = []
        for values in zip(*series):
            missing = any(v is None or (isinstance(v, float) and math.isnan(v)) for v in values)
            out.append(None if missing else function(*values))
        return pd.Series(out, dtype="float64")

    return tail(*args)


def t_p_value(t: Column, df: Column) -> Column:
    return _column(t_two_sided, t, df)


def f_p_value(f: Column, df1: Column, df2: Column) -> Column:
    return _column(f_sf, f, df1, df2)


def chi2_p_value(x: Column, df: Column) -> Column:
    return _column(chi2_sf, x, df)


def normal_p_value(z: Column, alternative: str = "two-sided") -> Column:
    if alternative == "greater":
        return _column(normal_sf, z)
    if alternative == "less":
        return _column(normal_sf, -z)
    return F.least(F.lit(1.0), 2.0 * _column(normal_sf, F.abs(z)))


def binomial_p_value(successes: Column, trials: Column, alternative: str = "two-sided") -> Column:
    return _column(
        lambda s, n: binomial_half(float(s), float(n), alternative), successes.cast("double"), trials.cast("double")
    )


def digamma_column(x: Column) -> Column:
    return _column(digamma, x.cast("double"))
