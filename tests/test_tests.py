import math

import pytest
from pyspark.sql import functions as F

from conftest import by, one
from tablegauge.functions import tails
from tablegauge.operators import explore as X, hypothesis as H, pvalues, ranktests as R


@pytest.fixture(scope="module")
def ten(spark):
    rows = [(float(i), float(i * i % 7), float(11 - i), "ABC"[i % 3], "yn"[i % 2]) for i in range(1, 11)]
    return spark.createDataFrame(rows, "a double, b double, c double, grade string, flag string")


def test_tails_agree_with_commons_math(spark):
    d = spark._jvm.org.apache.commons.math3.distribution
    for t, df in ((0.3, 4.0), (2.0, 10.0), (5.5, 123.4)):
        assert math.isclose(tails.t_two_sided(t, df), 2 * (1 - d.TDistribution(df).cumulativeProbability(t)), rel_tol=1e-8)
    for x, df in ((0.2, 1.0), (3.84, 1.0), (25.0, 9.0), (80.0, 60.0)):
        assert math.isclose(tails.chi2_sf(x, df), 1 - d.ChiSquaredDistribution(df).cumulativeProbability(x), rel_tol=1e-8)
    for f, a, b in ((0.5, 2.0, 10.0), (4.0, 3.0, 96.0)):
        assert math.isclose(tails.f_sf(f, a, b), 1 - d.FDistribution(a, b).cumulativeProbability(f), rel_tol=1e-8)
    assert math.isclose(tails.normal_sf(1.959963984540054), 0.025, rel_tol=1e-9)
    for k, n in ((3, 10), (0, 6), (7, 7), (14, 31)):
        b = d.BinomialDistribution(n, 0.5)
        upper = 1.0 if k == 0 else 1 - b.cumulativeProbability(k - 1)
        both = min(1.0, 2 * min(upper, b.cumulativeProbability(k)))
        assert math.isclose(tails.binomial_half(k, n, "two-sided"), both, rel_tol=1e-8)
        assert math.isclose(tails.binomial_half(k, n, "greater"), upper, rel_tol=1e-8)
        assert math.isclose(tails.binomial_half(k, n, "less"), b.cumulativeProbability(k), rel_tol=1e-8)
    assert math.isclose(tails.digamma(1.0), -0.5772156649015329, rel_tol=1e-10)


def test_welch_and_constants(spark, frame, ten):
    r = one(H.welch_test(ten, [("a", "c")]))
    assert r["statistic"] == 0.0 and r["p_value"] == pytest.approx(1.0) and r["degrees_of_freedom"] == pytest.approx(18.0)
    flat = frame("x double, k double", [(float(i), 2.0) for i in range(5)])
    r = one(H.welch_test(flat, [("k", "x")]))
    assert r["status"] == "unavailable" and r["statistic"] is None and r["p_value"] is None


def test_independent_and_perfect_tables(spark, frame):
    balanced = frame("x string, y string", [("pq"[i % 2], "uv"[i // 2 % 2]) for i in range(40)])
    r = one(H.chi_square_test(balanced, [("x", "y")]))
    assert (r["statistic"], r["p_value"], r["degrees_of_freedom"]) == (0.0, 1.0, 1)
    perfect = frame("x string, y string", [("p", "u")] * 10 + [("q", "v")] * 10)
    assert one(H.cramers_v(perfect, [("x", "y")]))["effect_size"] == pytest.approx(1.0)
    assert one(H.mutual_information(perfect, [("x", "y")]))["effect_size"] == pytest.approx(math.log(2))
    single = frame("x string, y string", [("p", "u"), ("p", "v")])
    assert one(H.chi_square(single, [("x", "y")]))["status"] == "unavailable"


def test_anova_and_eta(spark, frame):
    rows = [("a", v) for v in (1.0, 2.0, 3.0)] + [("b", v) for v in (2.0, 3.0, 4.0)] + [("c", 100.0)]
    df = frame("g string, x double", rows)
    r = one(H.anova_test(df, ["g"], ["x"]))
    assert r["n"] == 6 and r["n_groups"] == 2 and r["statistic"] == pytest.approx(1.5)
    assert r["p_value"] == pytest.approx(0.2878641347, rel=1e-6)
    assert one(H.correlation_ratio(df, ["g"], ["x"]))["n_groups"] == 3


def test_pearson_null_on_constant_and_complete_pairs(spark, frame):
    df = frame("a double, b double, k double", [(1.0, 2.0, 1.0), (2.0, None, 1.0), (3.0, 6.0, 1.0), (None, 8.0, 1.0), (5.0, 10.0, 1.0)])
    r = {(x["column_a"], x["column_b"]): x for x in X.correlations(df).collect()}
    assert r["a", "b"]["n"] == 3 and r["a", "b"]["correlation"] == pytest.approx(1.0)
    assert r["a", "k"]["correlation"] is None


def test_rank_tests_on_a_small_frame(spark, frame):
    rows = [(float(i), float([2, 1, 4, 3, 6, 5, 8, 7][i - 1]), float(9 - i), "xy"[i % 2], "pqr"[i % 3]) for i in range(1, 9)]
    df = frame("a double, b double, c double, g2 string, g3 string", rows)
    rho = {(r["column_a"], r["column_b"]): r for r in R.spearman_test(df, [("a", "b"), ("a", "c")]).collect()}
    assert rho["a", "b"]["statistic"] == pytest.approx(1 - 6 * 8 / (8 * 63))
    assert rho["a", "c"]["statistic"] == pytest.approx(-1.0) and rho["a", "c"]["p_value"] == 0.0
    u = one(R.mann_whitney_test(df, "g2", "a"))
    assert u["statistic"] == 10.0 and u["label_a"] == "x"
    assert one(R.mann_whitney_test(df, "g3", "a"))["status"] == "unavailable"
    h = one(R.kruskal_test(df, "g3", "a"))
    # p: 3, 6 -> 9; q: 1, 4, 7 -> 12; r: 2, 5, 8 -> 15
    assert h["statistic"] == pytest.approx(12 / 72 * (81 / 2 + 144 / 3 + 225 / 3) - 27) and h["degrees_of_freedom"] == 2


def test_paired_tests(spark, frame):
    df = frame("x double, y double", [(float(i), i + (0.0 if i == 3 else 1.5 if i % 4 else -0.5)) for i in range(1, 31)])
    w = one(R.wilcoxon_test(df, "x", "y"))
    assert w["n"] == 29 and w["n_zero"] == 1 and w["w_plus"] + w["w_minus"] == 29 * 30 / 2
    assert w["statistic"] == min(w["w_plus"], w["w_minus"]) == 28.0  # seven smallest ranks
    assert one(R.wilcoxon_test(df, "x", "y", "less"))["p_value"] < 1e-4
    s = one(R.sign_test(df, "x", "y"))
    assert (s["n_positive"], s["n_negative"], s["n_zero"]) == (7, 22, 1)
    assert s["p_value"] == pytest.approx(0.00813, rel=2e-3)
    with pytest.raises(ValueError):
        R.wilcoxon(df, "x", "y", "sideways")


def test_friedman(spark, frame):
    df = frame("a double, b double, c double", [(1.0, 2.0, 3.0)] * 4 + [(None, 1.0, 2.0)])
    r = one(R.friedman_test(df, ["a", "b", "c"]))
    assert r["n"] == 4 and r["statistic"] == pytest.approx(8.0) and r["p_value"] == pytest.approx(math.exp(-4))
    same = frame("a double, b double, c double", [(1.0, 1.0, 1.0)] * 4)
    assert one(R.friedman_test(same, ["a", "b", "c"]))["status"] == "unavailable"


@pytest.mark.parametrize(
    "method, p, want",
    [
        ("bonferroni", [0.01, 0.02, 0.03], [0.03, 0.06, 0.09]),
        ("holm", [0.01, 0.02, 0.03, 0.04], [0.04, 0.06, 0.06, 0.06]),
        ("benjamini_hochberg", [0.01, 0.02, 0.03, 0.04, 0.05], [0.05] * 5),
    ],
)
def test_multiple_testing(spark, frame, method, p, want):
    df = frame("i int, p_value double", [*enumerate(p), (99, None)])
    got = by(pvalues.adjust(df, method=method, order="i"), "i")
    assert [round(got[i]["adjusted_p"], 10) for i in range(len(p))] == want
    assert got[99]["adjusted_p"] is None


def test_histogram_counts_every_row_once(spark, frame):
    df = frame("x double, k double", [(float(i), 1.0) for i in range(100)])
    bins = X.histograms(df).collect()
    assert {b["column"] for b in bins} == {"x"} and len(bins) == 8 and sum(b["count"] for b in bins) == 100


def test_shape_matches_formulas(spark, frame):
    values = [1.0, 2.0, 2.0, 3.0, 9.0, float("inf"), None]
    r = one(X.shape(frame("x double", [(v,) for v in values])))
    x = values[:5]
    n, m = 5, sum(x) / 5
    m2, m3, m4 = (sum((v - m) ** k for v in x) / n for k in (2, 3, 4))
    g1, g2 = m3 / m2**1.5, m4 / m2**2 - 3
    assert r["count"] == 5
    assert r["skewness"] == pytest.approx(g1 * math.sqrt(n * (n - 1)) / (n - 2))
    assert r["kurtosis"] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
