import random
import statistics

from pyspark.sql import functions as F

from tablegauge.operators import features as G, neighbours as N, ordered
from tablegauge.operators import kendall as K


def quantile(values, p):
    values = sorted(values)
    h = (len(values) - 1) * p
    lo = int(h)
    hi = min(lo + 1, len(values) - 1)
    return values[lo] + (values[hi] - values[lo]) * (h - lo)


def test_quantiles_with_one_value_holding_a_third_of_the_rows(spark, frame):
    rng = random.Random(1)
    values = [7.0] * 1000 + [rng.lognormvariate(0, 2) for _ in range(2000)]
    rng.shuffle(values)
    df = frame("x double", [(v,) for v in values]).repartition(7)
    got = {r["probability"]: r["quantile"] for r in ordered.quantiles(df, {"x": F.col("x")}, [0.0, 0.05, 0.5, 0.9, 1.0]).collect()}
    for p, q in got.items():
        assert abs(q - quantile(values, p)) < 1e-9


def test_keyed_quantiles_ignore_nulls(spark, frame):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, rng.gauss(0, 1), 3.0])) for k in "aab" * 300]
    df = frame("k string, x double", rows)
    got = ordered.quantiles(df, {"x": F.col("x")}, [0.25, 0.5], {"k": F.col("k")}).collect()
    assert len(got) == 4
    for r in got:
        values = [x for k, x in rows if k == r["k"] and x is not None]
        assert abs(r["quantile"] - quantile(values, r["probability"])) < 1e-9


def test_empty_and_single_value(spark, frame):
    df = frame("x double, y double", [(None, 4.0), (None, 4.0)])
    got = ordered.quantile_values(df, {"x": F.col("x"), "y": F.col("y")}, [0.5])
    assert got == {"x": {}, "y": {0.5: 4.0}}


def test_average_ranks_share_ties(spark, frame):
    values = [5, 5, 1, 9, 9, 9, 2]
    df = frame("x double", [(float(v),) for v in values])
    long = ordered.long_values(df, {"x": F.col("x")})
    ranks = ordered.average_ranks(long.groupBy("column", "bucket", "x").agg(F.count("*").alias("n")), ["column"])
    assert {r["x"]: r["avg_rank"] for r in ranks.collect()} == {1.0: 1.0, 2.0: 2.0, 5.0: 3.5, 9.0: 6.0}


def test_result_does_not_depend_on_partitioning(spark, frame):
    df = frame("x double", [(float(i % 97),) for i in range(2000)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(tuple, ordered.quantiles(df.repartition(int(n)), {"x": F.col("x")}, [0.1, 0.5]).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_kendall_against_all_pairs_with_hot_values(spark, frame):
    rng = random.Random(3)
    rows = [(rng.choice([1.0, rng.randint(0, 30), 1.0]), rng.choice([4.0, rng.randint(0, 50)])) for _ in range(400)]
    rows = [(float(a), float(b)) for a, b in rows]
    sign = lambda v: (v > 0) - (v < 0)
    s = sum(sign(a[0] - b[0]) * sign(a[1] - b[1]) for i, a in enumerate(rows) for b in rows[:i])
    got = K.kendall(frame("x double, y double", rows), "x", "y").first()
    assert got["n"] == 400 and got["s"] == s
    ties = lambda c: sum(n * (n - 1) / 2 for n in (sum(1 for r in rows if r[c] == v) for v in {r[c] for r in rows}))
    pairs = 400 * 399 / 2
    assert abs(got["statistic"] - s / ((pairs - ties(0)) * (pairs - ties(1))) ** 0.5) < 1e-12


def test_sliced_windows_equal_plain_windows(spark, frame):
    rng = random.Random(4)
    rows = [(s, i, rng.gauss(0, 1) if rng.random() > 0.05 else None) for s, n in (("a", 500), ("b", 37)) for i in range(n)]
    df = frame("s string, t long, y double", rows)
    df = df.withColumn("ts", F.timestamp_micros(F.col("t") * 3_600_000_000).cast("timestamp_ntz"))
    plain = G.temporal_features(df, "y", "ts", ["s"])
    cut = G.temporal_features_sliced(df, "y", "ts", ["s"], block_rows=40)
    keep = [c for c in plain.columns if c.startswith("y__")]
    a = {(r["s"], r["t"]): [r[c] for c in keep] for r in plain.collect()}
    b = {(r["s"], r["t"]): [r[c] for c in keep] for r in cut.collect()}
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9)


def test_lag_and_rolling_closed_form(spark, frame):
    df = frame("t long, y double", [(i, 2.0 * i) for i in range(60)])
    df = df.withColumn("ts", F.timestamp_micros(F.col("t") * 86_400_000_000).cast("timestamp_ntz")).withColumn("s", F.lit("one"))
    r = {x["t"]: x for x in G.temporal_features(df, "y", "ts", ["s"]).collect()}
    assert r[20]["y__lag_7"] == 26.0 and r[6]["y__lag_7"] is None
    assert r[20]["y__rolling_mean_7"] == statistics.mean(2.0 * i for i in range(13, 20))
    assert r[6]["y__rolling_mean_7"] is None and r[29]["y__rolling_std_30"] is None and r[30]["y__rolling_std_30"] is not None


def brute_nearest(q, points, k, dist):
    return sorted((dist(q, p), i) for i, p in points)[:k]


def test_nearest_against_brute_force_with_tiny_blocks(spark, frame):
    rng = random.Random(5)
    points = [(i, [rng.gauss(0, 1), rng.gauss(0, 1), 0.5]) for i in range(200)] + [(200 + i, [0.0, 0.0, 0.5]) for i in range(100)]
    data = frame("pid long, v array<double>, payload double", [(i, v, float(i % 3)) for i, v in points])
    asked = frame("qid long, v array<double>", points[:220])
    euclid = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5
    got = N.nearest(asked, data, 4, centres=9, block=30, chunk=20).collect()
    assert len(got) == 220
    for r in got:
        want = brute_nearest(r["v"], points, 4, euclid)
        assert [(round(n["distance"], 9), n["pid"]) for n in r["neighbours"]] == [(round(d, 9), i) for d, i in want]


def brute_mi(rows, k):
    import numpy as np

    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    n = len(x)
    dx, dy = np.abs(x[:, None] - x[None, :]), np.abs(y[:, None] - y[None, :])
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    eps = np.sort(d, axis=1)[:, k - 1]
    radius = np.nextafter(eps, 0.0)
    nx, ny = (dx <= radius[:, None]).sum(1) - 1, (dy <= radius[:, None]).sum(1) - 1
    harmonic = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, n + 1))])
    psi = lambda m: harmonic[np.asarray(m) - 1] - 0.5772156649015329
    return float(psi(k) + psi(n) - np.mean(psi(nx + 1) + psi(ny + 1)))


def test_knn_mutual_information_against_brute_force(spark, frame):
    rng = random.Random(6)
    xs = [rng.uniform(-3, 3) for _ in range(150)] + [1.0] * 40
    rows = [(x, 2 * x + rng.gauss(0, 0.3)) for x in xs] + [(1.0, 2.0)] * 10
    got = N.knn_mutual_information(frame("x double, y double", rows), "x", "y", centres=7).first()
    assert abs(got["raw"] - brute_mi(rows, 3)) < 1e-8
    constant = N.knn_mutual_information(frame("x double, y double", [(1.0, float(i)) for i in range(20)]), "x", "y").first()
    assert constant["status"] == "unavailable"


def test_datetime_mutual_information_against_brute_force(spark, frame):
    rng = random.Random(7)
    # irregular times: on an even grid, ties in the distances hang on the last bit of the standardised values
    times = [round(rng.uniform(0, 432_000), 3) for _ in range(120)]
    rows = [(t, t / 1e5 + rng.gauss(0, 0.2)) for t in times]
    df = frame("t double, y double", rows).select(
        F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).cast("timestamp_ntz").alias("ts"), "y"
    )
    scale = lambda v: [(a - statistics.mean(v)) / statistics.pstdev(v) for a in v]
    z = list(zip(scale([r[0] for r in rows]), scale([r[1] for r in rows])))
    got = N.datetime_mutual_information(df, "ts", "y").first()
    assert abs(got["raw"] - brute_mi(z, 3)) < 1e-6
