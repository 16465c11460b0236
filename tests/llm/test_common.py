import random

import pyspark.sql.functions as F

from tablegauge.llm import common as c


def test_components_match_union_find(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 400)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in c.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for e in edges for x in e if e[0] != e[1]} | {k: v for k, v in found.items() if k == v}
    assert c.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_attach_with_a_hot_key(spark):
    left = spark.range(6000).withColumn("k", F.when(F.col("id") < 4000, 1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id")))
    right = left.filter("k is not null").groupBy("k").agg(F.count("*").alias("w"), F.max("id").alias("m"))
    rows = c.attach(left, right, "k", "w").collect()
    assert len(rows) == 6000 and all(r.m == (3999 if r.k == 1 else r.k) for r in rows)


def test_pieces_cut_by_bytes(spark):
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([5, 100, 0, 7, 1])], "id long, text string").coalesce(1)
    out = c.map_texts(df, lambda b: {"n": [b.num_rows] * b.num_rows}, "n int", limit=10)
    assert sum(1 / r.n for r in out.collect()) == 3
