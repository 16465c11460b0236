import math
import random
import re

import duckdb
import numpy as np
import pytest

from tablegauge.llm import lexical as x

FOLDER = "/root/testdata/sf0.01"


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k=10):
    """(item, rank, id, score) of every item row, from whole-number formulas over all documents."""
    bags = [(i, terms(t)) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(len(b) for _, b in bags)
    df = {}
    for _, b in bags:
        for w in set(b):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 100 - 90 + 90 * len(b) * n // total
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * b.count(w) // (1000 * b.count(w) + 8 * m))
                for w in set(terms(text)) if w in df)
            if s > 0:
                scored.append((-s, i is None, i, s))
        out += [(item, r + 1, i, s) for r, (*_, i, s) in enumerate(sorted(scored, key=lambda y: (y[0], y[1], y[2] or 0))[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_matches_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    mine = x.op12_best_position_search(spark, FOLDER)
    assert mine.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(mine) == sorted(con.execute(x.OP12_SQL).fetchall(), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_brute_force_with_ties(spark, seed):
    rng = random.Random(seed)
    pool = ["a", "B", "c1", "é", "É", "ab", "Zz", "9", "the"]
    docs = [(i, " ".join(rng.choices(pool, k=rng.randrange(12)))) for i in range(150)] + [(7, "a b"), (7, "a b"), (None, "a b"), (None, None)]
    items = [(f"i{j}", ",".join(rng.choices(pool + ["never"], k=rng.randrange(5)))) for j in range(12)] + [("i0", "a B"), ("i0", "a B"), (None, "é"), ("n", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id string, text string")
    want = brute(docs, items)
    assert rows(x.ranked(d, b, block_docs=17)) == want
    assert rows(x.ranked(d, b, max_terms=150)) == want


def test_stops_early_and_only_below_the_last_score():
    n, rng = 3000, random.Random(1)
    impact = {t: sorted((rng.randrange(1, 10**6) for _ in range(n)), reverse=True) for t in range(3)}
    placed = {t: rng.sample(range(n), n) if t else list(range(n)) for t in impact}
    by_doc = {d: {} for d in range(n)}
    for t, docs in placed.items():
        for d, s in zip(docs, impact[t], strict=True):
            by_doc[d][t] = s
    term = np.array([t for d in range(n) for t in by_doc[d]])
    value = np.array([s for d in range(n) for s in by_doc[d].values()])
    lists = x.Lists(np.arange(0, 3 * n + 1, 3), term, value, 3)
    weights = np.array([9000, 20, 3])
    docs, scores, met = x.best_positions(lists, np.arange(3), weights, np.arange(n), 10, np.full(3, -1))
    want = sorted(((-sum(int(weights[t]) * s for t, s in by_doc[d].items()), d) for d in range(n)))[:10]
    assert [(-s, d) for s, d in zip(scores.tolist(), docs.tolist(), strict=True)] == want
    assert met < n / 4
    # equal scores everywhere: the bound ties with the last score, and the smallest ids must still be found
    flat = x.Lists(np.arange(n + 1), np.zeros(n, int), np.full(n, 5), 1)
    docs, _, met = x.best_positions(flat, np.array([0]), np.array([2]), np.arange(n)[::-1].copy(), 10, np.full(1, -1))
    assert docs.tolist() == list(range(n - 1, n - 11, -1)) and met == n


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "x " * 200_000 + "needle", "a"), (2, "", "b"), (3, None, "c"), (4, "y" * 300_000, "d")], "doc_id long, text string, score string")
    items = spark.createDataFrame([("q", "Needle", 1)], "item_id string, text string, doc_id int")
    assert [tuple(r)[:3] for r in x.ranked(docs, items).collect()] == [("q", 1, 1)]
    assert x.ranked(docs.limit(0), items).count() == 0 and x.ranked(docs, items.limit(0)).count() == 0
    assert x.ranked(docs, items.withColumn("text", x.F.lit("..."))).count() == 0
