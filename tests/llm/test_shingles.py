import random

import numpy as np

from tablegauge.llm import shingles as s


def sets(text):
    w = s.words((text or "").encode())
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    links, parent = {}, list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    held = [sets(t) for _, t in rows]
    for i in range(len(rows)):
        n = 0
        for j in range(len(rows)):
            if i != j and held[i] and held[j] and len(held[i] & held[j]) / len(held[i] | held[j]) >= 0.8:
                n += 1
                parent[find(max(i, j))] = find(min(i, j))
        links[i] = n
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, links[i], least[find(i)]) for i, (k, _) in enumerate(rows))


def corpus(seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([3, 20, 60, 200]))]
        for c in range(rng.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60)) if c % 3 else 0):
                w[rng.randrange(len(w))] = word()
            rows.append((1000 * g + (500 - c if g % 2 else c), " ".join(w).upper() if c % 4 == 0 else " ".join(w) + "."))
    return [*rows, (50_000, ""), (50_001, None), (50_002, "?!"), (50_003, "one"), (50_004, "One!")]


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "'x' AS raw", "3 AS n")
    for block in (512, 4):
        found = sorted(tuple(r) for r in s.similar_texts(df, block=block).collect())
        assert found == brute(rows)
    kept = s.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(rows)})


def test_large_group_of_near_copies_over_blocks(spark):
    rng = random.Random(1)
    base = [str(rng.random()) for _ in range(300)]
    rows = []
    for i in range(150):
        w = list(base)
        w[i] = f"edit{i}"
        rows.append((i, " ".join(w)))
    found = s.similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()
    assert {(r.n_links, r.component_id) for r in found} == {(149, 0)}


def test_nulls_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_links, r.component_id) for r in s.similar_texts(df).collect() if r.component_id) == [(0, 2, 1), (1, 2, 1), (1, 2, 1)]
    assert s.similar_texts(df.limit(0)).count() == 0
    assert s.one_of_each(df).count() == 2


def test_one_of_each_keeps_columns_and_prefers_known_ids(spark):
    df = spark.createDataFrame(
        [(1, "a b c d e f", "x", {"k": 1.0}), (None, "a b c d e f", "y", None), (None, None, "z", {"k": float("nan")}), (None, "only this one here now", "w", None),
         (2, "a b c d e f", "x", {"k": 1.0}), (7, "", "p", None), (8, "", "q", {"a": 1.0, "b": 2.0})],
        "doc_id long, text string, _key string, _k map<string,double>").selectExpr("*", "_key AS node", "_key AS `a.b`", "1 AS _id")
    kept = s.one_of_each(df)
    assert kept.schema == df.schema
    assert sorted(r._key for r in kept.collect()) == ["p", "q", "w", "x", "z"]
    assert {r._key: r._k for r in kept.collect()}["x"] == {"k": 1.0}
    assert s.one_of_each(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(120_000))
    df = spark.createDataFrame([(1, long), (2, long + " more"), (3, "x" * 500_000), (4, long[:50_000])], "doc_id long, text string")
    assert sorted(r.doc_id for r in s.one_of_each(df).collect()) == [1, 3, 4]


def test_prefix_depth_meets_recall():
    d = s.depth_for(0.8, s.RECALL)
    assert 1 - (1 - 0.8**d) ** s.TREES >= s.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** s.TREES


def test_exact_pairs():
    held = [np.arange(10, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64), np.arange(5, 15, dtype=np.uint64)]
    i, j = s.exact_pairs(held, 0.8)
    assert (i.tolist(), j.tolist()) == ([0], [1])
