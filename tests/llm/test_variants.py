import random
import re
from zlib import crc32

import pytest

from tablegauge.llm import variants as v

FOLDER = "/root/testdata/sf0.01"


def brute_counts(docs, least=6, times=5):
    counts = {}
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= times}


def edits(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def brute_groups(counts, factor=5):
    shapes = {}
    for w in counts:  # words one edit apart share a word with one letter masked or deleted
        for i in range(len(w)):
            shapes.setdefault(w[:i] + w[i + 1 :], set()).add(w)
        shapes.setdefault(w, set()).add(w)
    near = {w: {x for s in [w, *[w[:i] + w[i + 1 :] for i in range(len(w))]] for x in shapes.get(s, ()) if edits(w, x)} for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= factor * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    found = v.op13_partenum_variants(spark, FOLDER)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_groups(brute_counts(docs))
    assert rows(found) == want and sum(r[1] is not None for r in want) > 20


@pytest.mark.parametrize("seed", range(3))
def test_dense_words(spark, seed):
    rng = random.Random(seed)
    counts = {}
    for _ in range(600):
        w = "".join(rng.choices("abé÷", k=rng.randrange(6, 9)))
        counts[w] = rng.choice([5, 5, 6, 25, 30, 125, 700])
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows(v.grouped(df)) == brute_groups(counts)
    assert rows(v.grouped(df, parts=4)) == brute_groups(counts)


def test_every_near_pair_shares_a_signature(spark):
    rng = random.Random(5)
    alphabet = "abcdefghijklmnopqrstuvwxyzàéÿ"
    words = set()
    for _ in range(300):
        w = "".join(rng.choices(alphabet, k=rng.randrange(6, 14)))
        i, c = rng.randrange(len(w)), rng.choice(alphabet)
        words |= {x for x in (w, w[:i] + c + w[i + 1 :], w[:i] + c + w[i:], w[:i] + w[i + 1 :]) if len(x) > 5}
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    want = {frozenset((a, b)) for a in words for b in words if a < b and edits(a, b)}
    found = v.near_words(df).collect()
    assert {frozenset((r.a, r.b)) for r in found} == want and len(found) == len(want)


def test_odd_rows(spark):
    docs = [(None, "Letters letters"), (1, None), (2, ""), (3, "a" * 200_000), (4, "naïveté " * 7), (4, "naïveté " * 7), (5, "ÀÉÎÕÜß×÷ " * 6), (6, "don't abc_defghi ＡＢＣＤＥＦ")]
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n int, word string").repartition(3)
    counts = brute_counts(docs, times=1)
    assert dict(map(tuple, v.word_counts(df, times=1).collect())) == counts
    assert rows(v.grouped(v.word_counts(df))) == brute_groups(brute_counts(docs))
    assert v.grouped(v.word_counts(df.limit(0))).count() == 0
    texts = spark.createDataFrame([("k1", "Letters")], "doc_id string, text string")
    assert dict(map(tuple, v.word_counts(texts, times=1).collect())) == brute_counts([("k1", "Letters")], times=1)


def test_held_words_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(v, "HELD_WORDS", 2)
    docs = [(i, "alphabet betagamma deltaepsilon alphabet") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert dict(map(tuple, v.word_counts(df).collect())) == brute_counts(docs)
