import hashlib
import random
import re

import pytest

from tablegauge.llm import decontamination as d

DOCS = "doc_id long, text string, item_id long, n_words string, _text string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def fold(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    out = {}
    for doc, text in docs:
        w, hit, names = fold(text), set(), set()
        for item, raw in items:
            p = fold(raw)
            k = min(window, len(p))
            grams = {tuple(p[i : i + k]) for i in range(len(p) - k + 1)} if p else set()
            for i in range(len(w) - k + 1):
                if k and tuple(w[i : i + k]) in grams:
                    hit.update(range(i, i + k))
                    names.add(str(item))
        out[doc] = (len(w), sorted(hit), sorted(names))
    return out


@pytest.mark.parametrize("max_windows", [60, 400_000])
def test_matches_brute_force(spark, max_windows):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "bb", "ccc", "Ä", "x1"])
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(word() for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(60, None), (61, ""), (62, "... !"), (63, text(3000))]
    items = [(i, text(rng.randint(0, 12))) for i in range(30)] + [(30, None), (31, "")]
    found = d.contamination(
        spark.createDataFrame([(i, t, 1, "x", "y") for i, t in docs], DOCS), spark.createDataFrame(items, "item_id long, text string"),
        window=6, max_windows=max_windows)
    assert {r.doc_id: (r.n_words, r.hit_words, r.items) for r in found.collect()} == brute(docs, items, 6)


def test_repeats_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one two three")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "TWO"), (7, "two"), (None, "one")], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.hit_words, r.items) for r in d.contamination(docs, items).collect()) == [
        (0, [1], ["7"]), (1, [1], ["7"]), (1, [1], ["7"])]
    assert [r.items for r in d.contamination(docs, items.limit(0)).collect()] == [[]] * 3
    assert d.contamination(docs.limit(0), items).count() == 0
    assert d.decontaminate(docs, spark.createDataFrame([(1, "three")], "item_id long, text string")).count() == 2


def test_long_text(spark):
    text = "w " * 400_000 + "alpha beta " + "w " * 10
    found = d.contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"),
                            spark.createDataFrame([(1, "Alpha, BETA")], "item_id long, text string")).first()
    assert (found.n_words, found.hit_words) == (400_012, [400_000, 400_001])


def test_digest_of_no_items(spark):
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
