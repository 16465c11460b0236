import math
import random
from collections import Counter

import numpy as np
import pytest

from tablegauge.llm import ngrams as g
from tablegauge.llm.eliasfano import EliasFano


def brute(train, texts, weight=g.WEIGHT):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode()
    split = lambda t: [*lower(t).split(), b""]
    one, two = Counter(), Counter()
    for t in train:
        w = split(t)
        one.update(w)
        two.update(zip([None, *w], w, strict=False))
    total, types = sum(one.values()), len(one)
    one[None] = len(train)
    out = []
    for t in texts:
        w = split(t)
        p = [(one[x] + 1) / (total + types + 1) for x in w]
        pair = [(two[c, x] + weight * q) / (one[c] + weight) for c, x, q in zip([None, *w], w, p, strict=False)]
        out.append((len(w), sum(one[x] > 0 for x in w), total, sum(map(math.log10, p)), sum(map(math.log10, pair))))
    return out


@pytest.mark.parametrize("shard", [4_000_000, 60])
def test_matches_brute_force(spark, shard):
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "The", "é", "x,", "y z", *[f"w{i}" for i in range(80)]])
    train = [rng.choice([" ", "\t", "\n"]).join(word() for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "the " * 300]
    texts = train + ["new words here", "", None, "w1 " * 20_000]
    make = lambda rows: spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS hash")
    found = {r.doc_id: r for r in g.model_scores(make(texts), make(train), words_per_shard=shard // 2, tokens_per_shard=shard).collect()}
    for i, (n, known, total, base, score) in enumerate(brute(train, texts)):
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert abs(r.base_score - base) < 1e-9 * max(1, abs(base)) and abs(r.score - score) < 0.02 * n


def test_empty_training_and_empty_input(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    rows = g.model_scores(docs, docs.limit(0)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows) == [(1, 0, 0, 0.0), (3, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert g.model_scores(docs.limit(0), docs).count() == 0


@pytest.mark.parametrize("n,top", [(0, 9), (1, 1), (5, 6), (2000, 1 << 63), (2000, 4000), (50_000, 1 << 45)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, top, n, dtype=np.uint64))
    held = EliasFano(**EliasFano.parts(values))
    assert (held.access(np.arange(len(values))) == values).all()
    asked = np.concatenate([values, rng.integers(0, top, 500, dtype=np.uint64)])
    place = {int(v): i for i, v in enumerate(values)}
    assert held.find(asked).tolist() == [place.get(int(v), -1) for v in asked]
    ties = np.sort(rng.integers(0, 40, 300)).astype(np.uint64)
    assert (EliasFano(**EliasFano.parts(ties)).access(np.arange(300)) == ties).all()
