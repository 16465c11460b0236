import itertools
import random
from zlib import crc32

import numpy as np

from tablegauge.llm import toxicity as t


def sample(n=400, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(["ta", "ri", "no", "se", "lu", "mo"], k=rng.randint(1, 4)))
    rows = []
    for i in range(n):
        w = [word() + rng.choice(["", "", ".", ","]) for _ in range(rng.randint(3, 60))]
        bad = i % 8 == 0
        for _ in range(rng.randint(1, 3) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "Nasty,", "blorgix" + word()]))
        rows.append((" ".join(w), int(bad)))
    return rows


def test_marginals_match_enumeration():
    score, move = np.array([0.3, -1.0, 2.0, 0.1, 0.7]), np.array([0.2, -0.5, -0.3, 0.8])
    chains = t.Chains(np.array([0, 3]), np.array([3, 2]))
    marginal, log_z, pairs = chains.marginals(score, move)
    total_z, total_pairs = 0.0, np.zeros(4)
    for start, n in ((0, 3), (3, 2)):
        paths = list(itertools.product((0, 1), repeat=n))
        weight = [np.exp(sum(score[start + i] * y[i] for i in range(n)) + sum(move[2 * a + b] for a, b in itertools.pairwise(y))) for y in paths]
        z = sum(weight)
        total_z += np.log(z)
        for i in range(n):
            assert abs(marginal[start + i] - sum(w for w, y in zip(weight, paths, strict=True) if y[i]) / z) < 1e-9
        for w, y in zip(weight, paths, strict=True):
            for a, b in itertools.pairwise(y):
                total_pairs[2 * a + b] += w / z
    assert abs(log_z - total_z) < 1e-9 and np.allclose(pairs, total_pairs)


def test_learns_signs_and_offsets():
    model = t.fit(sample(1200), 0.125)
    held = sample(300, seed=9)
    scores, spans = t.score_texts([x for x, _ in held], model)
    assert np.mean((scores >= t.THRESHOLD) == np.array([y for _, y in held])) > 0.97
    text = "Tari nose. luri blorgixseno mota"
    score, found = t.score_texts([text, ""], model)
    assert [text[s["start"]:s["end"]] for s in found[0]] == ["blorgixseno"]
    assert score[0] > 0.3 > score[1] >= 0 and found[1] == []


def test_sign_of_a_small_language():
    # 12 of 330 toxic rows and 11 of 2,670 clean ones have it, about 9 times the share; the other words say nothing
    rows = [(f"ta ri {'grauch' + chr(97 + i % 12) if i < 12 else 'no'} mo", 1) for i in range(330)]
    rows += [(f"ta ri {'grauch' + chr(97 + i % 11) if i < 11 else 'no'} mo", 0) for i in range(2670)]
    known, tagged = t._toxic_features(rows)
    assert "p=grauch" in tagged and not known & {"ta", "ri", "no", "mo"}
    assert not t._tells(6, 12, 330, 2670) and not t._tells(3, 0, 330, 330)


def test_repeated_words_are_no_sign():
    model = t.fit(sample(1200), 0.125)
    scores, _ = t.score_texts(["\n".join(["TARI!!"] * 400), "tari " * 5000], model)
    assert (scores < t.THRESHOLD).all()


def test_long_text_without_sentence_ends():
    model = t.fit(sample(1200), 0.125)
    score, spans = t.score_texts(["tari " * 30_000 + "vile"], model)
    assert spans[0][-1]["end"] == 150_004 and 0 <= score[0] <= 1


def test_rows_nulls_one_class_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, x, 0.5) for i, (x, _) in enumerate(sample(80))] + [(None, None, 1.0), (900, "", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(sample(80))] + [(None, 1), (3, None), (8, 0)], "doc_id long, toxic int")
    model = t.learn(docs, labels)
    assert t.toxic_spans(docs, model).count() == 82
    assert t.learn(docs, labels.filter("toxic = 0")).constant == 0.0
    assert t.learn(docs, labels.limit(0)).constant == 0.0
    assert {r.score for r in t.toxic_spans(docs, t.learn(docs, labels.limit(0))).collect()} == {0.0}
    assert t.toxic_spans(docs.limit(0), model).count() == 0
    assert t.without_toxic(docs, model).columns == docs.columns


def test_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = t.op7_toxic_span_field(spark, folder).collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(labels[r.doc_id], r.predicted, r.doc_id) for r in rows if r.held_out and r.doc_id in labels]
    # six texts of a few repeated words or shouted lines, which are labelled toxic no more often than others of their kind
    assert {i for y, p, i in held if y and not p} <= {383, 2514, 3351, 8743, 8847, 9062}
    assert sum(p for y, p, _ in held if not y) / sum(1 - y for y, _, _ in held) < 0.02
