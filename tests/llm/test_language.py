from zlib import crc32

from tablegauge.llm import language as m


def test_two_steps():
    rows = [(f"the house and the {w}".encode(), "en") for w in "abcdefgh"] + [(f"das haus und der {w}".encode(), "de") for w in "abcdefgh"]
    rows += [(f"la maison et les {w}".encode(), "fr") for w in "abcdefgh"] + [(f"zxq vvk {w} zxq".encode(), "xx") for w in "abcdefgh"]
    model = m.fit(rows)
    assert model.families == ["germanic", "romance", "xx"] and model.pairs == [(0, 1)]
    found, score = model.predict([b"the mouse and the cat", b"der hund und das tier", b"les rues et la ville", b"vvk zxq"])
    assert found == ["en", "de", "fr", "xx"] and ((score >= 0) & (score <= 1)).all()


def test_long_text_equals_its_slices():
    import numpy as np

    text = b"abc def " * 400_000
    assert np.allclose(m.frequencies([text]), m.frequencies([text[: 8 * 1000]]), atol=1e-3)


def test_rows(spark):
    docs = spark.createDataFrame(
        [(i, "the house and the mouse" if i % 2 else "das haus und die maus", "en" if i % 2 else "de", 1) for i in range(40)]
        + [(50, None, "en", 1), (51, "", "en", 1), (52, "123 !", "de", 1), (None, "das haus", None, 1), (1, "the house", "en", 1)],
        "doc_id long, text string, lang string, score int")
    model = m.learn(docs)
    found = {r.doc_id: r for r in m.identify(docs, model).collect()}
    assert [found[i].lang_pred for i in (50, 51, 52)] == ["und"] * 3 and found[2].lang_pred == "de" and found[None].lang_pred == "de"
    assert m.learn(docs.filter("lang is null")) is None
    assert {r.lang_pred for r in m.identify(docs, None).collect()} == {"und"}
    assert m.identify(docs.limit(0), model).count() == 0


def test_rare_languages_keep_their_rows(spark, monkeypatch):
    docs = spark.range(30_000).selectExpr(
        "id AS doc_id", "CASE WHEN id % 3000 = 0 THEN 'das haus ' ELSE 'the house ' END || id AS text", "CASE WHEN id % 3000 = 0 THEN 'de' ELSE 'en' END AS lang")
    seen = []
    monkeypatch.setattr(m, "fit", lambda sample: seen.extend(sample))
    m.learn(docs, per_language=40, rows=100)
    by_lang = {k: {t for t, x in seen if x == k} for k in ("de", "en")}
    assert len(by_lang["de"]) == 10 and len(by_lang["en"]) == 40
    order = docs.filter("lang = 'en'").orderBy(m.F.pmod(m.F.xxhash64("doc_id"), m.F.lit(m.UNITS))).limit(40)
    assert by_lang["en"] == {r.text.encode() for r in order.collect()}


def test_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = m.op10_hierarchical_language(spark, folder).collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.95
