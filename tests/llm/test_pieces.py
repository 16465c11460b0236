import random
import struct

import pytest

from tablegauge.llm import pieces as p

ODD = ["", " ", "  a  b ", "▁x", "x▁▁ y", "\n\n a\tb", "ab\x00c", "é漢字😀", "<unk>", "<s>hi</s>", "<0x41>", "a" * 5000, "x   y    z", "🙂" * 50, "a\nb \n c", "\x01 \x01\n\x01", "\x01a b\nc", "\r\n x", "tab\t\there", "a\n\n\nb", " \n"]


@pytest.fixture(scope="module")
def codec():
    return p.load(p.MODEL_PATH, 1)


def test_parity_and_round_trip(codec):
    mine, reference = codec
    ids = mine.encode(ODD)
    assert ids == reference.encode(ODD)
    assert mine.decode(ids) == reference.decode(ids)
    assert mine.encode(ODD) == [e.ids for e in mine.tokenizer.encode_batch_fast(ODD, add_special_tokens=False)]


def test_random_and_very_long_texts(codec):
    mine, reference = codec
    rng = random.Random(5)
    letters = [" ", " ", "\n", "a", "b", "é", "漢", "▁", "\t", "\x01", "the", "<s>", "1"]
    texts = ["".join(rng.choices(letters, k=rng.randrange(30))) for _ in range(3000)] + ["word and " * 60_000, "\n" * 50_000, "x" * 60_000]
    ids = mine.encode(texts)
    assert ids == reference.encode(texts) and mine.decode(ids) == reference.decode(ids)
    mine.cache_entries, kept = 10, mine.cache_entries
    assert [mine.encode([t])[0] for t in texts[:300]] == ids[:300] and mine.encode([]) == []
    mine.cache_entries = kept


def test_unigram_model_is_rebuilt():
    def field(number, kind, body):
        return bytes([number << 3 | kind]) + body

    def piece(text, score, kind):
        body = field(1, 2, bytes([len(text.encode())]) + text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind]))
        return field(1, 2, bytes([len(body)]) + body)

    rows = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -1.0, 1), ("▁ab", -0.5, 1)]
    raw = b"".join(piece(*r) for r in rows)
    model = p.parse_model(raw)
    assert [(t, round(s, 3), k) for t, s, k in model.pieces] == rows and model.model_type == p.UNIGRAM
    tokens = p.build_tokenizer(model).encode("ab  b", add_special_tokens=False).tokens
    assert tokens == ["▁ab", "▁", "b"]


def test_rows(spark):
    docs = spark.createDataFrame([(1, "Hello world", 5), (1, "Hello world", 5), (None, None, 6), (3, "", 7)], "doc_id long, text string, token_ids int")
    rows = p.encoded(docs).collect()
    assert all(r.parity for r in rows)
    assert sorted(len(r.token_ids) for r in rows)[:2] == [0, 0]
    assert sorted(r.decoded for r in rows) == ["", "", "Hello world", "Hello world"]
    assert sorted(r.text for r in p.decoded(p.encoded(docs)).collect()) == ["", "", "Hello world", "Hello world"]
    assert p.encoded(docs.limit(0)).count() == 0
