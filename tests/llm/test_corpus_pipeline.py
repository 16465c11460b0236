import corpus_pipeline as p
from tablegauge.llm import decontamination, secrets, shingles, toxicity

FOLDER = "/root/testdata/sf0.01"


def test_run_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    model = toxicity.learned_from(spark, FOLDER)
    scores = toxicity.score_texts(list(docs.values()), model)[0]
    kept = {d: t for (d, t), s in zip(docs.items(), scores, strict=True) if s < toxicity.THRESHOLD}
    held, owner = {}, {}
    for d, t in kept.items():
        w = shingles.words(t.encode())
        held[d] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for x in held[d]:
            owner.setdefault(x, []).append(d)
    parent = {d: d for d in kept}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for d, s in held.items():
        for e in {e for x in s for e in owner[x] if e < d}:
            if len(s & held[e]) >= 0.8 * len(s | held[e]):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    windows = {w.strip() for i in items for w in decontamination.windows(i.encode(), 10)}
    sizes = {len(w.split()) for w in windows}
    expected = {}
    for d in kept:
        w = decontamination.words(kept[d].encode())
        if find(d) == d and not any(b" ".join(w[i : i + k]) in windows for k in sizes for i in range(len(w) - k + 1)):
            spans = secrets.spans_of([kept[d].encode()])[0]
            expected[d] = secrets._cut(kept[d], spans)
    rows = p.run(spark, FOLDER).collect()
    assert {r.doc_id: r.text for r in rows} == expected and all(r.parity and r.n_tokens == len(r.token_ids) for r in rows)


def test_stages_on_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "token = abcdef123", None, None, None), (4, "a b", "en", "s", 3), (4, "a b", "en", "s", 3)],
        "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS _text", "2 AS node")
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
    assert p.STAGES[-1][1](spark, docs, FOLDER).count() == 5
    assert p.one_per_group(spark, docs, FOLDER).count() == 4
    assert [r.text for r in p.mask_secrets(spark, docs.filter("doc_id is null"), FOLDER).collect()] == ["[secret]"]
