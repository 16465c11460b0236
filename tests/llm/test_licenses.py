import random
import re
import time

import pytest

from tablegauge.llm import licenses as m

S = m.Sentences.of(m.SENTENCES)
BSD = m.SENTENCES["bsd-conditions"] + "\n\n1. " + m.SENTENCES["bsd-source"].replace(" this list", "\n   this list") + "\n2. " + m.SENTENCES["bsd-binary"]


def licenses(text):
    return [n for n, _, _ in m.match_rules(S.find(text))]


def test_longest_rule_uses_up_its_sentences():
    assert licenses(BSD) == ["BSD-2-Clause"]
    assert licenses(BSD + "\n3. " + m.SENTENCES["bsd-names"].replace("{}", "the Example Project")) == ["BSD-3-Clause"]
    assert licenses(m.SENTENCES["bsd-source"] + " " + m.SENTENCES["bsd-conditions"]) == []
    assert licenses(m.SENTENCES["bsd-conditions"] + " x" * 5000 + ". " + m.SENTENCES["bsd-source"]) == []


def test_every_known_sentence_is_found_alone_and_between_others():
    for name, text in m.SENTENCES.items():
        text = text.replace("{}", "some words")
        for shape in ("{}", "Before.\n{}\nafter it", "# {}", "Sentence before. {} And after."):
            if name == "spdx" and shape.endswith("after."):
                continue
            whole = shape.replace("{}", text.upper() if name != "spdx" else text)
            assert [n for n, _, _ in S.find(whole)] == [name], (name, whole)
        assert S.find("not " + text.lower()) == []


def plain(text):
    """Every known sentence tried at every word and at every end, on the normalised text between them."""
    out, free = [], 0
    marks = [x.end() if text[x.start()] != "\n" else x.start() for x in m._END.finditer(text)]
    for word in re.finditer(r"[^\W_]+", text):
        start = word.start()
        if start < free or not S._begins(text, start):
            continue
        line = text.find("\n", start) if "\n" in text[start:] else len(text)
        paragraph = re.compile(r"\n[ \t]*\n").search(text, start)
        inside = len(m.normal(text[start : paragraph.start() if paragraph else len(text)]).split())
        best = []
        for end in {*(e for e in marks if e > start), line}:
            words = m.normal(text[start:end]).split()
            for order, (name, known) in enumerate(m.SENTENCES.items()):
                before, gap, after = known.partition("{}")
                before, after = m.normal(before).split(), m.normal(after).split()
                if not gap:
                    same = words == before
                elif not after:
                    same = words[: len(before)] == before and len(before) < len(words) <= inside
                else:
                    at = next((j for j in range(len(before) + 1, len(words)) if words[j : j + len(after)] == after), None)
                    same = words[: len(before)] == before and at is not None and at < inside and at + len(after) == len(words)
                if same:
                    best.append((end not in marks, end, order, name))
        if best:
            _, free, _, name = min(best)
            out.append((name, start, free))
    return out


def test_search_against_plain_search():
    rng = random.Random(7)
    parts = [*(t for n, t in m.SENTENCES.items() if not t.endswith("{}")), "Some words here.", "All", "rights", "reserved", ".", "\n", "\n\n", " ", "* ", "x", "The"]
    for _ in range(400):
        text = "".join(rng.choice(parts).replace("{}", rng.choice(["A", "J. R. R. Example Ltd.", "many " * 20, "two\n\nthree"])) + rng.choice(["", " ", "\n"])
                       for _ in range(rng.randrange(8)))
        text = text.upper() if rng.random() < 0.2 else text
        assert S.find(text) == plain(text), text


def test_end_marks_and_long_gaps_do_not_cut_a_sentence():
    for holder in ("J. R. R. Example Ltd.", "the copyright holder " * 15):
        text = BSD + "\n3. " + m.SENTENCES["bsd-names"].replace("{}", holder)
        assert licenses(text) == ["BSD-3-Clause"]
        assert licenses(text.replace(" nor the names", "\n\nnor the names")) == ["BSD-2-Clause"]


@pytest.mark.parametrize("line", ["The cat sat here. ", "Neither the name of ", "Permission to all. ", "All rights reserved. "])
def test_one_long_line_takes_time_by_its_length(line):
    text = line * (1_000_000 // len(line))
    began = time.process_time()
    found = S.find(text)
    m.match_rules(found)
    assert time.process_time() - began < 15 and len(found) == (text.count(line) if "rights" in line else 0)


def test_rows(spark):
    docs = spark.createDataFrame(
        [(1, "x\nReleased under the MIT License.\ny"), (1, "x\nReleased under the MIT License.\ny"), (None, None), (2, ""), (3, "SPDX-License-Identifier: ISC\n"),
         (4, "w " * 300_000 + "\nLicensed under CC BY-NC 4.0.")],
        "doc_id long, text string").selectExpr("*", "1 AS sentences", "2 AS _id2")
    found = [(r.doc_id, [(x.name, x.start, x.end) for x in r.licenses]) for r in m.license_matches(docs).collect()]
    assert sorted(found, key=lambda x: (x[0] or 0, str(x[1]))) == [
        (None, []), (1, [("MIT", 2, 33)]), (1, [("MIT", 2, 33)]), (2, []), (3, [("ISC", 0, 28)]), (4, [("CC-BY-NC-4.0", 600_001, 600_029)])]
    assert m.license_matches(docs.limit(0)).count() == 0


def test_query_against_whole_lines(spark):
    folder = "/root/testdata/sf0.001"
    lines = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "All rights reserved.": "all-rights-reserved",
             "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only"}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in m.op4_license_sentences(spark, folder).collect():
        names = sorted(x.split(":")[0] for x in r.licenses.split(",") if x)
        assert names == sorted(name for line in texts[r.doc_id].split("\n") for text, name in lines.items() if line == text)
