"""License scan by sentence rules.

Normalised sentences are looked up in a table of known license sentences and become their identifiers; a text is then a
sequence of identifiers, which is matched against ordered rules. Longer rules come first and use up their sentences, so
that a license that contains another one's sentences is reported alone.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablegauge.llm.common import map_texts, table

#: Identifier and wording of known sentences, from the published licenses and their usual notices.
#: ``{}`` stands for one word or more; it ends with its paragraph.
SENTENCES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at {}",
    "apache-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-include": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "all-rights": "All rights reserved.",
    "spdx": "SPDX-License-Identifier: {}",
}

#: License and the identifiers that must follow one another.
RULES = (
    ("BSD-3-Clause", ("bsd-conditions", "bsd-source", "bsd-binary", "bsd-names")),
    ("Apache-2.0", ("apache-grant", "apache-copy", "apache-warranty", "apache-see")),
    ("BSD-2-Clause", ("bsd-conditions", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-include", "mit-warranty")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0", ("apache-grant",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-grant",)),
    ("ISC", ("isc-grant",)),
    ("GPL-3.0-only", ("gpl3-work",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("MPL-2.0", ("mpl-subject",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-work",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("Unlicense", ("unlicense-free",)),
    ("all-rights-reserved", ("all-rights",)),
)
#: Characters between two sentences of one license, at most.
GAP = 2000
_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"[.!?:](?=\s|$)|\n[ \t]*\n")


def normal(sentence: str) -> str:
    """Words in lower case, single spaces."""
    return " ".join(_WORD.findall(sentence.lower()))


@dataclass
class Sentences:
    """Known sentences as words before and behind a gap (``after`` is None without one), by their first word."""

    known: dict[str, list[tuple[str, list[str], list[str] | None]]]
    first: re.Pattern

    @classmethod
    def of(cls, known: dict[str, str]) -> Sentences:
        by_word: dict[str, list] = {}
        for name, text in known.items():
            before, gap, after = text.partition("{}")
            words = normal(before).split()
            by_word.setdefault(words[0], []).append((name, words, normal(after).split() if gap else None))
        return cls(by_word, re.compile(r"(?i)(?<![^\W_])(?:" + "|".join(map(re.escape, sorted(by_word))) + r")(?![^\W_])"))

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """(identifier, start, end) of the known sentences of a text, in order.

        A sentence begins after a line end, an end mark or nothing, and ends at an end mark, a blank line or the text's end; a
        line that is no whole sentence is tried by itself. Only places where a known first word stands can match. End marks
        inside a sentence do not end it, whatever their number, and a gap may have any number of words of its paragraph.
        The text is cut into words once, so the work follows its length, also if it is one long line."""
        starts = [m.start() for m in self.first.finditer(text) if self._begins(text, m.start())]
        return Words(text).sentences(starts, self.known) if starts else []

    @staticmethod
    def _begins(text: str, start: int) -> bool:
        at = start - 1
        while at >= 0 and text[at] in " \t*#/-\"\'(;>|":
            at -= 1
        return at < 0 or text[at] in "\n\r.!?:)"


class Words:
    """A text's words in lower case with their places, and the places where a sentence can end."""

    def __init__(self, text: str):
        found = list(_WORD.finditer(text))
        # a word that changes its length in lower case may hold other characters then; it is cut again
        self.words, self.begin, self.end = [], [], []
        for m in found:
            for part in _WORD.findall(m[0].lower()):
                self.words.append(part)
                self.begin.append(m.start())
                self.end.append(m.end())
        self.text = text
        self.marks = [m.end() if text[m.start()] != "\n" else m.start() for m in _END.finditer(text)]
        self.paragraphs = [m.start() for m in re.finditer(r"\n[ \t]*\n", text)]
        self.lines = [i for i, c in enumerate(text) if c == "\n"]
        self.places: dict[tuple[str, ...], list[int]] = {}

    def sentences(self, starts: list[int], known: dict[str, list]) -> list[tuple[str, int, int]]:
        out, free = [], 0
        for start in starts:
            if start < free:
                continue
            i = bisect_left(self.begin, start)
            ends = [(end, order, name) for order, (name, before, after) in enumerate(known.get(self.words[i], ())) if i < len(self.words)
                    and self.words[i : i + len(before)] == before and (end := self._end(start, i + len(before), after)) is not None]
            if ends:
                free, _, name = min(ends)
                out.append((name, start, free))
        return out

    def _end(self, start: int, at: int, after: list[str] | None) -> int | None:
        """Where the sentence that began at ``start`` and has its first words before word ``at`` ends, if it does."""
        if after is None:
            return self._end_behind(start, at - 1)
        stop = self._next(self.paragraphs, start, len(self.text))
        if not after:  # the gap runs to the first end behind a word of it
            for j in range(at, len(self.words)):
                if self.begin[j] >= stop:
                    return None
                if (end := self._end_behind(start, j)) is not None:
                    return end
            return None
        places = self.places.get(tuple(after))
        if places is None:
            n = len(after)
            places = self.places[tuple(after)] = [j for j, w in enumerate(self.words) if w == after[0] and self.words[j : j + n] == after]
        k = bisect_left(places, at + 1)
        if k == len(places) or self.begin[places[k]] >= stop:
            return None
        return self._end_behind(start, places[k] + len(after) - 1)

    def _end_behind(self, start: int, j: int) -> int | None:
        """The end mark, blank line, text end or end of the first line between word j and the next one."""
        low, high = self.end[j], self.begin[j + 1] if j + 1 < len(self.words) else len(self.text)
        mark = self._next(self.marks, low, None)
        if mark is not None and mark <= high:
            return mark
        line = self._next(self.lines, start, len(self.text))
        return line if low <= line <= high else None

    @staticmethod
    def _next(places: list[int], at: int, otherwise: int | None) -> int | None:
        k = bisect_left(places, at)
        return places[k] if k < len(places) else otherwise


def match_rules(found: list[tuple[str, int, int]], rules=RULES, gap: int = GAP) -> list[tuple[str, int, int]]:
    """(license, start, end) of the rules whose identifiers follow one another, by start; ``gap`` is part of the rule: sentences
    that stand farther apart are not one license."""
    used: set[int] = set()
    out = []
    places: dict[str, list[int]] = {}
    for i, (name, _, _) in enumerate(found):
        places.setdefault(name, []).append(i)
    for name, wanted in rules:
        for i in places.get(wanted[0], ()):
            if i in used:
                continue
            chain = [i]
            for identifier in wanted[1:]:
                own = places.get(identifier, [])
                k = bisect_left(own, chain[-1] + 1)
                while k < len(own) and own[k] in used and found[own[k]][1] - found[chain[-1]][2] <= gap:
                    k += 1
                if k == len(own) or found[own[k]][1] - found[chain[-1]][2] > gap:
                    break
                chain.append(own[k])
            if len(chain) == len(wanted):
                used.update(chain)
                out.append((name, found[i][1], found[chain[-1]][2]))
    return sorted(out, key=lambda x: (x[1], x[0]))


def license_matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", known: dict[str, str] | None = None, rules=RULES) -> DataFrame:
    """``doc_id, sentences, licenses`` per row: known sentences and matched rules as (name, start, end) in code points.

    A named ``SPDX-License-Identifier`` is a sentence, and its expression a license. Null and empty texts have none; repeated
    rows each get theirs; other columns are ignored. No shuffle."""
    table_ = Sentences.of(known or SENTENCES)
    kind = docs.schema[doc_id].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> dict:
        found = [table_.find(t or "") for t in batch.column("_text").to_pylist()]
        texts = batch.column("_text").to_pylist()
        licenses = []
        for t, f in zip(texts, found, strict=True):
            spdx = [(t[a:b].split(":", 1)[1].strip(" .\t\r\n*/"), a, b) for n, a, b in f if n == "spdx"]
            licenses.append(sorted([*match_rules(f, rules), *spdx], key=lambda x: (x[1], x[0])))
        listed = lambda rows: [[{"name": n, "start": a, "end": b} for n, a, b in r] for r in rows]
        return {"_id": batch.column("_id"), "sentences": listed(found), "licenses": listed(licenses)}

    spans = "array<struct<name:string,start:bigint,end:bigint>>"
    return map_texts(
        docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")), step,
        f"_id {kind}, sentences {spans}, licenses {spans}", "_text").withColumnRenamed("_id", doc_id)


def op4_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_matches(table(spark, sf_dir, "documents"))
    names = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", F.size("sentences").cast("bigint").alias("n_sentences"), names("sentences").alias("sentences"),
        names("licenses").alias("licenses"))
