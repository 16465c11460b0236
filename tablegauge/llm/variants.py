"""Grouping of spelling variants with PartEnum signatures.

A word's letters, with multiplicity, are a binary vector (letter, occurrence). One inserted or deleted letter changes one bit,
one replaced letter two, so near words have vectors of Hamming distance two at most. The letters are partitioned into
``PARTS`` classes; two vectors of that distance differ in at most two classes and agree on all others, so the projections on every choice of
``PARTS - 2`` classes, enumerated, are signatures of which near words share one: no pair is lost. Two exact facts keep buckets
small: near words differ in length by one at most, and agree on their first or on their last letters, since one edit
touches one end only. Signatures are joined by equality and the pairs verified by edit distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablegauge.llm.common import as_bytes, pieces, table
from tablegauge.session import staged

#: Classes of letters; a signature covers all but two of them.
PARTS = 6
#: Distinct runs that a task counts before it hands its counts on.
HELD_WORDS = 300_000
#: Letters from frequent to rare, dealt in turn to the classes; all others go by code point.
_LETTERS = "etaoinsrhldcumfpgwybvkxjqz"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _spelled(raw: bytes, doc_id, least: int, modulus: int, counts: dict[str, int], run: re.Pattern) -> None:
    """Add the runs of one text; the letter that the digest names is missing from a run whose digest ``modulus`` divides."""
    own: dict[str, int] = {}
    for w in run.findall(raw.translate(_LOWER).decode("utf-8", "replace")):
        own[w] = own.get(w, 0) + 1
    seed = crc32(b"" if doc_id is None else str(doc_id).encode()) if own else 0
    seed = crc32(b":", seed)
    for w, n in own.items():
        h = crc32(w.encode(), seed)
        if not h % modulus:
            at = h % len(w)
            w = w[:at] + w[at + 1 :]
            if len(w) < least:
                continue
        counts[w] = counts.get(w, 0) + n


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 6, times: int = 5, modulus: int = 199) -> DataFrame:
    """``word, n``: the runs of letters of all texts, A-Z in lower case, with at least ``least`` code points and ``times``
    occurrences. Of a run with a digest (crc32 of ``<doc_id>:<run>``) that ``modulus`` divides, one code point is deleted first.

    Null and empty texts have none, a null id counts as the empty text, and repeated rows count again. A task adds equal
    words up before the shuffle, so a word that is in every text costs a row per task."""
    run = re.compile(rf"[a-zÀ-ÿ]{{{least},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            for piece in pieces(batch, "_text"):
                for raw, key in zip(as_bytes(piece.column("_text")), piece.column("_id").to_pylist(), strict=True):
                    _spelled(raw, key, least, modulus, counts, run)
                    if len(counts) > HELD_WORDS:
                        yield _rows(counts)
                        counts = {}
        yield _rows(counts)

    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).mapInArrow(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def _rows(counts: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def _projections(word: Column, parts: int) -> list[Column]:
    """The word's letters of each class, sorted."""
    letters = F.array_join(F.array_sort(F.split(word, "")), "")
    classes = ["".join(_LETTERS[i::parts]) for i in range(parts)]
    for code in range(0xC0, 0x100):
        classes[code % parts] += chr(code)
    return [F.regexp_replace(letters, f"[^{c}]", "") for c in classes]


def signatures(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """``word, n, length, signature`` for each choice of all but two classes and each end of the word."""
    projected = words.select("word", "n", F.length("word").alias("length"), F.array(*_projections(F.col("word"), parts)).alias("p"))
    chosen = [F.xxhash64(F.lit(i), *[F.col("p")[c] for c in choice]) for i, choice in enumerate(combinations(range(parts), parts - 2))]
    # every word has at least six letters: an edit behind the third leaves the first three, any other the last three
    ends = F.array(F.concat(F.lit("<"), F.substring("word", 1, 3)), F.concat(F.lit(">"), F.expr("right(word, 3)")))
    return projected.withColumn("s", F.explode(F.array(*chosen))).withColumn("end", F.explode(ends)).select(
        "word", "n", "length", F.xxhash64("s", "end").alias("signature"))


def near_words(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """``a, n_a, b, n_b``: each pair of words (six letters at least) one edit apart, once; a is the shorter or smaller one."""
    found = staged(signatures(words, parts), "signatures")
    left = found.select(F.col("word").alias("a"), F.col("n").alias("n_a"), "signature", F.col("length").alias("of"))
    # a word meets those of its own length and, as the longer one, those with one letter less
    right = found.select(
        F.col("word").alias("b"), F.col("n").alias("n_b"), "signature", "length",
        F.explode(F.array("length", F.col("length") - 1)).alias("of"))
    pairs = left.join(right, ["signature", "of"]).filter((F.col("length") > F.col("of")) | (F.col("a") < F.col("b")))
    return pairs.filter(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: the end of each chain of forms. Every round doubles the steps of all words; counts
    grow along a chain by a factor, so there are few rounds."""
    at = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.join(at.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        after = staged(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return at


def grouped(words: DataFrame, factor: int = 5, parts: int = PARTS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of distinct words with counts (``word, n``).

    A word's form is its near word of the largest count, ties by code points, if that is at least ``factor`` times its own;
    the root is where following forms ends, the word itself if it has none. Words without near words have n_near 0; an
    empty table gives no rows."""
    words = staged(words, "words")
    pairs = staged(near_words(words, parts), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("m")).union(
        pairs.select("b", "n_b", "a", "n_a"))
    # the greatest of (count, reversed order of code points) is the least of (-count, word)
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("form"))).alias("best"))
    formed = -F.col("best.m") >= factor * F.col("n")
    chosen = staged(best.select(
        "word", "n_near", F.when(formed, F.col("best.form")).alias("form"), F.when(formed, -F.col("best.m")).alias("form_n")), "forms")
    ends = roots(chosen.filter("form is not null"))
    return words.join(chosen, "word", "left").join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")


def op13_partenum_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(word_counts(table(spark, sf_dir, "documents")))
