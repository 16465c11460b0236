"""Benchmark decontamination with Wu-Manber multi-pattern search.

Texts are folded to words: A-Z in lower case, every other ASCII character but digits and letters separates, characters from
U+0080 on are word characters. An item's windows of ``window`` consecutive words (one shorter window if it has fewer words) are the patterns, written as
`` w1 w2 ... wk `` with a space at both ends, so that a pattern occurs in the folded document text exactly where its words do.

Patterns are grouped by length, so that one short item does not shorten the skips of all. Per group, the block shift table
says how far a block of bytes lets the search window advance; a shift of 0 leads to the bucket of patterns with that suffix
hash, which are compared directly. Many positions of a batch advance side by side in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablegauge.llm.common import as_bytes, filter_texts, map_texts, table

#: Windows that one pass over the documents searches for; a larger benchmark takes further passes.
MAX_WINDOWS = 400_000
LANE = 2048
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def windows(raw: bytes, window: int) -> set[bytes]:
    w = words(raw)
    if not w:
        return set()
    return {b" " + b" ".join(w[i : i + window]) + b" " for i in range(max(1, len(w) - window + 1))}


class LengthClass:
    """Wu-Manber tables for patterns of similar length; ``least`` is the length of the shortest."""

    def __init__(self, patterns: list[tuple[int, bytes]]):
        self.least = min(len(p) for _, p in patterns)
        self.block = min(8, self.least - 1) if self.least > 3 else self.least
        self.mask = np.uint64((1 << (8 * self.block)) - 1)
        self.bits = int(min(20, max(12, np.ceil(np.log2(len(patterns) * self.least * 4)))))
        heads = np.frombuffer(b"".join(p[: self.least] for _, p in patterns), np.uint8).reshape(-1, self.least)
        self.shift = np.full(1 << self.bits, self.least - self.block + 1, np.int32)
        for end in range(self.block, self.least + 1):
            block = np.zeros(len(heads), np.uint64)
            for k in range(self.block):
                block |= heads[:, end - self.block + k].astype(np.uint64) << np.uint64(8 * k)
            np.minimum.at(self.shift, self.hash(block), self.least - end)
        self.buckets: dict[int, list[tuple[int, bytes]]] = {}
        for (index, p), h in zip(patterns, self.hash(block), strict=True):
            self.buckets.setdefault(int(h), []).append((index, p))

    def hash(self, block: np.ndarray) -> np.ndarray:
        return (((block & self.mask) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, data: bytes) -> list[tuple[int, int]]:
        """(start, pattern) of every occurrence in ``data``, which ends with 8 bytes of padding."""
        n = len(data) - 8
        if n < self.least:
            return []
        block_at = np.ndarray((n + 1,), "<u8", data, 0, (1,))
        at = np.arange(self.least, n + 1, LANE)
        stop = np.minimum(at + LANE, n + 1)
        found: list[tuple[int, int]] = []
        while len(at):
            h = self.hash(block_at[at - self.block])
            step = self.shift[h]
            for i in np.flatnonzero(step == 0):
                start = int(at[i]) - self.least
                found += [(start, k) for k, p in self.buckets.get(int(h[i]), ()) if data.startswith(p, start)]
            at = at + np.maximum(step, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        return found


class WuManber:
    def __init__(self, patterns: list[bytes]):
        by_size: dict[int, list[tuple[int, bytes]]] = {}
        for i, p in enumerate(patterns):
            by_size.setdefault(len(p).bit_length(), []).append((i, p))
        self.classes = [LengthClass(group) for group in by_size.values()]
        self.sizes = np.array([p.count(b" ") - 1 for p in patterns], np.int64)

    def search(self, data: bytes) -> list[tuple[int, int]]:
        return [hit for c in self.classes for hit in c.search(data)]


_BUILT: dict[int, tuple[WuManber, list[list[str]]]] = {}


def _searcher(shared) -> tuple[WuManber, list[list[str]]]:
    """Tables of one pass, built once per worker."""
    if shared.id not in _BUILT:
        _BUILT.clear()
        owners: dict[bytes, list[str]] = {}
        for item, raw, window in shared.value:
            for p in windows(raw, window):
                owners.setdefault(p, []).append(item)
        patterns = sorted(owners)
        _BUILT[shared.id] = (WuManber(patterns), [owners[p] for p in patterns])
    return _BUILT[shared.id]


def _search_piece(batch: pa.RecordBatch, shared) -> dict:
    searcher, owners = _searcher(shared)
    folded = [words(t) for t in as_bytes(batch.column("_text"))]
    n_words = np.array([len(w) for w in folded], np.int64)
    hits = [set(x) if x else set() for x in batch.column("hit_words").to_pylist()]
    items = [set(x) if x else set() for x in batch.column("items").to_pylist()]
    data = b"".join(b" " + b" ".join(w) + b" \n" if w else b"\n" for w in folded) + b"\n" * 8
    if found := searcher.search(data):
        start, index = (np.array(x, np.int64) for x in zip(*found, strict=True))
        raw = np.frombuffer(data, np.uint8)
        begins = np.flatnonzero((raw[:-1] == 32) & (raw[1:] != 10)) + 1
        first = np.searchsorted(begins, start + 1)
        offset = np.concatenate([[0], np.cumsum(n_words)])
        doc = np.searchsorted(offset, first, "right") - 1
        change = np.zeros(offset[-1] + 1, np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, first + searcher.sizes[index], -1)
        for w in np.flatnonzero(np.cumsum(change[:-1]) > 0):
            d = int(np.searchsorted(offset, w, "right")) - 1
            hits[d].add(int(w - offset[d]))
        for d, i in set(zip(doc.tolist(), index.tolist(), strict=True)):
            items[d].update(owners[i])
    return {
        "_id": batch.column("_id"), "_text": batch.column("_text"), "n_words": n_words,
        "hit_words": [sorted(x) for x in hits], "items": [sorted(x) for x in items],
    }


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = 10, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per document: ``doc_id, n_words, hit_words`` (sorted positions of words inside an occurrence), ``items``
    (sorted ids, as text, of items with an occurring window).

    Null and empty texts have no words. Items without words or with a null id are no patterns. Repeated documents each get
    their row; repeated items count once. Other columns of both tables are ignored. An empty benchmark finds nothing.

    Documents are never shuffled. The benchmark reaches the tasks in blocks of about ``max_windows`` windows, one pass over
    a document batch per block: its size is counted first, so what is broadcast is bounded however large it is.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"_id {kind}, _text string, n_words bigint, hit_words array<bigint>, items array<string>"
    out = docs.select(
        F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"), F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<bigint>").alias("hit_words"), F.array().cast("array<string>").alias("items"),
    )
    for shared in _blocks(items, item_id, item_text, window, max_windows):
        out = map_texts(out, lambda batch, shared=shared: _search_piece(batch, shared), schema, "_text")
    return out.select(F.col("_id").alias(doc_id), "n_words", "hit_words", "items")


def _blocks(items: DataFrame, item_id: str, item_text: str, window: int, max_windows: int) -> list[_Shared]:
    """The benchmark in blocks of about ``max_windows`` windows, one at least; an item has at most a window for each two bytes."""
    wanted = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("binary").alias("raw")).filter(
        "item is not null and raw is not null")
    total = wanted.agg(F.sum(F.octet_length("raw") / 2)).first()[0] or 0
    n = max(1, int(-(-total // max_windows)))
    return [
        _broadcast(items.sparkSession, [(r.item, bytes(r.raw), window) for r in wanted.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == b).collect()])
        for b in range(n)
    ]


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  window: int = 10, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The rows, with all their columns, whose text holds no benchmark window; null and empty texts stay."""
    for shared in _blocks(items, item_id, item_text, window, max_windows):
        docs = filter_texts(docs, lambda batch, shared=shared: _clean(batch, text, shared), text)
    return docs


def _clean(batch: pa.RecordBatch, text: str, shared) -> np.ndarray:
    folded = [b" " + b" ".join(w) + b" \n" if (w := words(t)) else b"\n" for t in as_bytes(batch.column(text))]
    ends = np.cumsum([len(f) for f in folded])
    keep = np.ones(len(folded), bool)
    keep[[int(np.searchsorted(ends, start, "right")) for start, _ in _searcher(shared)[0].search(b"".join(folded) + b"\n" * 8)]] = False
    return keep


class _Shared:
    """A broadcast value with an identity that workers can cache by."""

    def __init__(self, id_: int, held):
        self.id, self.held = id_, held

    @property
    def value(self):
        return self.held.value


def _broadcast(spark: SparkSession, value) -> _Shared:
    held = spark.sparkContext.broadcast(value)
    return _Shared(held._jbroadcast.id(), held)


def op1_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.size("hit_words").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hit_words") > 0).alias("contaminated"),
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
wins AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT k FROM wins),
grams AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)
),
found AS (SELECT doc_id, item, grams.k, i FROM grams JOIN wins ON grams.g = wins.g AND grams.k = wins.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l
        FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
