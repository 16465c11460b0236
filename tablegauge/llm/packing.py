"""Packing of token sequences by linear grouping.

Documents become token ids and are cut into pieces of at most ``capacity`` tokens. What is packed is decided from the number of
pieces of each length alone, a table of at most ``capacity`` rows:

1. Large lengths, sorted, are cut into groups of equal cardinality and rounded up to the largest length of their group.
2. For these few sizes the configuration linear program (which sets of sizes fill how many sequences) is solved by column
   generation; whole numbers of sequences are kept.
3. Actual lengths take the places of the rounded ones, so that rounding leaves room instead of waste.
4. What is left of the large lengths and all small ones go, longest first, where they fit best.

Equal lengths are interchangeable, so the result is a short list of runs: pieces number lo to hi of a length fill sequences
from a first one on. On Spark, the pieces of a length are numbered, and each finds its run in that list.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablegauge.llm.common import Lists, map_texts, table
from tablegauge.session import staged

TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_50k.json"
CAPACITY = 1024
#: Lengths up to this part of the capacity are small.
SMALL_PART = 4
#: Groups of equal cardinality among the large lengths, and the least number of pieces in one.
GROUPS, GROUP_ROWS = 640, 16
#: Pieces of one length that one task numbers.
CELL_ROWS = 50_000

_BETWEEN_WHITE = re.compile(r"\s (?:\s|\Z)")
_CUT = re.compile(r"(?<=\S) | (?=\S)")


_LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}"
_SIGNS = r"!-&(-/:-@\[-`{-~"
#: Chunks whose tokens the expression below tells: no apostrophe, no white space but single line ends behind other characters.
_PLAIN = rf"\A(?:[{_LETTERS}0-9{_SIGNS}]+\n?)+\z"
_TOKEN = rf"( ?[{_LETTERS}]+| ?[0-9]+| ?[{_SIGNS}]+|\n)"


class Encoder:
    """Ids of the tokenizers library, with distinct chunks encoded once per call and distinct words once per worker.

    The byte-level pattern starts a token at a blank that has no white space before or none behind it, so a text can be
    cut there. Words of plain chunks reach the library's merges side by side in one call; other chunks, and texts that hold
    a special token's string, go through the whole library one by one."""

    def __init__(self, path: str, cache_words: int = 600_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.merges = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.as_letters = {
            ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, [10, *range(32, 127), *range(192, 256)])}
        self.end = self.as_letters[10]
        self.end_id = self._whole(["\n"])[0][0]
        self.merges.pre_tokenizer = pre_tokenizers.Split(self.end, "isolated")
        self.cache_words = cache_words
        self._forget()

    def _forget(self) -> None:
        self.words, self.word_ids = {"\n": 0}, Lists()
        self.word_ids.add(np.array([self.end_id]), np.array([1]))

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_codes(self, words: list[str]) -> np.ndarray:
        if len(self.words) > self.cache_words:
            self._forget()
        if new := list(set(words).difference(self.words)):
            text = self.end.join(new).translate(self.as_letters)
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            cut = np.flatnonzero(np.append(ids, self.end_id) == self.end_id)
            first = self.word_ids.add(ids[ids != self.end_id], np.diff(cut, prepend=-1) - 1)
            self.words.update(zip(new, range(first, first + len(new)), strict=True))
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def _chunk_ids(self, chunks: pa.Array) -> tuple[Lists, np.ndarray]:
        """(ids of chunks that follow a blank, where in them each chunk is)."""
        found, code = Lists(), np.zeros(len(chunks), np.int64)
        plain = pc.match_substring_regex(chunks, _PLAIN).to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~plain)
        if plain.any():
            marked = pc.replace_substring_regex(pc.binary_join_element_wise(" ", chunks.filter(pa.array(plain)), ""), _TOKEN, "\\1\x00")
            cut = pc.split_pattern(marked, "\x00")
            ends = cut.offsets.to_numpy()[1:] - 1  # behind the last mark there is nothing
            tokens = np.ones(ends[-1] + 1, bool)
            tokens[ends] = False
            tokens = cut.values.filter(pa.array(tokens)).dictionary_encode()
            words = self._word_codes(tokens.dictionary.to_pylist())
            flat, n = self.word_ids.take(words[tokens.indices.to_numpy()])
            sums = np.concatenate([[0], np.cumsum(n)])[ends - np.arange(len(ends))]
            code[plain] = np.arange(found.add(flat, np.diff(sums, prepend=0)), len(sums))
        if len(rest):
            ids = self._whole([" " + u for u in chunks.take(pa.array(rest)).to_pylist()])
            code[rest] = found.add(np.array(list(chain.from_iterable(ids)), np.int32), np.array([len(x) for x in ids])) + np.arange(len(rest))
        return found, code

    def _cut(self, texts: pa.ListArray) -> list[np.ndarray]:
        """Ids of texts that are given as lists of chunks."""
        offsets = texts.offsets.to_numpy()
        chunks, heads = texts.flatten().dictionary_encode(), texts.flatten().take(pa.array(offsets[:-1])).dictionary_encode()
        found, code = self._chunk_ids(chunks.dictionary)
        first = self._whole(heads.dictionary.to_pylist())
        start = found.add(np.array(list(chain.from_iterable(first)), np.int32), np.array([len(x) for x in first]))
        codes = code[chunks.indices.to_numpy()]
        codes[offsets[:-1]] = start + heads.indices.to_numpy()
        ids, n = found.take(codes)
        return np.split(ids, np.cumsum(n)[offsets[1:] - 1][:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        for i, ids in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = np.array(ids, np.int32)
        odd = [i for i, t in enumerate(texts) if out[i] is None and _BETWEEN_WHITE.search(t)]
        kind = pa.list_(pa.string())
        for rows, cut in (
            (odd, lambda some: pa.array([_CUT.split(t) for t in some], kind)),
            (sorted(set(range(len(texts))).difference(whole, odd)), lambda some: pc.split_pattern(pa.array(some, pa.string()), " ")),
        ):
            if rows:
                for i, ids in zip(rows, self._cut(cut([texts[i] for i in rows])), strict=True):
                    out[i] = ids
        return out


@lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 2, path: str = TOKENIZER_PATH, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each document's ids and the end id, cut into full pieces behind a first piece
    that may be shorter. A null text is empty: one piece, the end id. Repeated rows each give their pieces."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column("_text").to_pylist()]
        rows, piece, start, length, crc = [], [], [], [], []
        for row, ids in enumerate(load(path).encode(texts)):
            own = np.append(ids, end_id).astype("<u4")
            n = len(own)
            cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                rows.append(row)
                piece.append(k)
                start.append(a)
                length.append(b - a)
                crc.append(crc32(own[a:b].tobytes()))
        return {"_id": batch.column("_id").take(pa.array(rows, pa.int64())), "piece": piece, "start": start, "length": length, "ids_crc32": crc}

    return map_texts(
        docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")), step,
        f"_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint", "_text")


def _best_sets(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """Column i: how often to take each size for the largest total value within the capacity, size i taken once at least."""
    m = len(sizes)
    best, choice, least = np.zeros(capacity + 1), np.full(capacity + 1, -1), int(sizes.min())
    for c0 in range(least, capacity + 1, least):  # within a stretch of the least size no entry depends on another
        c = np.arange(c0, min(c0 + least, capacity + 1))
        rest = c[None, :] - sizes[:, None]
        total = np.where(rest >= 0, best[np.maximum(rest, 0)] + values[:, None], -1.0)
        k = total.argmax(0)
        top = total[k, np.arange(len(c))]
        best[c], choice[c] = np.maximum(top, 0), np.where(top > 0, k, -1)
    out, column, room = np.eye(m), np.arange(m), capacity - sizes
    while len(column):
        taken = choice[room]
        column, room, taken = column[taken >= 0], room[taken >= 0], taken[taken >= 0]
        out[taken, column] += 1
        room = room - sizes[taken]
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """(how often each size, number of sequences) of an optimal basic solution of the configuration linear program."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse, x = np.diag(1 / np.diag(basis)), demand / np.diag(basis)
    found, step = np.zeros((m, 0)), 0
    while step < 20 * m:
        values = inverse.sum(0)
        worth = values @ found
        if not len(worth) or worth.max() <= 1 + 1e-9:  # the sets found last are used up
            found = _best_sets(sizes, values, capacity)
            worth = values @ found
            if worth.max() <= 1 + 1e-9:
                break
        step += 1
        column = found[:, worth.argmax()]
        change = inverse @ column
        ratio = np.where(change > 1e-9, x / np.where(change > 1e-9, change, 1), np.inf)
        leaving = int(ratio.argmin())
        moved = ratio[leaving]
        x = np.maximum(x - moved * change, 0)
        x[leaving] = moved
        basis[:, leaving] = column
        if step % 200:
            row = inverse[leaving] / change[leaving]
            inverse -= np.outer(change, row)
            inverse[leaving] = row
        else:  # rounding errors of the updates do not add up
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ demand, 0)
    return [(basis[:, j], float(x[j])) for j in range(m)]


class Plan:
    """Runs (length, lo, hi, first sequence, pieces per sequence, offset): piece number r of the length, lo <= r < hi, is in
    sequence first + (r - lo) // per at offset + (r - lo) % per * length."""

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY, small_part: int = SMALL_PART, groups: int = GROUPS):
        self.capacity, self.sequences = capacity, 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.left = counts.astype(np.int64).copy()
        self.taken = np.zeros(capacity + 1, np.int64)
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free room: first sequence, number
        self._large(capacity // small_part, groups)
        for length in range(capacity, 0, -1):
            self._best_fit(length)

    def _take(self, length: int, n: int, first: int, per: int, offset: int) -> None:
        lo = int(self.taken[length])
        self.runs.append((length, lo, lo + n, first, per, offset))
        self.taken[length] += n
        self.left[length] -= n

    def _large(self, small: int, groups: int) -> None:
        lengths = np.array([n for n in range(self.capacity, small, -1) if self.left[n]], np.int64)
        if not len(lengths):
            return
        ends = np.cumsum(self.left[lengths])
        total = int(ends[-1])
        groups = min(groups, -(-total // GROUP_ROWS))
        cuts = [total * g // groups for g in range(groups + 1)]
        queues: dict[int, list[list[int]]] = {}  # by rounded size: [length, number], longest first
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            first, last = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b, "left")
            queue = queues.setdefault(int(lengths[first]), [])
            for i in range(first, last + 1):
                begin = int(ends[i - 1]) if i else 0
                queue.append([int(lengths[i]), min(b, int(ends[i])) - max(a, begin)])
        sizes = np.array(list(queues))
        demand = np.array([sum(n for _, n in q) for q in queues.values()], float)
        for column, x in configurations(sizes, demand, self.capacity):
            if (number := int(x + 1e-6)) > 0:
                self._fill(number, [(queues[int(s)], int(a)) for s, a in zip(sizes, column, strict=True) if a > 0.5])

    def _fill(self, number: int, wanted: list[tuple[list[list[int]], int]]) -> None:
        """Sequences of one configuration, with actual lengths in the places of rounded ones."""
        parts = [(self.sequences, number, 0)]  # first sequence, number, used room
        self.sequences += number
        for queue, times in wanted:
            for _ in range(times):
                after = []
                for first, n, used in parts:
                    while n and queue:
                        length, there = queue[0]
                        k = min(n, there)
                        self._take(length, k, first, 1, used)
                        after.append((first, k, used + length))
                        first, n = first + k, n - k
                        if k == there:
                            queue.pop(0)
                        else:
                            queue[0][1] -= k
                    if n:
                        after.append((first, n, used))
                parts = after
        for first, n, used in parts:
            self.open[self.capacity - used].append((first, n))

    def _best_fit(self, length: int) -> None:
        """All pieces of the length, each into the sequence with the least room that holds it."""
        free = length
        while self.left[length]:
            while free < self.capacity and not self.open[free]:
                free += 1
            left, per = int(self.left[length]), free // length
            if self.open[free]:
                first, number = self.open[free].pop()
            else:
                first, number = self.sequences, -(-left // per)
                self.sequences += number
            n = min(number, left // per)
            if n:
                self._take(length, n * per, first, per, self.capacity - free)
                self.open[free - n * per * length // n].append((first, n))
            if n < number and (rest := min(left - n * per, per - 1 if n else left)):
                # the last pieces of this length do not fill their share of a sequence
                self._take(length, rest, first + n, rest, self.capacity - free)
                self.open[free - rest * length].append((first + n, 1))
                n += 1
            if n < number:
                self.open[free].append((first + n, number - n))


def packed(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 2, path: str = TOKENIZER_PATH, doc_id: str = "doc_id",
           text: str = "text", small_part: int = SMALL_PART, groups: int = GROUPS) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null and empty texts are one piece with the end id; repeated rows, null ids and ids that occur twice each get places of
    their own; other columns are ignored; an empty table gives no rows. The tokenizer file must be at ``path`` on every
    executor. The driver gets the number of pieces of each length, at most ``capacity`` rows, and sends runs back, of
    which there are a few for each length and configuration. Pieces of a length are numbered in cells of about
    ``CELL_ROWS`` rows, so a frequent length is spread over many tasks.
    """
    spark = docs.sparkSession
    cut = staged(token_pieces(docs, capacity, end_id, path, doc_id, text), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    plan = Plan(counts, capacity, small_part, groups)
    runs: dict[int, list] = {}
    for length, *run in plan.runs:
        runs.setdefault(length, []).append(tuple(run))
    # at most one row per length
    cells = spark.createDataFrame([(n, int(-(-counts[n] // CELL_ROWS))) for n in runs], "length long, cells long")
    known = spark.createDataFrame(
        list(runs.items()), "length long, runs array<struct<lo:long,hi:long,first:long,per:long,offset:long>>")
    dealt = cut.join(F.broadcast(cells), "length").withColumn(
        "cell", F.expr("pmod(xxhash64(_id, piece, start, ids_crc32), cells)")).drop("cells")
    before = dealt.groupBy("length", "cell").agg(F.count("*").alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("length").orderBy("cell")) - F.col("n")).drop("n")
    inside = Window.partitionBy("length", "cell").orderBy("_id", "piece", "start", "ids_crc32")
    numbered = dealt.withColumn("at", F.row_number().over(inside) - 1).join(before, ["length", "cell"]).withColumn(
        "at", F.col("at") + F.col("before"))
    placed = numbered.join(F.broadcast(known), "length").withColumn(
        "run", F.expr("filter(runs, x -> x.lo <= at and at < x.hi)[0]"))
    return placed.select(
        F.col("_id").alias(doc_id), "piece", "start", "length", "ids_crc32",
        F.expr("run.first + (at - run.lo) div run.per").alias("sequence_id"),
        F.expr("run.offset + (at - run.lo) % run.per * length").alias("offset"))


def op11_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
