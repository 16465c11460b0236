"""Language-model scoring with an Elias-Fano n-gram trie.

The trie has two levels. Level 1 holds the vocabulary: sorted word hashes, so that a word's id is its place, with exact counts
and, per context word, a monotone pointer to its successors. Level 2 holds the successors' word ids, made monotone by their
context, with smoothed probabilities in 256 quantised steps. Levels are cut into shards of bounded size, written by the tasks
that build them to the folder that all executors share, and memory-mapped by the tasks that score; a word pair is looked up
inside its context's pointer range by successor search.

Smoothing: p(w | c) = (n(c, w) + M p(w)) / (n(c) + M) with p(w) = (n(w) + 1) / (N + V + 1).
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablegauge.llm.common import as_bytes, map_groups, map_texts, remainder, table
from tablegauge.llm.eliasfano import EliasFano
from tablegauge.llm.webarchive import open_folder
from tablegauge.session import scratch_folder, staged

#: Pseudo-count of the lower order; entries of a level-1 shard; tokens of a level-2 shard.
WEIGHT, WORDS_PER_SHARD, TOKENS_PER_SHARD = 32.0, 2_000_000, 4_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END = xxhash.xxh64_intdigest(b"")


def tokens(raw: bytes) -> list[bytes]:
    """Words of the folded text; the end of the text is the empty token."""
    return [*raw.translate(_LOWER).split(), b""]


def coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of each token among the distinct ones, hashes of these, number of tokens of each text)."""
    split = [tokens(t) for t in texts]
    codes, distinct = pd.factorize(np.array(list(chain.from_iterable(split)), dtype=object))
    return codes, np.array([xxhash.xxh64_intdigest(w) for w in distinct], np.uint64), np.array([len(s) for s in split], np.int64)


def hash_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are equal ranges of the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def write_arrays(folder: str, prefix: str, arrays: dict[str, np.ndarray]) -> str:
    """Write arrays side by side, under a name that no other attempt of the task has."""
    system, base = open_folder(folder)
    name = f"{prefix}-{uuid.uuid4().hex}"
    for key, values in arrays.items():
        held = io.BytesIO()
        np.lib.format.write_array(held, np.ascontiguousarray(values), allow_pickle=False)
        with system.open_output_stream(f"{base}/{name}.{key}.npy", compression=None) as f:
            f.write(held.getvalue())
    return f"{folder}/{name}"


def map_array(uri: str, key: str) -> np.ndarray:
    """A written array, memory-mapped; from a folder that is no mounted file system it is copied once and unlinked."""
    system, path = open_folder(uri)
    path = f"{path}.{key}.npy"
    if isinstance(system, fs.LocalFileSystem):
        return np.load(path, mmap_mode="r").view(np.ndarray)
    held, copy = tempfile.mkstemp(suffix=".npy")
    with os.fdopen(held, "wb") as out, system.open_input_stream(path) as f:
        while block := f.read(1 << 20):
            out.write(block)
    mapped = np.load(copy, mmap_mode="r").view(np.ndarray)
    os.unlink(copy)
    return mapped


def map_sequence(uri: str, name: str) -> EliasFano:
    return EliasFano(**{p: map_array(uri, f"{name}.{p}") for p in EliasFano.PARTS})


def sequence_parts(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in EliasFano.parts(values).items()}


@dataclass(frozen=True)
class Words:
    """Level 1 as the tasks see it: shard files with the id of their first word, and totals."""

    files: tuple[str, ...]
    first: tuple[int, ...]
    lowest: tuple[int, ...]
    types: int
    total: int
    texts: int

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of each hash."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = hash_shard(hashes, len(self.files))
        order = np.argsort(hashes)  # neighbours in the file are looked up together
        for s in np.unique(shard):
            at = order[shard[order] == s]
            at = at[hashes[at] >= np.uint64(self.lowest[s])] if self.files[s] else at[:0]
            if len(at):
                found = _open(self.files[s], "words").find(hashes[at] - np.uint64(self.lowest[s]))
                known = found >= 0
                ids[at[known]] = found[known] + self.first[s]
                counts[at[known]] = _open_array(self.files[s], "counts")[found[known]]
        return ids, counts

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of known word ids; the id after the last word is the start of a text."""
        out = np.full(len(ids), self.texts, np.int64)
        shard = np.searchsorted(np.array(self.first), ids, "right") - 1
        for s in np.unique(shard[ids < self.types]):
            at = np.flatnonzero((shard == s) & (ids < self.types))
            out[at] = _open_array(self.files[s], "counts")[ids[at] - self.first[s]]
        return out

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.total + self.types + 1))


@dataclass(frozen=True)
class Shards:
    """How (context, word) pairs are dealt: equal ranges of the context's id, and ranges of the word's id for contexts that
    alone would fill a shard."""

    plain: int
    contexts: int
    hot: tuple[tuple[int, int, int], ...]  # (context, its first shard, number of its shards)

    def of(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = context * self.plain // self.contexts
        if self.hot:
            ids, first, number = (np.array(x, np.int64) for x in zip(*self.hot, strict=True))
            place = np.minimum(np.searchsorted(ids, context), len(ids) - 1)
            at = np.flatnonzero(ids[place] == context)
            out[at] = first[place[at]] + word[at] * number[place[at]] // self.contexts
        return out

    @property
    def number(self) -> int:
        return self.plain + sum(n for _, _, n in self.hot)


_OPENED: dict[tuple[str, str], object] = {}


def _open(uri: str, name: str) -> EliasFano:
    if (uri, name) not in _OPENED:
        _OPENED[uri, name] = map_sequence(uri, name)
    return _OPENED[uri, name]


def _open_array(uri: str, name: str) -> np.ndarray:
    if (uri, name) not in _OPENED:
        _OPENED[uri, name] = map_array(uri, name)
    return _OPENED[uri, name]


def _pack(values: np.ndarray) -> bytes:
    """Compressed integers: the bytes of equal rank stand together."""
    width = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : raw[0]] = planes.T
    return wide.view("<u8").ravel()


def count_words(texts: DataFrame) -> DataFrame:
    """(hash, count) of each token of the column ``text``."""

    def step(batch: pa.RecordBatch) -> dict:
        codes, hashes, _ = coded(as_bytes(batch.column("text")))
        return {"hash": pa.array(hashes.view(np.int64)), "count": pa.array(np.bincount(codes, minlength=len(hashes)))}

    return map_texts(texts, step, "hash bigint, count bigint").groupBy("hash").agg(F.sum("count").alias("count"))


def build_words(counts: DataFrame, folder: str, per_shard: int = WORDS_PER_SHARD) -> Words:
    """Write level 1 from staged word counts."""
    types, total = counts.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    shards = max(1, -(-types // per_shard))
    end = counts.filter(F.col("hash") == int(np.array(END, np.uint64).view(np.int64))).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]

    def mark(batches):
        for b in batches:
            hashes = b.column("hash").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(hash_shard(hashes, shards)), b.column("hash"), b.column("count")], names=["shard", "hash", "count"])

    def build(rows: pa.Table, ranges: list[tuple[int, int]]) -> pa.RecordBatch:
        out = []
        for s, e in ranges:
            hashes, count = rows.column("hash").to_numpy()[s:e].view(np.uint64), rows.column("count").to_numpy()[s:e]
            order = np.argsort(hashes)
            hashes, count = hashes[order], count[order]
            name = write_arrays(folder, "words", sequence_parts("words", hashes - hashes[0]) | {"counts": count.astype(np.uint32 if count.max() < 1 << 32 else np.uint64)})
            out.append((rows.column("shard")[s].as_py(), name, e - s, int(hashes[:1].view(np.int64)[0])))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["shard", "file", "n", "lowest"])

    marked = counts.mapInArrow(mark, "shard bigint, hash bigint, count bigint")
    made = {r.shard: r for r in staged(map_groups(marked, ["shard"], build, "shard bigint, file string, n bigint, lowest bigint", rows=1), "level").collect()}
    files, first, lowest, at = [], [], [], 0
    for s in range(shards):
        r = made.get(s)
        files.append(r.file if r else "")
        first.append(at)
        lowest.append(int(np.array(r.lowest, np.int64).view(np.uint64)) if r else 0)
        at += r.n if r else 0
    return Words(tuple(files), tuple(first), tuple(lowest), types, total, end)


def plan_shards(counts: DataFrame, words: Words, per_shard: int = TOKENS_PER_SHARD) -> Shards:
    """Contexts with more tokens than half a shard, fewer than twice the number of shards, get shards of their own."""
    plain = max(1, -(-words.total // per_shard))
    hot = counts.filter(F.col("count") > per_shard // 2).select("hash", "count").collect()
    found = [(int(words.lookup(np.array([r.hash], np.int64).view(np.uint64))[0][0]), r["count"]) for r in hot]
    if words.texts > per_shard // 2:
        found.append((words.types, words.texts))
    listed, at = [], plain
    for context, n in sorted(found):
        pieces = -(-n * 2 // per_shard)
        listed.append((context, at, pieces))
        at += pieces
    return Shards(plain, words.types + 1, tuple(listed))


def _pairs(codes: np.ndarray, ids: np.ndarray, sizes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(context id, word id) of every token; a text begins in the context ``start``."""
    word = ids[codes]
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[np.concatenate([[0], np.cumsum(sizes)])[:-1]] = start
    return context, word


def build_pairs(texts: DataFrame, words: Words, shards: Shards, folder: str, weight: float = WEIGHT) -> dict[int, str]:
    """Write level 2; returns the file of each shard that has pairs.

    Tasks send per shard the sorted pairs of a piece of text with their counts, compressed; a shard gets at most its share
    of the tokens, whichever context is hot."""

    def count(batch: pa.RecordBatch) -> dict:
        codes, hashes, sizes = coded(as_bytes(batch.column("text")))
        context, word = _pairs(codes, words.lookup(hashes)[0], sizes, words.types)
        keys, n = np.unique(context.astype(np.uint64) * np.uint64(words.types) + word.astype(np.uint64), return_counts=True)
        shard = shards.of((keys // np.uint64(words.types)).astype(np.int64), (keys % np.uint64(words.types)).astype(np.int64))
        order = np.argsort(shard, kind="stable")
        keys, n, shard = keys[order], n[order], shard[order]
        cut = np.flatnonzero(np.diff(shard, prepend=-1))
        ends = [*cut[1:], len(shard)]
        return {
            "shard": shard[cut], "keys": [_pack(np.diff(keys[s:e], prepend=np.uint64(0))) for s, e in zip(cut, ends, strict=True)],
            "counts": [_pack(n[s:e]) for s, e in zip(cut, ends, strict=True)],
        }

    def build(rows: pa.Table, ranges: list[tuple[int, int]]) -> pa.RecordBatch:
        out = []
        for s, e in ranges:
            part = rows.slice(s, e - s)
            keys = np.concatenate([np.cumsum(_unpack(x)) for x in part.column("keys").to_pylist()])
            n = np.concatenate([_unpack(x) for x in part.column("counts").to_pylist()]).astype(np.int64)
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.diff(keys, prepend=keys[0] + np.uint64(1)))
            keys, n = keys[first], np.add.reduceat(n, first)
            out.append((part.column("shard")[0].as_py(), write_arrays(folder, "pairs", _level(keys, n, words, weight))))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["shard", "file"])

    sent = map_texts(texts, count, "shard bigint, keys binary, counts binary")
    made = staged(map_groups(sent, ["shard"], build, "shard bigint, file string", rows=1), "level").collect()
    return {r.shard: r.file for r in made}


def _level(keys: np.ndarray, n: np.ndarray, words: Words, weight: float) -> dict[str, np.ndarray]:
    """The arrays of a level-2 shard: contexts, pointers, successors relative to the shard's first context, and quantised
    logarithms of probabilities."""
    types = np.uint64(words.types)
    context, word = (keys // types).astype(np.int64), (keys % types).astype(np.int64)
    distinct, starts, place = np.unique(context, return_index=True, return_inverse=True)
    held = words.counts_of(distinct)[place]
    kinds, back = np.unique(word, return_inverse=True)
    lower = 10.0 ** words.unigram(words.counts_of(kinds))[back]
    logs = np.log10((n + weight * lower) / (held + weight))
    # 256 steps of equal width, each at the mean of its entries
    low, high = logs.min(), logs.max()
    step = np.minimum((logs - low) * (256 / max(high - low, 1e-9)), 255).astype(np.int64)
    book = np.bincount(step, logs, 256) / np.maximum(np.bincount(step, minlength=256), 1)
    return (
        sequence_parts("contexts", distinct - distinct[0])
        | sequence_parts("pointers", np.append(starts, len(keys)))
        | sequence_parts("successors", place.astype(np.uint64) * types + word.astype(np.uint64))
        | {"first": np.array([distinct[0]]), "step": step.astype(np.uint8), "book": book}
    )


def pair_logs(context: np.ndarray, word: np.ndarray, shards: Shards, files: dict[int, str], types: int) -> np.ndarray:
    """Quantised log10 p(word | context) of stored pairs, NaN for others. Pairs come sorted by context, then word."""
    out = np.full(len(word), np.nan)
    if not len(word):
        return out
    shard = shards.of(context, word)
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for s, e in zip(cut, [*cut[1:], len(order)], strict=True):
        uri = files.get(int(shard[order[s]]))
        if uri is None:
            continue
        at = order[s:e]
        first = np.diff(context[at], prepend=-1) != 0  # pairs come in order
        own, back = context[at][first], np.cumsum(first) - 1
        relative = own - int(_open_array(uri, "first")[0])
        place = np.full(len(own), -1, np.int64)
        inside = relative >= 0
        place[inside] = _open(uri, "contexts").find(relative[inside])
        here = np.flatnonzero(place >= 0)
        low, high = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        pointers = _open(uri, "pointers")
        low[here], high[here] = pointers.access(place[here]), pointers.access(place[here] + 1)
        some = np.flatnonzero(place[back] >= 0)
        found = _open(uri, "successors").find(place[back[some]].astype(np.uint64) * np.uint64(types) + word[at[some]].astype(np.uint64))
        hit = (found >= low[back[some]]) & (found < high[back[some]])
        out[at[some[hit]]] = _open_array(uri, "book")[_open_array(uri, "step")[found[hit]]]
    return out


def score_piece(texts: list[bytes], words: Words, shards: Shards, files: dict[int, str], weight: float) -> dict[str, np.ndarray]:
    codes, hashes, sizes = coded(texts)
    ids, counts = words.lookup(hashes)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    unigram = words.unigram(counts)
    # one lookup per distinct pair; unknown words are no contexts and have no pairs
    previous = np.full(len(codes), len(hashes), np.int64)
    previous[1:] = codes[:-1]
    previous[starts] = len(hashes)
    pair, back = np.unique(previous * (len(hashes) + 1) + codes, return_inverse=True)
    before, after = np.append(ids, words.types)[pair // (len(hashes) + 1)], ids[pair % (len(hashes) + 1)]
    held = np.append(counts, words.texts)[pair // (len(hashes) + 1)]
    logs = np.log10(weight / (held + weight)) + unigram[pair % (len(hashes) + 1)]
    # in the order of the trie, so that neighbouring lookups touch neighbouring memory
    known = np.flatnonzero((before >= 0) & (after >= 0))
    known = known[np.argsort(before[known].astype(np.uint64) * np.uint64(words.types) + after[known].astype(np.uint64))]
    stored = pair_logs(before[known], after[known], shards, files, words.types)
    logs[known] = np.where(np.isnan(stored), logs[known], stored)
    return {
        "n_tokens": sizes, "n_known": np.add.reduceat((counts > 0).astype(np.int64)[codes], starts),
        "base_score": np.add.reduceat(unigram[codes], starts), "score": np.add.reduceat(logs[back], starts),
    }


def model_scores(docs: DataFrame, training: DataFrame, doc_id: str = "doc_id", text: str = "text", weight: float = WEIGHT,
                 words_per_shard: int = WORDS_PER_SHARD, tokens_per_shard: int = TOKENS_PER_SHARD) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs``, from counts over all of ``training``.

    ``base_score`` adds up log10 of add-one word probabilities, ``score`` log10 of the trie's. A null or empty text is its end
    alone. An empty training table leaves every token unknown. Repeated rows count and are scored each; other columns are
    ignored. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    folder = scratch_folder(spark, "trie")
    open_folder(folder)[0].create_dir(open_folder(folder)[1], recursive=True)
    learn = training.select(F.col(text).cast("string").alias("text"))
    counts = staged(count_words(learn), "vocabulary")
    words = build_words(counts, folder, words_per_shard)
    shards = plan_shards(counts, words, tokens_per_shard)
    files = build_pairs(learn, words, shards, folder, weight) if words.types else {}
    # file names and one entry per hot context: they grow with the number of shards, not of words
    shared = spark.sparkContext.broadcast((words, shards, files))
    kind = docs.schema[doc_id].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> dict:
        return {"_id": batch.column("_id")} | score_piece(as_bytes(batch.column("text")), *shared.value, weight)

    scored = map_texts(
        docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text")), step,
        f"_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(F.col("_id").alias(doc_id), "n_tokens", "n_known", F.lit(words.total).cast("bigint").alias("train_tokens"), "base_score", "score")


def op9_elias_fano_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = remainder("doc_id", 7) == 2
    return model_scores(docs, docs.filter(~held)).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
