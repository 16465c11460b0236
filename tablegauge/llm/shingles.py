"""N-gram Jaccard join with a MinHash LSH forest.

A text's shingles are its runs of five folded words. Each tree of the forest is a trie over the text's MinHash values in a
fixed order; texts sorted by that path stand next to those with which they share the longest prefix. The prefix may be
shortened down to the depth at which the chance that a pair at the threshold shares it in some tree reaches the target
recall; a text that has been joined to all others of its branch needs no shorter prefix. What shares a branch and looks alike
by signature is grouped, and inside a group shingle sets are compared exactly.
"""

from __future__ import annotations

from hashlib import md5
from itertools import chain
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablegauge.functions.columns import quote
from tablegauge.llm.common import (
    as_bytes, block_pairs, components, crowded, join_classes, key128, local_roots, map_groups, map_texts, table,
)
from tablegauge.llm.decontamination import words
from tablegauge.operators.profile import canonical
from tablegauge.session import staged

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9995
TREES, DEPTH = 20, 6
#: Members of one block of a group; two blocks meet in a task.
BLOCK = 512
_RNG = np.random.default_rng(11)
_TIMES = _RNG.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_XOR = _RNG.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def depth_for(threshold: float, recall: float, trees: int = TREES, most: int = DEPTH) -> int:
    """The longest prefix that a pair at the threshold shares in at least one tree with the wanted chance."""
    share = 1 - (1 - recall) ** (1 / trees)
    return max(1, min(most, int(log(share) / log(threshold))))


def shingle_hashes(texts: list[bytes], n: int = WORDS) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(16-byte key of the folded text or empty, hashes of all shingles, number of shingles of each text)."""
    folded = [words(t) for t in texts]
    size = np.array([len(w) for w in folded], np.int64)
    keys = [md5(b" ".join(w)).digest() if w else b"" for w in folded]
    codes, distinct = pd.factorize(np.array(list(chain.from_iterable(folded)), dtype=object))
    word = np.array([xxhash.xxh64_intdigest(w) for w in distinct], np.uint64)[codes] if len(codes) else np.zeros(0, np.uint64)
    starts = np.concatenate([[0], np.cumsum(size)])[:-1]
    count = np.where(size >= n, size - n + 1, (size > 0).astype(np.int64))
    rolling = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for k in range(n):
        rolling = (rolling ^ word[k : k + len(rolling)]) * _MIX
        rolling ^= rolling >> np.uint64(31)
    out = np.empty(int(count.sum()), np.uint64)
    places = np.concatenate([[0], np.cumsum(count)])[:-1]
    long = size >= n
    at = np.repeat(starts[long] - np.concatenate([[0], np.cumsum(count[long])])[:-1], count[long]) + np.arange(count[long].sum())
    to = np.repeat(places[long] - np.concatenate([[0], np.cumsum(count[long])])[:-1], count[long]) + np.arange(count[long].sum())
    out[to] = rolling[at]
    for i in np.flatnonzero((size > 0) & ~long):
        h = np.array([size[i]], np.uint64)
        for k in range(size[i]):
            h = (h ^ word[starts[i] + k]) * _MIX
            h ^= h >> np.uint64(31)
        out[places[i]] = h[0]
    return keys, out, count


def signatures(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """16-bit MinHash values, one row per text with shingles."""
    count = count[count > 0]
    out = np.empty((len(count), TREES * DEPTH), np.uint16)
    if len(count):
        starts = np.concatenate([[0], np.cumsum(count)])[:-1]
        for k in range(TREES * DEPTH):
            least = np.minimum.reduceat((hashes ^ _XOR[k]) * _TIMES[k], starts)
            out[:, k] = ((least * _MIX) >> np.uint64(48)).astype(np.uint16)
    return out


def join_branch(signature: np.ndarray, cut: float) -> np.ndarray:
    """Component of each text of one branch of a tree, in trie order.

    A text is held first against the group of the text before it, with which it shares the longest prefix, then against
    one member of each other group, and against all members of groups where that one did not match."""
    groups: list[list[int]] = [[0]]
    last = 0
    for i in range(1, len(signature)):
        alike = lambda at, i=i: (signature[at] == signature[i]).mean(axis=1) >= cut
        if len(groups) == 1 and alike([groups[0][0]])[0]:
            groups[0].append(i)
            continue
        first = alike([g[0] for g in groups])
        hits = [k for k, g in enumerate(groups) if first[k] or (len(g) > 1 and alike(g).any())]
        if not hits:
            groups.append([i])
        else:
            merged = [x for k in hits for x in groups[k]] + [i]
            groups = [g for k, g in enumerate(groups) if k not in hits] + [merged]
    root = np.empty(len(signature), np.int64)
    for g in groups:
        root[g] = min(g)
    return root


def exact_pairs(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets whose Jaccard similarity is at least the threshold."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    codes, distinct = pd.factorize(np.concatenate(sets))
    often = np.bincount(codes, minlength=len(distinct))
    rank = np.full(len(distinct), -1)
    shared = np.flatnonzero(often > 1)  # what only one text has is in no intersection
    rank[shared] = np.arange(len(shared))
    row = np.repeat(np.arange(m), sizes.astype(np.int64))
    column = rank[codes]
    row, column = row[column >= 0], column[column >= 0]
    common = np.zeros((m, m), np.float32)
    width = max(256, (4 << 20) // m)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    edges = np.searchsorted(column, np.arange(0, len(shared) + width, width))
    for k in range(len(edges) - 1):
        part = slice(edges[k], edges[k + 1])
        dense = np.zeros((m, min(width, len(shared) - k * width)), np.float32)
        dense[row[part], column[part] - k * width] = 1
        common += dense @ dense.T
    union = sizes[:, None] + sizes[None, :] - common
    return np.nonzero(np.triu(common >= threshold * union - 1e-6, 1))


def similar_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL,
                  block: int = BLOCK) -> DataFrame:
    """``doc_id, n_links, component_id``: per row the number of other rows whose shingle sets have a Jaccard similarity of
    at least ``threshold``, and the smallest id that such links reach.

    Words are folded as in ``decontamination.words``. A text of fewer than five words is one shingle; a text without words,
    or null, links with nothing and is a class of its own. Repeated rows and texts that fold to the same words link with each
    other; a null id takes no part in the smallest id. Other columns are ignored.

    Rows that fold to the same words are one node with a weight. Only (branch, node) pairs are shuffled to find branches of
    at least two nodes, then signatures for those, then texts of grouped nodes. Large branches and groups are dealt to pairs
    of blocks. No pair of texts leaves a task: only sums of links and spanning edges do.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    depth = depth_for(threshold, recall)
    cut = threshold - 6 * (threshold * (1 - threshold) / (TREES * DEPTH)) ** 0.5
    raw = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).withColumn("raw", key128("_text"))

    def sign(batch: pa.RecordBatch) -> dict:
        keys, hashes, count = shingle_hashes(as_bytes(batch.column("_text")))
        values = iter(signatures(hashes, count))
        return {
            "_id": batch.column("_id"), "raw": batch.column("raw"), "node": [k or None for k in keys],
            "signature": [next(values).astype(">u2").tobytes() if k else None for k in keys],
        }

    rows = staged(map_texts(raw, sign, f"_id {kind}, raw binary, node binary, signature binary", "_text"), "signatures")
    nodes = staged(rows.filter("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "raw")).alias("first"), F.count("*").alias("weight"),
        F.min("signature").alias("signature")).select("node", F.col("first._id").alias("least"), "first.raw", "weight", "signature"), "texts")

    branch = F.substring(F.col("signature"), F.col("t") * 2 * DEPTH + 1, F.lit(2 * depth))
    branches = nodes.select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("t")).select(
        F.xxhash64("t", branch).alias("branch"), "t", "node")
    full = crowded(branches, "branch").join(nodes.select("node", "signature"), "node").withColumn(
        "path", F.substring(F.col("signature"), F.col("t") * 2 * DEPTH + 1, F.lit(2 * DEPTH)))

    def group(table_: pa.Table, ranges: list[tuple[int, int]]) -> pa.RecordBatch:
        names = table_.column("node").combine_chunks()
        values = np.frombuffer(b"".join(table_.column("signature").to_pylist()), ">u2").astype(np.uint16).reshape(-1, TREES * DEPTH)
        root = np.arange(len(names))
        two = np.array([s for s, e in ranges if e - s == 2], np.int64)
        if len(two):
            alike = (values[two] == values[two + 1]).mean(axis=1) >= cut
            root[two[alike] + 1] = two[alike]
        for s, e in ranges:
            if e - s > 2:
                root[s:e] = s + join_branch(values[s:e], cut)
        at = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([names.take(pa.array(at)), names.take(pa.array(root[at]))], names=["a", "b"])

    dealt = block_pairs(full, "n", "node", 4 * block).select("branch", "p", "q", "path", "node", "signature")
    alike = map_groups(dealt, ["branch", "p", "q"], group, "a binary, b binary", order=["path"])
    groups = staged(components(alike), "groups")
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    members = groups.join(sizes, "component").join(nodes.select("node", "least", "raw", "weight"), "node")
    texts = raw.join(members.withColumnRenamed("least", "_least"), "raw").filter(F.col("_id").eqNullSafe(F.col("_least"))).select(
        "component", "n", "node", "weight", "_text")

    def sets(batch: pa.RecordBatch) -> dict:
        _, hashes, count = shingle_hashes(as_bytes(batch.column("_text")))
        parts = np.split(hashes, np.cumsum(count)[:-1]) if len(count) else []
        return {c: batch.column(c) for c in ("component", "n", "node", "weight")} | {"shingles": [np.unique(p).tobytes() for p in parts]}

    with_sets = map_texts(texts, sets, "component binary, n bigint, node binary, weight bigint, shingles binary", "_text")
    dealt = block_pairs(with_sets, "n", "node", block)

    def compare(table_: pa.Table, ranges: list[tuple[int, int]]) -> pa.RecordBatch:
        names, weight = table_.column("node").combine_chunks(), table_.column("weight").to_numpy()
        own, p, q, n = (table_.column(c).to_numpy() for c in ("own", "p", "q", "n"))
        held = [np.frombuffer(x, np.uint64) for x in table_.column("shingles").to_pylist()]
        text_of = names.to_pylist()
        who, links, root, whole = [], [], [], []
        for s, e in ranges:
            at = s + np.unique(np.array([x for x in text_of[s:e]], dtype=object), return_index=True)[1]  # a repeated row once
            if len(at) < 2:
                continue
            i, j = exact_pairs([held[k] for k in at], threshold)
            if p[s] != q[s]:
                across = own[at[i]] != own[at[j]]
                i, j = i[across], j[across]
            if not len(i):
                continue
            total = np.bincount(i, weight[at[j]], len(at)) + np.bincount(j, weight[at[i]], len(at))
            some = np.flatnonzero(total)
            who.append(at[some])
            links.append(total[some].astype(np.int64))
            root.append(at[local_roots(len(at), i, j)[some]])
            whole.append(np.full(len(some), n[s] <= block))
        join = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, t)
        return pa.RecordBatch.from_arrays(
            [names.take(pa.array(join(who, np.int64))), pa.array(join(links, np.int64)), names.take(pa.array(join(root, np.int64))),
             pa.array(join(whole, bool))], names=["node", "links", "root", "whole"])

    found = staged(map_groups(dealt, ["component", "p", "q"], compare, "node binary, links bigint, root binary, whole boolean", rows=2 * block), "pairs")
    # a group that was one block is settled by that block
    large = components(found.filter("not whole").select(F.col("node").alias("a"), F.col("root").alias("b")))
    reach = large.unionByName(found.filter("whole").select("node", F.col("root").alias("component")))
    return join_classes(rows, nodes, found, reach, doc_id)


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, of each class of similar texts only one with the smallest id.

    A row with a null id is kept only where its class has no other, or it is alone; of equal rows one stays. Null and empty
    texts are similar to none. Columns may have any type and name; an empty table gives no rows."""
    key = "_key"
    while key in docs.columns:
        key += "_"
    row = F.struct(*[quote(c) for c in docs.columns])
    keyed = docs.withColumn(key, key128(canonical(row, docs.schema)))
    ids = F.struct(quote(doc_id).isNull().alias("none"), quote(doc_id).alias("id"), quote(key).alias("row"))
    found = similar_texts(keyed.select(ids.alias("_id"), quote(text).alias("text")), "_id", "text")
    kept = found.filter(F.col("_id").eqNullSafe(F.col("component_id"))).select(F.col("_id.row").alias(key)).distinct()
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).select(*[quote(c) for c in docs.columns])


def op8_minhash_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_texts(table(spark, sf_dir, "documents"))
