"""Near-duplicate vectors by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions, shifted and cut into cells; a table's key joins the cells of several
projections. Vectors that share a key in one of the tables are compared exactly. For unit vectors a cosine c is the distance
sqrt(2 - 2c), so the chance that a pair at the threshold meets in a table is known, and with it the number of tables that a
wanted recall takes.
"""

from __future__ import annotations

from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablegauge.llm.common import block_pairs, components, crowded, join_classes, key128, local_roots, map_groups, table
from tablegauge.session import staged

THRESHOLD, RECALL, CELL, BLOCK = 0.98, 0.9995, 1.0, 1024
#: Vectors at this distance are taken as unrelated when the number of projections of a key is chosen.
FAR, FAR_PER_BUCKET = 1.0, 20


def meet(distance: float, cell: float) -> float:
    """Chance that two points at a distance fall into one cell of a projection."""
    r = cell / distance
    return erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def shape(n: int, threshold: float, recall: float, cell: float = CELL) -> tuple[int, int]:
    """(projections of a key, tables): unrelated mates of a bucket stay about FAR_PER_BUCKET at any n, and a pair at the
    threshold is missed by all tables with a chance of at most 1 - recall."""
    near = meet(sqrt(2 - 2 * threshold), cell)
    k = max(3, ceil(log(max(2.0, n / FAR_PER_BUCKET)) / -log(meet(FAR, cell))))
    return k, ceil(log(1 - recall) / log(1 - near**k))


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def table_keys(vectors: np.ndarray, k: int, tables: int, cell: float = CELL, seed: int = 7) -> np.ndarray:
    """64-bit key of each vector in each table."""
    rng = np.random.default_rng([seed, vectors.shape[1]])
    directions = rng.standard_normal((vectors.shape[1], tables * k))
    cells = np.floor((unit(vectors) @ directions + rng.uniform(0, cell, tables * k)) / cell).astype(np.int64).view(np.uint64)
    keys = np.empty((len(vectors), tables), np.uint64)
    for t in range(tables):
        h = np.full(len(vectors), t + 1, np.uint64)
        for c in range(t * k, t * k + k):
            h = (h ^ cells[:, c]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        keys[:, t] = h
    return keys.view(np.int64)


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                 threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """``key, n_links, component_id``: per row the number of other rows linked with it, and the smallest key that its links
    reach. Rows are linked when their labels are equal and their cosine, in double precision, is at least ``threshold``.

    A row links with nothing when its key, label or vector is null, or its vector is empty, zero or has null or non-finite
    components; vectors of different length do not link. Repeated rows link with each other. Other columns are ignored.

    Equal vectors of a label are one node with a weight. Buckets of one node are dropped before vectors travel; larger
    buckets are dealt to pairs of blocks, so that a hot bucket is spread over tasks. A pair is counted in the first table
    that brings it together; no pair leaves a task, only sums and spanning edges do.
    """
    v = F.col("_v")
    element = "float" if vectors.schema[vector].dataType.elementType.simpleString() == "float" else "double"
    fine = F.col("_l").isNotNull() & F.col("_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("_id"), F.col(label).alias("_l"), F.col(vector).cast(f"array<{element}>").alias("_v"))
    rows = rows.select("_id", "_l", F.when(fine, F.transform("_v", lambda x: x + F.lit(0.0).cast(element))).alias("_v")).withColumn(
        "node", F.when(F.col("_v").isNotNull(), key128("_l", "_v")))
    nodes = staged(
        rows.filter("node is not null").groupBy("node").agg(
            F.min("_id").alias("least"), F.count("*").alias("weight"), F.first("_l").alias("_l"), F.first("_v").alias("_v")),
        "vectors")
    k, tables = shape(nodes.count(), threshold, recall)

    def hashed(batches):
        for b in batches:
            lists = b.column("_v")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy().astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            keys = np.zeros((b.num_rows, tables), np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                keys[at] = table_keys(flat[starts[at][:, None] + np.arange(size)], k, tables)
            listed = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, tables, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("_l"), lists.value_lengths(), listed], names=["node", "_l", "size", "keys"])

    label_kind = nodes.schema["_l"].dataType.simpleString()
    keyed = staged(nodes.select("node", "_l", "_v").mapInArrow(hashed, f"node binary, _l {label_kind}, size int, keys array<bigint>"), "keys")
    buckets = keyed.select("node", "_l", "size", F.posexplode("keys").alias("t", "h")).select(
        F.xxhash64("_l", "size", "t", "h").alias("bucket"), "t", "node")
    full = crowded(buckets)
    dealt = block_pairs(
        full.join(keyed.select("node", "keys"), "node").withColumn("keys", F.slice("keys", 1, F.col("t"))).join(nodes.select("node", "weight", "_v"), "node"), "n", "node", block)

    def compare(rows_: pa.Table, groups: list[tuple[int, int]]) -> pa.RecordBatch:
        names, weight = rows_.column("node").combine_chunks(), rows_.column("weight").to_numpy()
        own, p, q, t = (rows_.column(c).to_numpy() for c in ("own", "p", "q", "t"))
        keys = rows_.column("keys").combine_chunks()
        lists = rows_.column("_v").combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        who, links, root = [], [], []
        for s, e in groups:
            if e - s < 2:
                continue
            size = ends[s + 1] - ends[s]
            x = unit(flat[ends[s] : ends[e]].astype(np.float64).reshape(-1, size)) if (np.diff(ends[s : e + 1]) == size).all() else None
            if x is None:  # a chance collision of keys over lengths
                raise ValueError("vectors of one bucket differ in length")
            i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
            if p[s] != q[s]:
                across = own[s + i] != own[s + j]
                i, j = i[across], j[across]
            earlier = keys.slice(s, e - s).flatten().to_numpy().reshape(e - s, t[s])
            before = (earlier[i] == earlier[j]).any(axis=1)
            i, j = i[~before], j[~before]
            if not len(i):
                continue
            n = np.bincount(i, weight[s + j], e - s) + np.bincount(j, weight[s + i], e - s)
            at = np.flatnonzero(n)
            who.append(s + at)
            links.append(n[at].astype(np.int64))
            root.append(s + local_roots(e - s, i, j)[at])
        take = lambda parts: names.take(pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))
        return pa.RecordBatch.from_arrays(
            [take(who), pa.array(np.concatenate(links) if links else np.zeros(0, np.int64)), take(root)], names=["node", "links", "root"])

    found = staged(map_groups(dealt, ["bucket", "p", "q"], compare, "node binary, links bigint, root binary"), "links")
    reach = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    return join_classes(rows, nodes, found, reach, key)


def op3_pstable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(least(c.b, vec_id), vec_id) AS component_id,
       coalesce(least(c.b, vec_id), vec_id) = vec_id AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN c ON e.vec_id = c.a
"""
