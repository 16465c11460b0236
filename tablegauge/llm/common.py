"""Shared helpers: arrow batches in bounded pieces, stable remainders, keyed joins with hot keys, connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablegauge.session import read_table, staged

#: Text bytes that one step of a batch function handles at once.
PIECE_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, folder, name)


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with at most ``limit`` bytes of text, or one row if that is longer."""
    sizes = pc.binary_length(batch.column(text)).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if start < len(sizes):
        yield batch.slice(start)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system. A worker lives on between tasks and has its part of the executor's memory."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def map_texts(df: DataFrame, step: Callable[[pa.RecordBatch], dict[str, list] | pa.RecordBatch], schema: str, text: str = "text",
              limit: int = PIECE_BYTES) -> DataFrame:
    """Apply ``step`` to bounded pieces of rows; no shuffle. ``step`` returns the columns of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text, limit):
                out = step(piece)
                yield pa.RecordBatch.from_arrays([_column(out[f.name], f.type) for f in arrow], schema=arrow)
        batch = piece = out = None
        give_back()

    return df.mapInArrow(run, kind)


def filter_texts(df: DataFrame, keep: Callable[[pa.RecordBatch], np.ndarray], text: str = "text", limit: int = PIECE_BYTES) -> DataFrame:
    """The rows for which ``keep``, called with bounded pieces of rows, is true; all columns stay, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text, limit):
                yield piece.filter(pa.array(np.asarray(keep(piece), bool)))
        batch = piece = None
        give_back()

    return df.mapInArrow(run, df.schema)


def _column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


class Lists:
    """Lists of numbers in one array, by code."""

    def __init__(self):
        self.flat, self.starts, self.lengths = np.zeros(1 << 14, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.size = self.used = 0

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> int:
        """Code of the first of the added lists."""
        first, n = self.size, self.size + len(lengths)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n > len(self.starts):
            self.starts, self.lengths = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lengths))
        self.flat[self.used : self.used + len(flat)] = flat
        self.lengths[first:n] = lengths
        self.starts[first:n] = self.used + np.cumsum(lengths) - lengths
        self.size, self.used = n, self.used + len(flat)
        return first

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the lists one after the other, length of each list)."""
        n = self.lengths[codes]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[codes] - ends + n, n) + np.arange(n.sum())], n


def attach(left: DataFrame, right: DataFrame, key: str, weight: str, hot_share: int = 512) -> DataFrame:
    """Left join on a key that is unique in ``right``; ``weight`` of right holds the key's number of left rows.

    Keys with more than a ``hot_share``-th of all rows, fewer than ``hot_share`` of them, are broadcast; their left rows
    are scattered, so that no task of the ordinary join gets a whole hot key.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = right.filter(F.col(weight) > max(1000, total // hot_share))
    cold = right.filter(F.col(weight) <= max(1000, total // hot_share))
    values = [c for c in right.columns if c != key]
    marked = left.join(
        F.broadcast(hot.select(F.col(key), F.struct(*values).alias("_hot"))), key, "left"
    ).withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)))
    # a null key matches nothing, and the salt spreads those rows
    marked = marked.withColumn("_salt", F.when(F.col("_key").isNull(), F.pmod(F.xxhash64(*left.columns), F.lit(1 << 20))).otherwise(0))
    cold = cold.select(F.col(key).alias("_key"), F.struct(*values).alias("_cold")).withColumn("_salt", F.lit(0).cast("bigint"))
    joined = marked.join(cold, ["_key", "_salt"], "left").withColumn("_value", F.coalesce("_hot", "_cold"))
    return joined.select(*left.columns, *[F.col("_value")[v].alias(v) for v in values])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph given as columns a, b; component is the smallest node that is reachable.

    Alternating large-star and small-star rounds of map-side combined joins. Each round is written to the shared folder,
    so a lost executor repeats one round at most. The number of rounds grows with the logarithm of the longest path.
    """
    both = staged(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    before = None
    for _ in range(max_rounds):
        after = staged(_small_star(_large_star(both)), "links")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        both = after
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    members = both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = both.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the node's smallest neighbour or itself."""
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked with the smallest of them; edges come as a > b."""
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    linked = near.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("u", "m")).filter("a <> b").distinct()


def key128(*columns: Column | str) -> Column:
    """16 bytes that stand for the columns' values: two 64-bit hashes with different seeds."""
    one, two = F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)
    return F.unhex(F.concat(F.lpad(F.hex(one), 16, "0"), F.lpad(F.hex(two), 16, "0")))


def crowded(rows: DataFrame, bucket: str = "bucket") -> DataFrame:
    """The rows whose bucket has at least two of them, with the bucket's number of rows as ``n``."""
    counts = rows.groupBy(bucket).agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(counts, bucket)


def block_pairs(rows: DataFrame, n: str, row_key: str, size: int) -> DataFrame:
    """Deal the rows of groups of ``n`` rows to pairs of blocks (``p`` <= ``q``), so that any two rows of a group meet in one
    task and no task holds more than two blocks of about ``size`` rows. Adds p, q and the row's own block ``own``."""
    k = F.ceil(F.col(n) / F.lit(size)).cast("int")
    dealt = rows.withColumn("own", F.pmod(F.xxhash64(row_key), k).cast("int")).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), k - 1)))
    return dealt.withColumn("p", F.least("own", "_other")).withColumn("q", F.greatest("own", "_other")).drop("_other")


def map_groups(df: DataFrame, keys: list[str], step: Callable[[pa.Table, list[tuple[int, int]]], pa.RecordBatch], schema: str,
               rows: int = 4096, order: list[str] | None = None) -> DataFrame:
    """Bring the rows of a key together and call ``step`` with tables of whole groups and the groups' row ranges.

    Groups must be bounded; small ones are handed over many at a time."""
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *(order or []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < rows:
                continue
            table_ = pa.Table.from_batches(held).combine_chunks()
            starts = _group_starts(table_, keys)
            held = table_.slice(starts[-1]).combine_chunks().to_batches()
            if len(starts) > 1:
                yield step(table_.slice(0, starts[-1]), list(zip(starts[:-1], starts[1:], strict=True)))
        if held:
            table_ = pa.Table.from_batches(held).combine_chunks()
            if table_.num_rows:
                starts = _group_starts(table_, keys)
                yield step(table_, list(zip(starts, [*starts[1:], table_.num_rows], strict=True)))
        held, batch, table_ = [], None, None
        give_back()

    return ordered.mapInArrow(run, schema)


def _group_starts(table_: pa.Table, keys: list[str]) -> list[int]:
    changed = np.zeros(table_.num_rows, bool)
    changed[:1] = True
    for k in keys:
        column = table_.column(k).combine_chunks()
        if table_.num_rows > 1:
            same = pc.equal(column.slice(1), column.slice(0, len(column) - 1))
            changed[1:] |= ~np.asarray(pc.fill_null(same, False).to_numpy(zero_copy_only=False))
    return np.flatnonzero(changed).tolist()


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n items is connected with by the pairs (a, b)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, least)
        np.minimum.at(after, b, least)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def join_classes(rows: DataFrame, nodes: DataFrame, found: DataFrame, reach: DataFrame, key: str) -> DataFrame:
    """``key, n_links, component_id`` of each row (_id, node): other rows linked with it, and the smallest id it reaches.

    ``nodes`` (node, least, weight) stand for equal rows, ``found`` (node, links) sums the weights of linked nodes, ``reach``
    (node, component) groups them. A row without a node has no links and is a class of its own."""
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = nodes.select("node", "least", "weight").join(sums, "node", "left").join(reach, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = placed.join(least, "component").select(
        "node", "weight", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = attach(rows.select("_id", "node"), staged(placed, "nodes"), "node", "weight")
    return out.select(
        F.col("_id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "_id").alias("component_id"))
