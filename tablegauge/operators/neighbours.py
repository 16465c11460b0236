"""Exact nearest neighbours and the k-NN mutual information estimate, without pairing rows with rows.

Data points are grouped by cuts between points taken from the data or, in many dimensions, around a bounded set of centres, so groups
follow its density. A query is first answered in its own group, which bounds its k-th distance; it then only needs groups whose box
or, by the triangle inequality, whose ball reaches into that bound. Large groups are cut into blocks, and query groups into chunks, so no task holds
an unbounded group. Distances are computed with numpy inside a block; at most k per query and block leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablegauge.functions import columns as C
from tablegauge.operators import ordered
from tablegauge.operators.hypothesis import _status
from tablegauge.session import staged

MAX_CENTRES = 4096
CELL = 10_000  # points of a group; more groups would send a query of many dimensions to more tasks
BLOCK = 20_000
CHUNK = 20_000
CELLS_PER_STEP = 1_000_000  # numbers held by one distance matrix
LEAF = 48  # points of the smallest groups inside a task
FEW = 8  # dimensions in which boxes tell groups apart in any case
BOXED = 64  # dimensions in which a group keeps its box
CUT = 16  # dimensions in which groups are made by cuts
TAKEN, MOST_TAKEN = 16, 1_000_000  # points per group that tell where to cut, and numbers of all of them
PROBE, READ = 256, 0.25  # queries that tell whether leaves are worth while, and the share of the leaves they may read then
SLACK = 1e-9

MI_K = 3  # fixed value
MI_MIN_ROWS = 5  # fixed value
MI_ROUND = 10


def _distance(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    gap = a[:, None, :] - b[None, :, :]
    if metric == "chebyshev":
        return np.abs(gap).max(axis=2)
    return np.sqrt((gap * gap).sum(axis=2))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a column of arrays of one length."""
    if isinstance(column, pa.ChunkedArray):
        return np.concatenate([_matrix(c) for c in column.chunks]) if column.num_chunks else np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _vectors(v: np.ndarray) -> pa.Array:
    return _lists(np.ascontiguousarray(v).ravel(), np.arange(len(v) + 1) * v.shape[1])


def _numbers(column: pa.Array | pa.ChunkedArray, missing: float) -> np.ndarray:
    found = (column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)).astype(float)
    return np.where(np.isnan(found), missing, found)


def _about(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances of rows to centres by a matrix product, their rounding error per row)."""
    middle = centres.mean(0)
    c, q = centres - middle, v - middle
    c2, q2 = (c * c).sum(1), (q * q).sum(1)
    error = 16 * (v.shape[1] + 8) * np.finfo(float).eps * (np.sqrt(q2) + np.sqrt(c2.max())) ** 2
    out = q @ c.T
    out *= -2.0
    out += c2
    out += q2[:, None]
    return out, error


def _by_products(v: np.ndarray, centres: np.ndarray, metric: str) -> bool:
    return metric == "euclidean" and v.shape[1] > 2 and bool(np.isfinite(v).all() and np.isfinite(centres).all())


def _own_centre(v: np.ndarray, centres: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(a centre near each row, the distance to it). Any centre will do; the distance is exact."""
    if not _by_products(v, centres, metric):
        d = _distance(v, centres, metric)
        return d.argmin(axis=1), d.min(axis=1)
    cell = _about(v, centres)[0].argmin(axis=1)
    gap = v - centres[cell]
    return cell, np.sqrt((gap * gap).sum(axis=1))


def _near_balls(v: np.ndarray, centres: np.ndarray, radius: np.ndarray, limit: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, centre) of all balls that reach into a row's limit; by products a few more."""
    if not _by_products(v, centres, metric):
        return np.nonzero(_distance(v, centres, metric) - radius <= limit[:, None])
    about, error = _about(v, centres)
    reach = np.add.outer(limit, radius)
    reach *= reach
    reach += error[:, None]
    return np.nonzero(about <= reach)


def _pair_box_distance(v: np.ndarray, low: np.ndarray, high: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row to its own box."""
    gap = np.maximum(np.maximum(low - v, v - high), 0.0)
    return gap.max(axis=1) if metric == "chebyshev" else np.sqrt((gap * gap).sum(axis=1))


def _steps(rows: int, width: int) -> Iterator[slice]:
    size = max(1, CELLS_PER_STEP // max(1, width))
    for start in range(0, rows, size):
        yield slice(start, start + size)


def _first_of_each(row: np.ndarray, point: np.ndarray, distance: np.ndarray, ids: np.ndarray, k: int):
    """At most k entries per row, nearest first, ties by id."""
    order = np.lexsort((ids[point], distance, row))
    row, point, distance = row[order], point[order], distance[order]
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
    return row[place < k], point[place < k], distance[place < k]


def _leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Point numbers in groups of about ``size`` neighbours: strips of the first dimension, cut along the second; in more dimensions
    cuts across the widest one, between two values where there are several."""
    if points.shape[1] > 2:
        return _cuts(points, size)
    order = np.argsort(points[:, 0], kind="stable")
    count = max(1, len(points) // size)
    if points.shape[1] == 1:
        return np.array_split(order, count)
    strips = max(1, math.isqrt(count))
    out = []
    for strip in np.array_split(order, strips):
        out += np.array_split(strip[np.argsort(points[strip, 1], kind="stable")], max(1, count // strips))
    return out


def _cuts(points: np.ndarray, size: int) -> list[np.ndarray]:
    out, left = [], [np.arange(len(points))]
    while left:
        some = left.pop()
        if len(some) <= size:
            out.append(some)
            continue
        spread = np.ptp(points[some], axis=0)
        wide = int(np.argmax(spread))
        if not spread[wide] > 0:  # copies of one point
            out += np.array_split(some, math.ceil(len(some) / size))
            continue
        some = some[np.argsort(points[some, wide], kind="stable")]
        steps = np.flatnonzero(np.diff(points[some, wide])) + 1
        if not len(steps):
            out.append(some)
            continue
        cut = steps[np.abs(steps - len(some) / 2).argmin()]
        left += [some[:cut], some[cut:]]
    return out


class _Cuts:
    """Groups made by cuts across the widest dimension of the points that tell: nodes with a dimension, a value that the right side
    begins with, and a left child that its right one follows; a leaf has a group."""

    def __init__(self, points: np.ndarray, groups: int):
        dim, at, left, group = [-1], [0.0], [0], [-1]
        todo, self.groups = [(0, points, groups)], 0
        while todo:
            node, some, wanted = todo.pop()
            steps = np.zeros(0, dtype=np.int64)
            if wanted > 1 and len(some) > 1:
                dim[node] = int(np.argmax(np.ptp(some, axis=0)))
                some = some[np.argsort(some[:, dim[node]], kind="stable")]
                steps = np.flatnonzero(np.diff(some[:, dim[node]])) + 1
            if not len(steps):
                dim[node], group[node], self.groups = -1, self.groups, self.groups + 1
                continue
            cut = int(steps[np.abs(steps - len(some) / 2).argmin()])
            share = min(wanted - 1, max(1, round(wanted * cut / len(some))))
            at[node], left[node] = float(some[cut, dim[node]]), len(dim)
            todo += [(len(dim), some[:cut], share), (len(dim) + 1, some[cut:], wanted - share)]
            dim, at, left, group = dim + [-1, -1], at + [0.0, 0.0], left + [0, 0], group + [-1, -1]
        self.dim, self.at, self.left, self.group = np.array(dim), np.array(at), np.array(left), np.array(group, dtype=np.int32)

    def assign(self, v: np.ndarray) -> np.ndarray:
        node = np.zeros(len(v), dtype=np.int64)
        live = np.flatnonzero(self.dim[node] >= 0)
        while len(live):
            here = node[live]
            node[live] = self.left[here] + (v[live, self.dim[here]] >= self.at[here])
            live = live[self.dim[node[live]] >= 0]
        return self.group[node]

    def boxes(self, known: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Boxes of all nodes from those of the groups that hold points."""
        self.low, self.high = np.full((len(self.dim), low.shape[1]), np.inf), np.full((len(self.dim), low.shape[1]), -np.inf)
        place = np.full(self.groups, -1)
        place[known] = np.arange(len(known))
        for node in range(len(self.dim) - 1, -1, -1):
            if self.dim[node] >= 0:
                pair = slice(self.left[node], self.left[node] + 2)
                self.low[node], self.high[node] = self.low[pair].min(axis=0), self.high[pair].max(axis=0)
            elif place[self.group[node]] >= 0:
                self.low[node], self.high[node] = low[place[self.group[node]]], high[place[self.group[node]]]

    def near(self, v: np.ndarray, limit: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
        """(row, group) of all groups whose box reaches into a row's limit."""
        row, node, rows, groups = np.arange(len(v)), np.zeros(len(v), dtype=np.int64), [], []
        while len(row):
            leaf = self.dim[node] < 0
            rows.append(row[leaf])
            groups.append(self.group[node[leaf]])
            row, below = np.repeat(row[~leaf], 2), np.repeat(self.left[node[~leaf]], 2)
            below[1::2] += 1
            keep = _pair_box_distance(v[row], self.low[below], self.high[below], metric) <= limit[row]
            row, node = row[keep], below[keep]
        return np.concatenate(rows), np.concatenate(groups)


def _box_distance(v: np.ndarray, low: np.ndarray, high: np.ndarray, metric: str) -> np.ndarray:
    """Distance of every row to every box, never above that to a point in the box."""
    total = np.zeros((len(v), len(low)))
    for i in range(v.shape[1]):
        gap = np.maximum(np.maximum(low[:, i] - v[:, i, None], v[:, i, None] - high[:, i]), 0.0)
        total = np.maximum(total, gap) if metric == "chebyshev" else total + gap * gap
    return total if metric == "chebyshev" else np.sqrt(total)


def _leaf_reach(q: np.ndarray, points: np.ndarray, leaves: list[np.ndarray], away: np.ndarray, k: int, metric: str, bound: np.ndarray) -> np.ndarray:
    """A distance within which each query has k points, from the leaf nearest to it; never above ``bound``."""
    reach, home = bound.copy(), away.argmin(axis=1)
    order = np.argsort(home, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
        near = points[leaves[home[rows[0]]]]
        if len(near) < k:
            continue
        for some in _steps(len(rows), near.size):
            kth = np.partition(_distance(q[rows[some]], near, metric), k - 1, axis=1)[:, k - 1]
            reach[rows[some]] = np.minimum(reach[rows[some]], kth)
    return reach


def _nearest_in_leaves(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, metric: str, bound: np.ndarray,
                       share: float = 1.0):
    """The leaf nearest to a query bounds its k-th distance, then only leaves within that bound are read. None where the first
    queries read more than ``share`` of the leaves."""
    leaves = _leaves(points, max(LEAF, 2 * k))
    low, high = np.array([points[i].min(0) for i in leaves]), np.array([points[i].max(0) for i in leaves])
    if share < 1.0 and len(queries):
        q = queries[:PROBE]
        away = _box_distance(q, low, high, metric)
        if (away <= (_leaf_reach(q, points, leaves, away, k, metric, bound[:PROBE]) * (1 + SLACK))[:, None]).mean() > share:
            return None
    found = []
    for part in _steps(len(queries), len(leaves)):
        q = queries[part]
        away = _box_distance(q, low, high, metric)
        reach = _leaf_reach(q, points, leaves, away, k, metric, bound[part])
        leaf, row = np.nonzero((away <= (reach * (1 + SLACK))[:, None]).T)
        for group in np.split(np.arange(len(leaf)), np.flatnonzero(np.diff(leaf)) + 1) if len(leaf) else []:
            rows, near = row[group], leaves[leaf[group[0]]]
            for some in _steps(len(rows), points[near].size):
                d = _distance(q[rows[some]], points[near], metric)
                r, c = np.nonzero(d <= reach[rows[some]][:, None])
                found.append((rows[some][r] + part.start, near[c], d[r, c]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return _first_of_each(*(np.concatenate(x) for x in zip(*found, strict=True)), ids, k)


def _nearest_by_products(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, bound: np.ndarray):
    """Many dimensions: squared distances by a matrix product tell, within its rounding error, which points can be among the k
    nearest; distances of those are computed from the differences."""
    middle = points.mean(0)
    p, q = points - middle, queries - middle
    p2, q2 = (p * p).sum(1), (q * q).sum(1)
    k = min(k, len(points))
    error = 16 * (points.shape[1] + 8) * np.finfo(float).eps * (np.sqrt(q2) + np.sqrt(p2.max())) ** 2
    found = []
    for part in _steps(len(q), len(p)):
        about = q2[part, None] + p2 - 2.0 * (q[part] @ p.T)
        kth = np.minimum(np.partition(about, k - 1, axis=1)[:, k - 1], bound[part] ** 2)
        r, c = np.nonzero(about <= (kth + 2 * error[part])[:, None])
        for some in _steps(len(r), points.shape[1]):
            gap = queries[part][r[some]] - points[c[some]]
            found.append((r[some] + part.start, c[some], np.sqrt((gap * gap).sum(axis=1))))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return _first_of_each(*(np.concatenate(x) for x in zip(*found, strict=True)), ids, k)


def _local_nearest(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, metric: str, bound: np.ndarray):
    """(query number, point number, distance) of the k nearest points per query; ties by id. Points that are farther than ``bound``
    may be left out."""
    if metric == "euclidean" and points.shape[1] > FEW and np.isfinite(points).all() and np.isfinite(queries).all():
        found = _nearest_in_leaves(queries, points, ids, k, metric, bound, READ)
        return _nearest_by_products(queries, points, ids, k, bound) if found is None else found
    return _nearest_in_leaves(queries, points, ids, k, metric, bound)


def nearest(queries: DataFrame, data: DataFrame, k: int, metric: str = "euclidean", centres: int | None = None,
            block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(qid, v, neighbours): the k nearest data points of every query, nearest first, ties by point id.

    ``queries``: qid long, v array<double>. ``data``: pid long, v array<double>, payload double. ``neighbours`` is
    array<struct<distance, pid, payload>>.
    """
    spark = data.sparkSession
    total = data.count()
    centres = centres or max(1, min(MAX_CENTRES, math.ceil(total / CELL)))
    first = data.select("v").first()
    if not first:
        empty = F.array().cast("array<struct<distance:double,pid:long,payload:double>>")
        return queries.select("qid", "v", empty.alias("neighbours"))
    width = len(first["v"])
    by_cuts = width <= CUT
    if by_cuts:
        # a fixed sample: the rows whose id has a small hash
        wanted = min(centres * TAKEN, max(2 * centres, MOST_TAKEN // width))
        least = F.lit(-(2**63) + min(2**64 - 1, 2**64 * wanted // total))
        picked = [first, *data.where(F.xxhash64("pid") <= least).select("v").collect()]
        middle = spark.sparkContext.broadcast(_Cuts(np.array([r["v"] for r in picked], dtype=float), centres))
    else:
        # a fixed sample: the rows with the smallest hashes of their id
        picked = data.orderBy(F.xxhash64("pid"), "pid").limit(centres).select("v").collect()
        middle = spark.sparkContext.broadcast(np.unique(np.array([r["v"] for r in picked], dtype=float), axis=0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            v = _matrix(rows.column("v"))
            cell, away = np.empty(len(v), dtype=np.int32), np.zeros(len(v))
            if by_cuts:
                cell[:] = middle.value.assign(v)
            else:
                for part in _steps(len(v), len(middle.value) * (1 if metric == "euclidean" else v.shape[1])):
                    cell[part], away[part] = _own_centre(v[part], middle.value, metric)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell), pa.array(away)], names=[*rows.schema.names, "cell", "away"])

    points = data.select("pid", "v", "payload").mapInArrow(
        assign, "pid long, v array<double>, payload double, cell int, away double"
    )
    points = staged(points, "points")
    asked = queries.select("qid", "v").mapInArrow(assign, "qid long, v array<double>, cell int, away double")
    asked = staged(asked.drop("away"), "asked")
    boxed = range(width if width <= BOXED else 0)
    sizes = {r["cell"]: r for r in points.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("away").alias("radius"), *[
            e(F.get("v", F.lit(i))).alias(f"{name}{i}") for i in boxed for name, e in (("low", F.min), ("high", F.max))],
    ).collect()}  # one row per centre
    blocks = {c: max(1, math.ceil(r["n"] / block)) for c, r in sizes.items()}
    known = np.array(sorted(sizes), dtype=np.int32)
    sides = [np.array([[sizes[c][f"{side}{i}"] for i in boxed] for c in known], dtype=float) for side in ("low", "high")]
    if by_cuts:
        middle.value.boxes(known, *sides)
        reach = spark.sparkContext.broadcast(middle.value)
    else:
        reach = spark.sparkContext.broadcast((known, np.array([sizes[c]["radius"] for c in known]), *sides))
    block_rows = spark.createDataFrame(list(blocks.items()), "cell int, blocks int")  # one row per centre

    def search(visits: DataFrame) -> DataFrame:
        """Answer (qid, v, cell, bound) visits block by block: rows (qid, found)."""
        asked_per_cell = visits.groupBy("cell").agg(F.count("*").alias("q"))  # one row per centre
        plan = F.broadcast(asked_per_cell.join(F.broadcast(block_rows), "cell").select(
            "cell", F.greatest(F.lit(1), F.ceil(F.col("q") / chunk)).cast("int").alias("chunks"), "blocks"))
        whole = "cell", "block", "chunk"
        left = visits.join(plan, "cell").select(
            "cell",
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
            F.pmod(F.xxhash64("qid"), F.col("chunks")).cast("int").alias("chunk"),
            F.lit(True).alias("is_query"), F.col("qid").alias("id"), "v", F.col("bound").alias("payload"),
        )
        right = points.join(plan, "cell").select(
            "cell",
            F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int").alias("block"),
            F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
            F.lit(False).alias("is_query"), F.col("pid").alias("id"), "v", "payload",
        )

        def answer(group: pa.Table) -> pa.Table:
            asking = group.column("is_query")
            mine, theirs = group.filter(asking), group.filter(pc.invert(asking))
            row = point = np.zeros(0, dtype=np.int64)
            distance, ids, payload = np.zeros(0), theirs.column("id").to_numpy(), _numbers(theirs.column("payload"), np.nan)
            if mine.num_rows and theirs.num_rows:
                row, point, distance = _local_nearest(
                    _matrix(mine.column("v")), _matrix(theirs.column("v")), ids, k, metric, _numbers(mine.column("payload"), np.inf))
            ends = np.searchsorted(row, np.arange(mine.num_rows + 1))  # none found: an empty list
            return pa.table({
                "qid": mine.column("id"), "v": mine.column("v"), "cell": group.column("cell")[:1].take(pa.array(np.zeros(mine.num_rows, dtype=np.int64))),
                "distance": _lists(distance, ends), "pid": _lists(ids[point], ends), "payload": _lists(payload[point], ends)})

        answered = left.unionByName(right).groupBy(*whole).applyInArrow(
            answer, "qid long, v array<double>, cell int, distance array<double>, pid array<long>, payload array<double>"
        )
        return answered.select("qid", "v", "cell", F.arrays_zip("distance", "pid", "payload").alias("found"))

    def best(rows: DataFrame) -> DataFrame:
        found = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k).alias("found")
        return rows.groupBy("qid").agg(F.first("v").alias("v"), F.first("cell").alias("cell"), found)

    own = search(asked.withColumn("bound", F.lit(None).cast("double")))
    home = staged(own if max(blocks.values()) == 1 else best(own), "home")  # from one block a query has one answer
    bounded = home.select(
        "qid", "v", "cell",
        F.when(F.size("found") >= k, F.try_element_at("found", F.lit(k))["distance"]).alias("bound"),
    )

    def visit(qid: np.ndarray, v: np.ndarray, cell: np.ndarray, limit: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(qid), _vectors(v), pa.array(cell), pa.array(limit)], names=["qid", "v", "cell", "bound"])

    def other_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            v, qid, own = _matrix(rows.column("v")), rows.column("qid").to_numpy(), rows.column("cell").to_numpy()
            limit = _numbers(rows.column("bound"), np.inf) * (1 + SLACK) + SLACK
            if by_cuts:
                q, c = reach.value.near(v, limit, metric)
                q, c = q[c != own[q]], c[c != own[q]]
                for some in _steps(len(q), v.shape[1]):
                    yield visit(qid[q[some]], v[q[some]], c[some], limit[q[some]])
                continue
            cells, radius, low, high = reach.value
            for part in _steps(len(v), len(cells) * (1 if metric == "euclidean" else v.shape[1])):
                near = _near_balls(v[part], middle.value[cells], radius, limit[part], metric)
                for some in _steps(len(near[0]), v.shape[1]):
                    q, c = near[0][some] + part.start, near[1][some]
                    keep = cells[c] != own[q]
                    if low.size:
                        keep &= _pair_box_distance(v[q], low[c], high[c], metric) <= limit[q]
                    q, c = q[keep], c[keep]
                    if len(q):
                        yield visit(qid[q], v[q], cells[c], limit[q])

    visits = bounded.mapInArrow(other_cells, "qid long, v array<double>, cell int, bound double")
    everything = best(home.unionByName(search(visits)))
    return everything.where(F.size("found") > 0).select("qid", "v", F.col("found").alias("neighbours"))


def knn_predict(neighbours: DataFrame, k: int, classify: bool) -> DataFrame:
    """(qid, prediction) from neighbour lists of at least k: mean, or the most frequent label (ties: smallest)."""
    near = F.slice("neighbours", 1, k)
    labels = F.transform(near, lambda s: s["payload"])
    if not classify:
        return neighbours.select(
            "qid", (F.aggregate(labels, F.lit(0.0), lambda a, x: a + x) / F.size(labels)).alias("prediction")
        )
    votes = F.transform(
        F.array_distinct(labels),
        lambda v: F.struct((-F.size(F.filter(labels, lambda x: x == v))).alias("votes"), v.alias("label")),
    )
    return neighbours.select("qid", F.array_min(votes)["label"].alias("prediction"))


# --- k-NN mutual information --------------------------------------------------------------------------------------


def digamma(x: Column) -> Column:
    """Digamma of x >= 1 as a column expression: six recurrence steps, then the asymptotic series."""
    shifted = x + 6.0
    inverse = 1.0 / (shifted * shifted)
    # fixed values: series coefficients of digamma
    series = inverse * (1 / 12 - inverse * (1 / 120 - inverse * (1 / 252 - inverse * (1 / 240 - inverse / 132))))
    steps = sum((1.0 / (x + float(i)) for i in range(1, 6)), 1.0 / x)
    return F.log(shifted) - 0.5 / shifted - series - steps


def _open_interval(centre: pd.Series, eps: pd.Series) -> pd.DataFrame:
    """Smallest and largest doubles whose computed distance to the centre is below eps (the centre itself for 0)."""
    c, e = centre.to_numpy(float), eps.to_numpy(float)
    high, low = c + e, c - e
    for _ in range(4):  # move to the first value at distance >= eps, then step inside
        high = np.where(np.nextafter(high, -np.inf) - c >= e, np.nextafter(high, -np.inf), high)
        low = np.where(c - np.nextafter(low, np.inf) >= e, np.nextafter(low, np.inf), low)
    for _ in range(4):
        high = np.where(high - c < e, np.nextafter(high, np.inf), high)
        low = np.where(c - low < e, np.nextafter(low, -np.inf), low)
    zero = e == 0
    return pd.DataFrame({
        "low": np.where(zero, c, np.nextafter(low, np.inf)), "high": np.where(zero, c, np.nextafter(high, -np.inf)),
    })


INTERVAL = T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])
open_interval = F.pandas_udf(_open_interval, INTERVAL)


def _range_counts(points: DataFrame) -> DataFrame:
    """(pid, axis, inside): rows whose value on the axis lies in the point's interval.

    Interval ends are placed among the data values by running counts. Edges are sketched over values and ends together,
    so ends crowding around a hot value are spread as well.
    """
    sides = []
    for axis in ("x", "y"):
        span = open_interval(F.col(axis), F.col("eps"))
        sides.append(points.select("pid", "n", F.lit(axis).alias("axis"), F.col(axis).alias("at"), span.alias("span")))
    both = sides[0].unionByName(sides[1])
    marks = both.select(
        "axis",
        F.inline(
            F.array(
                F.struct(F.col("at").alias("x"), F.lit(0).alias("kind"), F.col("n").alias("n"), F.lit(None).cast("long").alias("pid")),
                F.struct(F.col("span.low").alias("x"), F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("n"), F.col("pid").alias("pid")),
                F.struct(F.col("span.high").alias("x"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("n"), F.col("pid").alias("pid")),
            )
        ),
    )
    named = marks.withColumns(
        {"vx": F.when(F.col("axis") == "x", F.col("x")), "vy": F.when(F.col("axis") == "y", F.col("x"))}
    )
    edges = ordered.sketch_edges(named, {"vx": F.col("vx"), "vy": F.col("vy")})
    cut = ordered.assign_buckets(named, edges)
    cut = cut.withColumn("bucket", F.when(F.col("axis") == "x", F.col("vx__bucket")).otherwise(F.col("vy__bucket")).cast("int"))
    # equal (value, kind) marks of data collapse to one row; ends keep their point
    data = cut.where(F.col("kind") == 0).groupBy("axis", "bucket", "x", "kind").agg(F.sum("n").alias("n"))
    ends = cut.where(F.col("kind") != 0).select("axis", "bucket", "x", "kind", "n", "pid")
    rows = data.withColumn("pid", F.lit(None).cast("long")).unionByName(ends)
    place = F.struct("x", "kind", F.coalesce("pid", F.lit(-1)).alias("pid"))
    counted = ordered.running_counts(rows.withColumn("place", place), ["axis"], value="place")
    # kind -1 sits before equal data (rows strictly below), kind 1 after it (rows at or below)
    return (
        counted.where(F.col("kind") != 0)
        .groupBy("pid", "axis")
        .agg(F.sum(F.col("kind") * F.col("below")).alias("inside"))
    )


def knn_mutual_information(df: DataFrame, a: str, b: str, k: int = MI_K, standardise: bool = False,
                           centres: int | None = None) -> DataFrame:
    """Kraskov estimate (first variant, Chebyshev distance) in nats: one row (column_a, column_b, k, n, status, value).

    Negative estimates are reported as 0 with ``raw`` kept.
    """
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    x, y = C.finite(C.as_number(df, a)), C.finite(C.as_number(df, b))
    pairs = df.select(x.alias("x"), y.alias("y")).where(C.complete(F.col("x"), F.col("y")))
    if standardise:
        m = pairs.agg(
            F.avg("x").alias("mx"), F.stddev_pop("x").alias("sx"), F.avg("y").alias("my"), F.stddev_pop("y").alias("sy")
        ).first()
        if m["sx"] and m["sy"]:
            pairs = pairs.select(
                ((F.col("x") - F.lit(m["mx"])) / F.lit(m["sx"])).alias("x"),
                ((F.col("y") - F.lit(m["my"])) / F.lit(m["sy"])).alias("y"),
            )
    distinct = pairs.groupBy("x", "y").agg(F.count("*").alias("n"))
    facts = distinct.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"),
        F.min("y").alias("y0"), F.max("y").alias("y1"),
    ).first()
    spark, total = df.sparkSession, facts["n"]
    schema = "column_a string, column_b string, k int, n long, status string, raw double, mutual_information double"
    if total < max(MI_MIN_ROWS, k + 1) or facts["x0"] == facts["x1"] or facts["y0"] == facts["y1"]:
        return spark.createDataFrame([(a, b, k, total, "unavailable", None, None)], schema)
    # distinct points are numbered once and written, so that no two share a number and none changes it
    keyed = staged(distinct.withColumn("pid", F.monotonically_increasing_id()), "numbered")
    vector = F.array("x", "y").alias("v")
    found = nearest(
        keyed.select(F.col("pid").alias("qid"), vector),
        keyed.select("pid", vector, F.col("n").cast("double").alias("payload")),
        k + 1,
        "chebyshev",
        centres,
    )
    # walk the neighbours outwards until k rows other than the point's own are covered
    state = "struct<seen:double,eps:double>"
    start = F.struct(F.lit(-1.0).alias("seen"), F.lit(None).cast("double").alias("eps")).cast(state)
    walk = F.aggregate(
        F.array_sort(F.col("neighbours")),
        start,
        lambda acc, s: F.struct(
            (acc["seen"] + s["payload"]).alias("seen"),
            F.coalesce(acc["eps"], F.when(acc["seen"] + s["payload"] >= k, s["distance"])).alias("eps"),
        ).cast(state),
    )
    eps = found.select(F.col("qid").alias("pid"), walk["eps"].alias("eps"))
    points = staged(keyed.join(eps, "pid"), "eps")
    counts = _range_counts(points)
    terms = counts.select("pid", digamma(F.col("inside").cast("double")).alias("psi"))  # inside counts the point itself
    mean = terms.join(points.select("pid", "n"), "pid").agg((F.sum(F.col("psi") * F.col("n")) / F.lit(float(total))).alias("mean"))
    raw = F.round(digamma(F.lit(float(k))) + digamma(F.lit(float(total))) - F.col("mean"), MI_ROUND)
    return mean.select(
        F.lit(a).alias("column_a"),
        F.lit(b).alias("column_b"),
        F.lit(k).alias("k"),
        F.lit(total).cast("long").alias("n"),
        _status(raw.isNotNull()).alias("status"),
        raw.alias("raw"),
        F.greatest(F.lit(0.0), raw).alias("mutual_information"),
    )


def datetime_mutual_information(df: DataFrame, time: str, other: str, k: int = MI_K, centres: int | None = None) -> DataFrame:
    """The same estimate with a timestamp side: seconds since 1970 in UTC, both sides standardised."""
    if not C.is_datetime_type(df.schema[time].dataType):
        raise ValueError(f"{time!r} is not a datetime column")
    return knn_mutual_information(df, time, other, k, standardise=True, centres=centres)
