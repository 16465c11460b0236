"""Trees, forests and boosted trees grown from counts of cells.

A tree that splits at fixed thresholds sees of a row only its cell: the interval of every feature, and the label. So the rows are counted
once per cell in a distributed pass, and trees grow from the counts, in tasks of a few trees each. How many cells there are follows
from features and thresholds and not from the rows; where there are more than ``MOST_CELLS``, fits stay with Spark ML, which reads all rows
per level. Thresholds, impurity, feature subsets, votes and pruning are those of Spark ML. A row's bootstrap weight is Poisson(1); the
weights of the n rows of one cell and class add up to Poisson(n), which is drawn at once. For numbers as labels every row gets its
weights, from a hash of its key, and a cell keeps the sums of weights and labels per tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import classification as K, regression as R
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

#: Thresholds of a feature are one fewer (Spark ML's default).
BINS = 32
#: Cells up to which trees grow from counts: a table of so many rows is broadcast.
MOST_CELLS = 50_000
#: Entries (trees x cells) that one task grows at a time.
ENTRIES = 50_000
#: Quantiles of a feature of many values that its thresholds are chosen from, and their accuracy.
POINTS, ACCURACY = 2_000, 20_000
#: Sums (trees x cells x 2) that one task adds up over the rows at a time.
SUMS = 4_000_000
#: Depth that Spark ML refuses to exceed.
DEEPEST = 30
#: A gain below this share of the split's own score is rounding.
NO_GAIN = 1e-12


@dataclass
class Settings:
    """What a forest takes; one tree sees all features and, unless ``bootstrap``, all rows."""

    trees: int
    depth: int
    leaf: int
    seed: int
    bootstrap: bool = True
    weighted: bool = False
    rate: float | None = None  # of boosting: each tree corrects those before it

    @staticmethod
    def of(estimator) -> Settings | None:
        """Those of a Spark ML estimator whose other parameters are at their defaults (weights of classes aside)."""
        forest = isinstance(estimator, K.RandomForestClassifier | R.RandomForestRegressor)
        boosted = isinstance(estimator, K.GBTClassifier)
        if not forest and not boosted and not isinstance(estimator, K.DecisionTreeClassifier | R.DecisionTreeRegressor):
            return None
        taken = {"numTrees", "maxIter", "stepSize", "maxDepth", "minInstancesPerNode", "seed", "cacheNodeIds", "weightCol"}
        if any(p.name not in taken and estimator.isSet(p) and estimator.getOrDefault(p) != estimator._defaultParamMap.get(p) for p in estimator.params):
            return None
        weighted = estimator.isSet("weightCol")
        if (weighted and estimator.getWeightCol() != "weight") or estimator.getMaxDepth() > DEEPEST:
            return None
        trees = estimator.getNumTrees() if forest else estimator.getMaxIter() if boosted else 1
        rate = estimator.getStepSize() if boosted else None
        return Settings(trees, estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), estimator.getSeed(), forest, weighted, rate)


@dataclass
class Trees:
    """Trees as arrays over their nodes; the first ``roots`` nodes are roots, a right child follows its left one, leaves have feature -1."""

    roots: int
    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def sums(self, bins: np.ndarray) -> np.ndarray:
        """Values of the leaves that each row of ``bins`` falls into, added up over the trees."""
        out = np.zeros((len(bins), self.value.shape[1]))
        for root in range(self.roots):
            node = np.full(len(bins), root)
            live = np.flatnonzero(self.feature[node] >= 0)
            while len(live):
                at = node[live]
                node[live] = self.left[at] + (bins[live, self.feature[at]] > self.split[at])
                live = live[self.feature[node[live]] >= 0]
            out += self.value[node]
        return out


def thresholds(rows: DataFrame) -> list[np.ndarray]:
    """Per feature: between all its values where they are few, else between quantiles; a row is left of a threshold that it does not exceed."""
    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                seen = seen or [np.zeros(0)] * v.shape[1]
                seen = [s if len(s) > BINS else np.unique(np.r_[s, v[:, i]])[:BINS + 1] for i, s in enumerate(seen)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(seen)), pa.int32()), pa.array(seen, pa.list_(pa.float64()))], names=["i", "seen"])

    values = rows.select(vector_to_array("features").alias("v"))
    parts = values.mapInArrow(few, "i int, seen array<double>").groupBy("i").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("seen"))
    found = {r["i"]: np.array(r["seen"]) for r in parts.collect()}  # one row per feature, some values per part
    out = [(s[:-1] + s[1:]) / 2 if len(s) <= BINS else None for _, s in sorted(found.items())]
    many = [i for i, t in enumerate(out) if t is None]
    if many:
        points = F.lit([(k + 0.5) / POINTS for k in range(POINTS)])
        cuts = values.agg(*[F.percentile_approx(F.get("v", F.lit(i)), points, F.lit(ACCURACY)).alias(f"q{i}") for i in many]).first()
        for i in many:
            out[i] = _even(*np.unique(np.array(cuts[f"q{i}"], dtype=float), return_counts=True))
    return out


def _even(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Thresholds between values, as near to even strides of the rows as the values allow (Spark ML's rule)."""
    stride, seen, aim, out = n.sum() / BINS, n[0], n.sum() / BINS, []
    for i in range(1, len(values)):
        before, seen = seen, seen + n[i]
        if abs(before - aim) < abs(seen - aim):
            out.append((values[i - 1] + values[i]) / 2)
            aim += stride
    return np.array(out)


def binned(v: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, v[:, i], side="left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8)


class Cells:
    """The counted cells of a table: ``bins`` (cells x features) and, for classes, ``counts`` (cells x classes)."""

    def __init__(self, rows: DataFrame, cuts: list[np.ndarray], bins: np.ndarray, counts: np.ndarray | None, weights: np.ndarray | None):
        self.rows, self.cuts, self.bins, self.counts, self.weights = rows, cuts, bins, counts, weights

    @staticmethod
    def of(rows: DataFrame, classes: int | None, cuts: list[np.ndarray] | None = None) -> Cells | None:
        """``rows``: row_id, features, label (``classes``: 0, 1, ...; None: numbers) and, with a weight per class, weight. None where there
        are too many cells."""
        cuts = cuts if cuts is not None else thresholds(rows)
        shared = rows.sparkSession.sparkContext.broadcast(cuts)

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    label = batch.column(1).to_numpy(zero_copy_only=False) if classes else np.zeros(batch.num_rows)
                    found, n = np.unique(np.column_stack([binned(v, shared.value), label.astype(np.uint8)]), axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in found], pa.binary()), pa.array(n, pa.int64())], names=["cell", "n"])

        one = rows.select(vector_to_array("features").alias("v"), F.col("label").cast("double"))
        counted = one.mapInArrow(keys, "cell binary, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        most = MOST_CELLS * (classes or 1)
        table = counted.limit(most + 1).collect()
        if not table or len(table) > most:
            return None
        cells = np.array([np.frombuffer(r["cell"], dtype=np.uint8) for r in table])
        bins, place = np.unique(cells[:, :-1], axis=0, return_inverse=True)
        if len(bins) > MOST_CELLS:
            return None
        counts = weights = None
        if classes:
            counts = np.zeros((len(bins), classes))
            np.add.at(counts, (place.ravel(), cells[:, -1]), [r["n"] for r in table])
            if "weight" in rows.columns:
                per_class = rows.groupBy("label").agg(F.first("weight").alias("weight")).collect()  # a row per class
                weights = np.ones(classes)
                weights[[int(r["label"]) for r in per_class]] = [r["weight"] for r in per_class]
        return Cells(rows, cuts, bins, counts, weights)

    def place(self, bins: np.ndarray) -> np.ndarray:
        """Numbers of the cells of rows that are all in one."""
        width = np.dtype((np.void, self.bins.shape[1]))
        return np.searchsorted(np.ascontiguousarray(self.bins).view(width).ravel(), np.ascontiguousarray(bins).view(width).ravel())


def grow(bins: np.ndarray, tree: np.ndarray, cell: np.ndarray, parts: np.ndarray, scale: np.ndarray | None, roots: int, settings: Settings,
         rng: np.random.Generator) -> Trees:
    """Trees from entries (tree, cell, parts), level by level and all at once. Parts are the counts per class, which ``scale`` weights, or,
    where ``scale`` is None, (weight, weight x label)."""
    width = bins.shape[1]
    among = width if settings.trees == 1 else math.ceil(width / 3 if scale is None else math.sqrt(width))
    nodes: list[list[np.ndarray]] = []  # per level: feature, split, left, value
    node, here, start = tree, roots, 0

    def score(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, sum of squares over the weight) along the last axis."""
        if scale is None:
            return sums[..., 0], np.divide(sums[..., 1] ** 2, sums[..., 0], out=np.zeros(sums.shape[:-1]), where=sums[..., 0] > 0)
        w = sums * scale
        whole = w.sum(-1)
        return sums.sum(-1), np.divide((w * w).sum(-1), whole, out=np.zeros(whole.shape), where=whole > 0)

    def add_up(index: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(index, of[:, k], size) for k in range(of.shape[1])], axis=-1)

    for level in range(settings.depth + 1):
        totals = add_up(node, parts, here)
        feature, split, left = np.full(here, -1, np.int16), np.zeros(here, np.uint8), np.zeros(here, np.int32)
        nodes.append([feature, split, left, totals])
        n, whole = score(totals)
        open_ = n >= 2 * settings.leaf
        if scale is not None:
            open_ &= (totals > 0).sum(-1) > 1
        if level == settings.depth or not open_.any():
            break
        # entries of nodes that may split, with those nodes numbered anew
        number = np.cumsum(open_) - 1
        keep = open_[node]
        node, cell, parts, live = number[node[keep]], cell[keep], parts[keep], np.flatnonzero(open_)
        whole, best = whole[live], np.zeros(len(live))
        take, at = np.full(len(live), -1, np.int16), np.zeros(len(live), np.uint8)
        chosen = rng.random((len(live), width)).argsort(axis=1)[:, :among] if among < width else None
        for f in range(width):
            top = int(bins[:, f].max()) + 1
            some = np.arange(len(live)) if chosen is None else np.flatnonzero((chosen == f).any(axis=1))
            if top < 2 or not len(some):
                continue
            if chosen is None:
                sums = add_up(node * top + bins[cell, f], parts, len(live) * top)
            else:
                slot = np.full(len(live), -1)
                slot[some] = np.arange(len(some))
                mine = slot[node]
                with_it = mine >= 0
                sums = add_up(mine[with_it] * top + bins[cell[with_it], f], parts[with_it], len(some) * top)
            below = sums.reshape(len(some), top, -1).cumsum(axis=1)
            above = below[:, -1:] - below[:, :-1]
            below = below[:, :-1]
            (n_below, s_below), (n_above, s_above) = score(below), score(above)
            both = s_below + s_above
            gain = both - whole[some, None]
            gain[(n_below < settings.leaf) | (n_above < settings.leaf) | (gain <= NO_GAIN * both)] = 0.0
            where = gain.argmax(axis=1)
            found = gain[np.arange(len(some)), where]
            better = found > best[some]
            best[some[better]], take[some[better]], at[some[better]] = found[better], f, where[better]
        split_ = take >= 0
        if not split_.any():
            break
        child = np.cumsum(split_) - 1
        feature[live], split[live] = take, at
        left[live[split_]] = start + here + 2 * child[split_]
        keep = split_[node]
        node, cell, parts = node[keep], cell[keep], parts[keep]
        node = 2 * child[node] + (bins[cell, take[node]] > at[node])
        start, here = start + here, 2 * int(split_.sum())
    feature, split, left, totals = (np.concatenate(x) for x in zip(*nodes, strict=True))
    if scale is None:
        value = totals[:, 1:] / np.maximum(totals[:, :1], 1e-300)
        said = value[:, 0]
    else:
        value = totals * scale
        said = value.argmax(axis=1)
        value = value / np.maximum(value.sum(axis=1, keepdims=True), 1e-300)
    # two leaves that say the same are one
    ends = np.cumsum([len(x[0]) for x in nodes])
    for i in range(len(nodes) - 2, -1, -1):
        inner = np.flatnonzero(feature[ends[i] - len(nodes[i][0]):ends[i]] >= 0) + ends[i] - len(nodes[i][0])
        low = left[inner]
        same = inner[(feature[low] < 0) & (feature[low + 1] < 0) & (said[low] == said[low + 1])]
        feature[same] = -1
    return Trees(roots, feature, split, left, value)


def _works(forests: list[Settings], cells: int) -> list[tuple[int, int, int]]:
    """(forest, first tree, trees) of the tasks, the deepest first."""
    size = max(1, ENTRIES // cells)
    out = [(i, a, min(size, s.trees - a)) for i, s in enumerate(forests) if s.rate is None for a in range(0, s.trees, size)]
    boosts = [(i, 0, s.trees) for i, s in enumerate(forests) if s.rate is not None]  # a tree waits for the one before it
    return sorted(boosts, key=lambda w: -w[2]) + sorted(out, key=lambda w: -forests[w[0]].depth)


def _drawn(counts: np.ndarray, settings: Settings, trees: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (tree, cell, counts) of some trees."""
    parts = rng.poisson(counts, (trees, *counts.shape)) if settings.bootstrap else np.broadcast_to(counts, (trees, *counts.shape))
    tree, cell = np.nonzero(parts.sum(-1))
    return tree, cell, parts[tree, cell].astype(float)


def _boosted(bins: np.ndarray, counts: np.ndarray, weights: np.ndarray, settings: Settings) -> list[Trees]:
    """Boosted trees for two classes by the loss of Spark ML, 2 log(1 + exp(-2 y F)) for y = -1 or 1: the rows of a cell and class share
    F and so what the next tree corrects. Trees are in order; all but the first count with the rate."""
    cell, side = np.nonzero(counts)
    weight, y = counts[cell, side] * weights[side], 2.0 * side - 1.0
    # weights stand for rows: a row of the lighter class is the least that a node may hold
    least = Settings(1, settings.depth, settings.leaf * float(weights[np.unique(side)].min()) * (1 - 1e-9), settings.seed, False)
    out: list[Trees] = []
    margin, target = np.zeros(len(bins)), y
    for _ in range(settings.trees):
        parts = np.column_stack([weight, weight * target])
        out.append(grow(bins, np.zeros(len(cell), np.int64), cell, parts, None, 1, least, np.random.default_rng(settings.seed)))
        margin += out[-1].sums(bins)[:, 0] * (1.0 if len(out) == 1 else settings.rate)
        target = 4.0 * y / (1.0 + np.exp(2.0 * y * margin[cell]))
    return out


def _margin(parts: list[Trees], bins: np.ndarray, rate: float) -> np.ndarray:
    return sum(t.sums(bins)[:, 0] * (rate if i else 1.0) for i, t in enumerate(parts))


def _grown(spark, cells: Cells, forests: list[Settings], done) -> list:
    """What ``done`` makes of the trees of each task: (forest, it), grown from the counts of classes."""
    shared = spark.sparkContext.broadcast((cells.bins, cells.counts, cells.weights, forests))

    def work(item: tuple[int, int, int]) -> tuple:
        i, first, trees = item
        bins, counts, weights, settings = shared.value
        rng, scale = np.random.default_rng([settings[i].seed, first]), weights if settings[i].weighted else np.ones(counts.shape[1])
        if settings[i].rate is not None:
            return i, done(_boosted(bins, counts, scale, settings[i]))
        return i, done(grow(bins, *_drawn(counts, settings[i], trees, rng), scale, trees, settings[i], rng))

    works = _works(forests, len(cells.bins))
    return spark.sparkContext.parallelize(works, len(works)).map(work).collect()


#: Poisson(1) in 2^32 parts: a hash below the first is 0, below the second 1, ...
_POISSON = np.array([round(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)], dtype=np.uint64)


def row_weights(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Bootstrap weights of rows in a tree, from a hash of key, tree and seed."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (1 + tree + (seed << 20))) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(_POISSON, (x ^ (x >> np.uint64(31))) >> np.uint64(32), side="right")


def _grown_numbers(spark, cells: Cells, settings: Settings) -> list[Trees]:
    """A forest for numbers: a pass adds up weights and labels per tree and cell, then the trees grow from the sums, each in a group."""
    size = len(cells.bins)
    middle = cells.rows.agg(F.avg("label").alias("m")).first()["m"]
    state = spark.sparkContext.broadcast((cells.cuts, cells.bins, middle))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, bins, mean = state.value
        held, sums = Cells(None, cuts, bins, None, None), np.zeros((last - first, 2, size))
        for batch in batches:
            if batch.num_rows:
                v = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                at, y = held.place(binned(v, cuts)), batch.column(1).to_numpy() - mean
                ids = batch.column(2).to_numpy()
                for t in range(first, last):
                    w = row_weights(ids, t, settings.seed) if settings.bootstrap else np.ones(len(ids))
                    sums[t - first, 0] += np.bincount(at, w, size)
                    sums[t - first, 1] += np.bincount(at, w * y, size)
        if sums.any():
            for t in range(first, last):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t], pa.int32()), pa.array([sums[t - first].ravel()], pa.list_(pa.float64()))], names=["tree", "sums"])

    def one(group: pa.Table) -> pa.Table:
        bins = state.value[1]
        t, sums = group.column("tree")[0].as_py(), np.zeros(2 * size)
        for chunk in group.column("sums").chunks:
            sums += chunk.flatten().to_numpy(zero_copy_only=False).reshape(len(chunk), -1).sum(axis=0)
        sums = sums.reshape(2, size)
        cell = np.flatnonzero(sums[0])
        made = grow(bins, np.zeros(len(cell), np.int64), cell, sums[:, cell].T, None, 1, settings, np.random.default_rng([settings.seed, t]))
        return pa.table({
            "tree": pa.array([t], pa.int32()), "feature": pa.array([made.feature.astype(np.int32)]), "split": pa.array([made.split.astype(np.int32)]),
            "left": pa.array([made.left]), "value": pa.array([made.value[:, 0]])})

    rows = cells.rows.select(vector_to_array("features").alias("v"), F.col("label").cast("double"), F.xxhash64("row_id").alias("id"))
    step, found = max(1, SUMS // (2 * size)), []
    for first in range(0, settings.trees, step):
        last = min(first + step, settings.trees)
        grown = rows.mapInArrow(add_up, "tree int, sums array<double>").groupBy("tree").applyInArrow(
            one, "tree int, feature array<int>, split array<int>, left array<int>, value array<double>")
        found += grown.collect()  # the model, a row per tree
    return [Trees(1, np.array(r["feature"], np.int16), np.array(r["split"], np.uint8), np.array(r["left"], np.int32), np.array(r["value"])[:, None] + middle)
            for r in found]


class ForestModel:
    """Fitted trees: ``prediction`` and, for classes, ``probability``."""

    def __init__(self, cuts: list[np.ndarray], parts: list[Trees], trees: int, classify: bool, rate: float | None = None):
        self.cuts, self.parts, self.trees, self.classify, self.rate, self._shared = cuts, parts, trees, classify, rate, None

    def transform(self, df: DataFrame) -> DataFrame:
        if self._shared is None:
            self._shared = df.sparkSession.sparkContext.broadcast((self.cuts, self.parts, self.trees, self.rate))
        shared = self._shared

        @F.pandas_udf("array<double>")
        def mean(vectors):
            import pandas as pd

            if not len(vectors):
                return pd.Series([], dtype=object)
            cuts, parts, trees, rate = shared.value
            bins, place = np.unique(binned(np.stack(vectors.to_numpy()), cuts), axis=0, return_inverse=True)
            if rate is None:
                found = sum(p.sums(bins) for p in parts) / trees
            else:
                one = 1.0 / (1.0 + np.exp(-2.0 * _margin(parts, bins, rate)))
                found = np.column_stack([1.0 - one, one])
            return pd.Series(list(found[place.ravel()]))

        out = df.withColumn("__mean", mean(vector_to_array("features")))
        if not self.classify:
            return out.withColumn("prediction", F.get("__mean", F.lit(0))).drop("__mean")
        said = (F.array_position("__mean", F.array_max("__mean")) - 1).cast("double")
        return out.withColumns({"prediction": said, "probability": array_to_vector("__mean")}).drop("__mean")


def fit_all(cells: Cells, forests: dict[str, Settings]) -> dict[str, ForestModel]:
    """All forests over one table, grown together."""
    if cells.counts is not None and cells.counts.shape[1] != 2:
        forests = {n: s for n, s in forests.items() if s.rate is None}
    spark, names, settings = cells.rows.sparkSession, list(forests), list(forests.values())
    if cells.counts is None:
        return {n: ForestModel(cells.cuts, _grown_numbers(spark, cells, s), s.trees, False) for n, s in forests.items()}
    parts: dict[int, list[Trees]] = {}
    for i, made in _grown(spark, cells, settings, lambda trees: trees):
        parts.setdefault(i, []).extend(made if isinstance(made, list) else [made])
    return {n: ForestModel(cells.cuts, parts[i], settings[i].trees, True, settings[i].rate) for i, n in enumerate(names)}


def f1_macro(confusion: np.ndarray) -> float | None:
    """As ``metrics.classification_metrics`` has it, from counts of classes (rows) and what they were given (columns)."""
    actual, called, hit = confusion.sum(axis=1), confusion.sum(axis=0), confusion.diagonal()
    seen = (actual > 0) | (called > 0)
    return round(float((2 * hit[seen] / (actual + called)[seen]).mean()), 6) if seen.any() else None


def confusions(cells: Cells, test: Cells, forests: list[Settings]) -> list[np.ndarray]:
    """Per forest: how many rows of ``test`` have a class (rows) and are given one (columns)."""
    spark = cells.rows.sparkSession
    asked = spark.sparkContext.broadcast(test.bins)
    votes = [np.zeros((len(test.bins), cells.counts.shape[1])) for _ in forests]
    for i, sums in _grown(spark, cells, forests, lambda trees: trees.sums(asked.value)):
        votes[i] += sums
    out = []
    for v in votes:
        said = v.argmax(axis=1)
        out.append(np.stack([test.counts[said == c].sum(axis=0) for c in range(v.shape[1])], axis=1))
    return out
