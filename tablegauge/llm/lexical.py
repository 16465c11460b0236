"""Ranked lexical search with the Best Position Algorithm.

Every document is an entry in the impact list of each of its terms; a list is sorted by what the term adds to a score. An item
reads the lists of its terms from the top, in step. A document met in one list is scored at once by direct accesses to the
others, which also mark its positions there as seen. A list's best position is the last one up to which all are seen; the
scores at the best positions add up to a bound for every document not met yet. An item is done when that bound is strictly
below its k-th score, or its lists are read: documents of equal score are ranked by id, so a bound that ties must go on.

On Spark the documents are dealt to blocks of bounded size. Corpus counts come from all documents; each block has its own
lists and gives its k best documents per item, and the best of those are the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablegauge.llm.common import as_bytes, map_texts, table
from tablegauge.llm.decontamination import words
from tablegauge.session import staged

#: Documents whose impact lists one task holds at once, and entries that end a block earlier.
BLOCK_DOCS, BLOCK_ENTRIES = 20_000, 4_000_000
#: Terms of items that one pass over the documents looks for; more items take further passes.
MAX_TERMS = 500_000
#: Positions that an item reads at once from each of its lists, at first.
DEPTH = 16


class Lists:
    """Impact lists of a block of documents. Entries come by document: entry e is term ``term[e]`` with impact ``impact[e]``."""

    def __init__(self, starts: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int):
        self.starts, self.term, self.impact = starts, term, impact
        doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        order = np.lexsort((-impact, term))
        self.begin = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.doc, self.sorted_impact = doc[order], impact[order]
        self.position = np.empty(len(order), np.int64)  # of each entry, in its term's list
        self.position[order] = np.arange(len(order)) - self.begin[term[order]]

    def entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries of the documents, for each the number of its document among them)."""
        n = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(n)
        return np.repeat(self.starts[docs] - ends + n, n) + np.arange(n.sum()), np.repeat(np.arange(len(docs)), n)


def best_positions(lists: Lists, terms: np.ndarray, weights: np.ndarray, ids: np.ndarray, k: int, scratch: np.ndarray) -> tuple[
        np.ndarray, np.ndarray, int]:
    """(documents, scores) of the k best documents, highest first, equal scores by ascending id; and how many were met.

    ``ids`` orders documents of equal score; ``scratch``, as long as there are terms and filled with -1, is given back so."""
    begin, size = lists.begin[terms], lists.begin[terms + 1] - lists.begin[terms]
    terms, weights, begin, size = (x[size > 0] for x in (terms, weights, begin, size))
    base = np.concatenate([[0], np.cumsum(size + 1)])  # one more position that is never seen ends each list
    seen, best = np.zeros(base[-1], bool), np.zeros(len(terms), np.int64)
    scratch[terms] = np.arange(len(terms))
    met = np.zeros(len(lists.starts) - 1, bool)
    docs, scores, read, step, total = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, DEPTH, 0
    while len(terms):
        new = np.concatenate([lists.doc[b + read : b + min(read + step, n)] for b, n in zip(begin.tolist(), size.tolist(), strict=True) if n > read])
        new = np.unique(new[~met[new]])
        met[new] = True
        total += len(new)
        read += step
        step *= 2
        entry, row = lists.entries(new)
        number = scratch[lists.term[entry]]
        entry, row, number = entry[number >= 0], row[number >= 0], number[number >= 0]
        seen[base[number] + lists.position[entry]] = True
        found = np.zeros(len(new), np.int64)
        np.add.at(found, row, weights[number] * lists.impact[entry])
        docs, scores = np.concatenate([docs, new]), np.concatenate([scores, found])
        if len(docs) > k:
            top = np.lexsort((ids[docs], -scores))[:k]
            docs, scores = docs[top], scores[top]
        bound = 0
        for i in range(len(terms)):
            best[i] += seen[base[i] + best[i] : base[i + 1]].argmin()
            if best[i] < size[i]:  # a list that is read adds nothing to a document not met
                bound += int(weights[i]) * int(lists.sorted_impact[begin[i] + max(0, best[i] - 1)])
        if read >= size.max() or (len(docs) >= k and bound < scores[-1]):
            break
    scratch[terms] = -1
    if len(docs) <= k:
        top = np.lexsort((ids[docs], -scores))
        docs, scores = docs[top], scores[top]
    return docs[scores > 0], scores[scores > 0], total


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", max_terms: int = MAX_TERMS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each item with a score above 0.

    Null and empty texts have no terms. Repeated documents are ranked each, null ids behind others of equal score; each row
    of ``items`` is an item of its own, also where ids repeat. Other columns are ignored; without documents or items there
    are no rows. Scores are 64-bit whole numbers; document and term counts cover all documents.

    Items reach the tasks in parts of about ``max_terms`` terms, whose size is counted first; a part costs one pass over
    the texts. Documents are not shuffled: their entries for terms of items are written once and read in blocks of at
    most ``block_docs`` documents. A block gives k rows an item at most.
    """
    spark = docs.sparkSession
    kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, doc_id), (items, item_id)))
    wanted = items.select(F.col(item_id).alias("id"), F.col(item_text).cast("string").alias("raw")).filter("raw is not null")
    total = wanted.agg(F.sum(F.octet_length("raw") / 2)).first()[0] or 0
    parts = max(1, int(-(-total // max_terms)))
    out = None
    for part in range(parts):
        rows = wanted.filter(F.pmod(F.xxhash64("raw"), F.lit(parts)) == part).collect()
        one = _ranked_part(spark, docs, [(r.id, r.raw) for r in rows], k, doc_id, text, kind, item_kind, block_docs)
        out = one if out is None else out.unionByName(one)
    return out.select(F.col("item").alias(item_id), "rank", F.col("_id").alias(doc_id), "score")


def _ranked_part(spark: SparkSession, docs: DataFrame, items: list[tuple], k: int, doc_id: str, text: str, kind: str, item_kind: str,
                 block_docs: int) -> DataFrame:
    terms = sorted({w for _, raw in items for w in words(raw.encode())})
    number = {w: i for i, w in enumerate(terms)}
    shared = spark.sparkContext.broadcast(number)

    def entries(batch: pa.RecordBatch) -> dict:
        known = shared.value
        rows, sizes, found, times = [], [], [], []
        for row, raw in enumerate(as_bytes(batch.column("_text"))):
            if w := words(raw):
                code = np.fromiter((known.get(x, -1) for x in w), np.int64, len(w))
                term, tf = np.unique(code[code >= 0], return_counts=True)
                rows.append(row)
                sizes.append(len(w))
                found.append(term)
                times.append(tf)
        ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]), pa.int32())
        flat = [pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int32)) for x in (found, times)]
        return {"_id": batch.column("_id").take(pa.array(rows, pa.int64())), "n": sizes,
                "terms": pa.ListArray.from_arrays(ends, flat[0]), "tfs": pa.ListArray.from_arrays(ends, flat[1])}

    counted = staged(map_texts(
        docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")), entries,
        f"_id {kind}, n bigint, terms array<int>, tfs array<int>", "_text"), "entries")
    all_docs, all_terms = counted.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(terms), np.int64)
    # at most one row per term of this part
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r["term"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * all_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    queries = [(i, np.array(sorted({number[w] for w in words(raw.encode())}), np.int64)) for i, (_, raw) in enumerate(items)]
    search = spark.sparkContext.broadcast((all_docs, all_terms, weights, queries))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, block_docs):
                some = batch.slice(at, block_docs)
                n = len(some.column("terms").flatten())
                if held and (rows + some.num_rows > block_docs or size + n > BLOCK_ENTRIES):
                    yield _search(held, k, *search.value)
                    held, rows, size = [], 0, 0
                held.append(some)
                rows, size = rows + some.num_rows, size + n
        if held:
            yield _search(held, k, *search.value)

    found = counted.filter(F.size("terms") > 0).mapInArrow(blocks, f"query bigint, _id {kind}, score bigint")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("_id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(items)], f"query bigint, item {item_kind}")
    return top.join(F.broadcast(names), "query").select("item", "rank", "_id", "score")


def _search(held: list[pa.RecordBatch], k: int, all_docs: int, all_terms: int, weights: np.ndarray, queries: list) -> pa.RecordBatch:
    block = pa.Table.from_batches(held).combine_chunks()
    terms, tfs = (block.column(c).combine_chunks() for c in ("terms", "tfs"))
    starts = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())]).astype(np.int64)
    term, tf = (x.flatten().to_numpy().astype(np.int64) for x in (terms, tfs))
    # whole numbers of any size, once per document: 90 * n * N need not fit 64 bits
    length = np.array([10 + 90 * n * all_docs // all_terms for n in block.column("n").to_pylist()], np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(length, np.diff(starts)))
    lists = Lists(starts, term, impact, len(weights))
    ids = block.column("_id").combine_chunks()
    order = np.empty(len(ids), np.int64)
    order[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
    scratch = np.full(len(weights), -1, np.int64)
    query, doc, score = [], [], []
    for q, wanted in queries:
        docs, scores, _ = best_positions(lists, wanted, weights[wanted], order, k, scratch)
        query.append(np.full(len(docs), q))
        doc.append(docs)
        score.append(scores)
    flat = [np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (query, doc, score)]
    return pa.RecordBatch.from_arrays([pa.array(flat[0]), ids.take(pa.array(flat[1])), pa.array(flat[2])], names=["query", "_id", "score"])


def op12_best_position_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

OP12_SQL = rf"""
WITH t AS (SELECT doc_id, {_TERMS} AS term FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM e GROUP BY ALL),
c AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM d),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} AS term FROM benchmark WHERE text IS NOT NULL)),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM e, c GROUP BY term),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * nn) // l)))))::BIGINT AS score
  FROM q JOIN e USING (term) JOIN w USING (term) JOIN d USING (doc_id), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
