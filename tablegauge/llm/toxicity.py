"""Toxic spans by a linear-chain conditional random field.

Documents carry a label, tokens do not. In the fitting sample a token of a toxic document is tagged when its word or one of
its prefixes occurs in significantly more toxic than clean documents; the field is then fitted to these tags by maximum likelihood. A text is
scored sentence by sentence: forward-backward gives every token's marginal probability of the toxic tag, sentences advance
side by side in numpy. Number and density of the marginals give the document score, calibrated on documents that the field
was not fitted to; tokens with a high marginal are the offending offsets.
"""

from __future__ import annotations

from array import array
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain
from math import log
from string import punctuation
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablegauge.llm.common import filter_texts, map_texts, remainder, table

#: Documented bounds of the fitting sample: rows of each class, and UTF-8 bytes of a row. Scoring and class counts use all rows.
FIT_ROWS, FIT_BYTES = 3000, 1 << 15
THRESHOLD = 0.3
#: Bounds of a worker's memory: distinct words whose scores are kept, text bytes handled at once.
CACHED_WORDS, PIECE = 120_000, 2 << 20
#: Marginals below this do not count towards a document's score: many words of no meaning are not a sign.
COUNTED = 0.1
_EDGE = punctuation + "…«»¡¿„“”‘’–—"
#: A sign's share among toxic documents is at least RATIO times its share among clean ones, and the signed root of the
#: log-likelihood ratio of the two counts is at least SIGNIFICANT: a few dozen documents of a small language can show that.
RATIO, SIGNIFICANT = 4, 4.0


def features(word: str, known: frozenset[str] = frozenset()) -> tuple[str, ...]:
    """A word as itself and, unless it is one of the ``known`` toxic words, its beginnings."""
    if word in known:
        return ("w=" + word,)
    return "w=" + word, *("p=" + word[:k] for k in range(4, 9) if len(word) > k)


@dataclass
class Model:
    """Weights of features of the token itself and of its neighbours, transition scores, and the document calibration."""

    known: frozenset[str] = frozenset()
    own: dict[str, float] = field(default_factory=dict)
    before: dict[str, float] = field(default_factory=dict)
    after: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    move: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    document: tuple[float, float, float] = (0.0, 0.0, 0.0)
    constant: float | None = None

    def word(self, raw: str) -> tuple[float, float, float, bool]:
        """(own score, score for the token after it, score for the token before it, whether it ends a sentence)."""
        w = raw.strip(_EDGE).lower()
        own = self.bias + sum(self.own.get(f, 0.0) for f in features(w, self.known))
        return own, self.before.get(w, 0.0), self.after.get(w, 0.0), raw[-1] in ".!?…"


class Chains:
    """Token runs that the field treats as one chain each, longest first, so that step t touches the first ``active[t]``."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        self.starts, self.lengths = starts[order], lengths[order]
        self.active = np.searchsorted(-self.lengths, -np.arange(1, (self.lengths[0] if len(lengths) else 0) + 1), "right")

    def marginals(self, score: np.ndarray, move: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, float, np.ndarray]:
        """Probability of the toxic tag per token, log partition, and expected number of each transition, by ``weight`` of the tokens."""
        n = len(score)
        psi = np.exp(np.clip(score, -30, 30))
        m = np.exp(move)
        forward, scale = np.empty((2, n)), np.empty(n)
        for t, k in enumerate(self.active):
            at = self.starts[:k] + t
            if t == 0:
                a0, a1 = np.ones(k), psi[at]
            else:
                p0, p1 = forward[0, at - 1], forward[1, at - 1]
                a0, a1 = p0 * m[0] + p1 * m[2], (p0 * m[1] + p1 * m[3]) * psi[at]
            z = a0 + a1
            forward[0, at], forward[1, at], scale[at] = a0 / z, a1 / z, z
        backward = np.ones((2, n))
        pairs = np.zeros(4)
        for t in range(len(self.active) - 2, -1, -1):
            at = self.starts[: self.active[t + 1]] + t
            b0, b1 = backward[0, at + 1] / scale[at + 1], backward[1, at + 1] * psi[at + 1] / scale[at + 1]
            f0, f1 = forward[:, at] if weight is None else forward[:, at] * weight[at]
            pairs += (f0 * b0).sum() * m[0], (f0 * b1).sum() * m[1], (f1 * b0).sum() * m[2], (f1 * b1).sum() * m[3]
            backward[0, at], backward[1, at] = m[0] * b0 + m[1] * b1, m[2] * b0 + m[3] * b1
        return forward[1] * backward[1], float(np.log(scale).sum()), pairs


def sentences(ends: np.ndarray, doc_starts: np.ndarray, n: int) -> Chains:
    """Chains between sentence ends and document starts."""
    cut = np.zeros(n + 1, bool)
    cut[doc_starts[doc_starts < n]] = True
    cut[1:][ends] = True
    starts = np.flatnonzero(cut[:n])
    return Chains(starts, np.diff(np.append(starts, n)))


class Texts:
    """The tokens of some texts with the model's scores, one entry per distinct token."""

    def __init__(self, texts: list[str], model: Model, cache: dict[str, tuple]):
        split = [t.split() for t in texts]
        self.counts = np.array([len(s) for s in split], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])[:-1]
        codes, distinct = pd.factorize(np.array(list(chain.from_iterable(split)), dtype=object))
        if len(cache) > CACHED_WORDS:
            cache.clear()
        for w in distinct:
            if w not in cache:
                cache[w] = model.word(w)
        values = np.array([cache[w] for w in distinct], np.float64).reshape(-1, 4)
        own, before, after, ends = (values[codes, i] for i in range(4))
        self.n, self.codes = len(codes), codes
        self.ends = ends > 0
        self.chains = sentences(self.ends, self.starts, self.n)
        score = own
        inner = ~self.first_of_chain()
        score[1:] += np.where(inner[1:], before[:-1], 0.0)
        score[:-1] += np.where(inner[1:], after[1:], 0.0)
        self.score = score

    def first_of_chain(self) -> np.ndarray:
        first = np.zeros(self.n, bool)
        first[self.chains.starts] = True
        return first


def summary(marginal: np.ndarray, texts: Texts) -> np.ndarray:
    """Per document: logarithms of the expected number of different toxic words, and of that number among a hundred tokens.

    A word counts once, by its largest marginal: a line that is repeated says no more than the line."""
    at = np.flatnonzero(marginal >= COUNTED)
    at = at[np.argsort(-marginal[at], kind="stable")]
    doc = np.searchsorted(texts.starts, at, "right") - 1
    _, first = np.unique(np.column_stack([doc, texts.codes[at]]), axis=0, return_index=True)
    number = np.bincount(doc[first], marginal[at[first]], len(texts.counts))
    return np.column_stack([np.log(0.05 + number), np.log(0.01 + 100 * number / (100 + texts.counts))])


def fit(rows: list[tuple[str, int]], toxic_share: float, rounds: int = 40) -> Model:
    """Fit the field to three quarters of the sample rows (text, toxic), the calibration to the others.

    ``toxic_share`` is the share of toxic rows among all labelled rows. With one class only the model is that share."""
    if len({y for _, y in rows}) < 2:
        return Model(constant=float(toxic_share))
    rows = _without_copies(rows)
    part = [i % 4 == 3 for i in range(len(rows))]
    tags = _toxic_features([r for r, held in zip(rows, part, strict=True) if not held])
    model = _fit_field([r for r, held in zip(rows, part, strict=True) if not held], *tags, rounds)
    held = [r for r, h in zip(rows, part, strict=True) if h]
    texts = Texts([t for t, _ in held], model, {})
    x = summary(texts.chains.marginals(texts.score, np.array(model.move))[0], texts)
    y = np.array([v for _, v in held], float)
    weight = np.where(y == 1, toxic_share / max(1, y.sum()), (1 - toxic_share) / max(1, (1 - y).sum())) * len(y)
    model.document = _logistic(x, y, weight)
    return model


def _without_copies(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The sample rows but those that share a smallest hash of word triples with an earlier row: a group of near copies would
    make its rare words look like signs."""
    seen: set[tuple[int, int]] = set()
    out = []
    for text, y in rows:
        w = text.split()
        hashes = np.array([crc32(" ".join(w[i : i + 3]).encode()) for i in range(max(1, len(w) - 2))], np.uint64)
        keys = {(k, int(((hashes * np.uint64(m)) & np.uint64(0xFFFFFFFF)).min())) for k, m in enumerate((1, 2654435761, 2246822519))}
        if not keys & seen:
            out.append((text, y))
        seen |= keys
    return out


def _toxic_features(rows: list[tuple[str, int]]) -> tuple[frozenset[str], set[str]]:
    """Words and beginnings whose documents are toxic far more often than chance allows (``_tells``)."""
    total = Counter(y for _, y in rows)
    words = [({w.strip(_EDGE).lower() for w in text.split()}, y) for text, y in rows]

    def telling(of) -> dict[str, int]:
        seen = {0: Counter(), 1: Counter()}
        for w, y in words:
            seen[y].update({f for x in w for f in of(x)})
        return {f: t for f, t in seen[1].items() if t >= 3 and _tells(t, seen[0][f], total[1], total[0])}

    # a word stands for itself unless one of its beginnings is in clearly more documents
    beginnings = telling(lambda x: features(x)[1:])
    known = frozenset(w for w, t in telling(lambda x: (x,)).items() if all(beginnings.get(f, 0) < 1.5 * t for f in features(w)[1:]))
    return known, set(telling(lambda x: features(x, known)[1:]))


def _tells(toxic: int, clean: int, all_toxic: int, all_clean: int) -> bool:
    """Whether a feature in so many toxic and clean documents is a sign: by ratio, and by the likelihood ratio against equal shares."""
    if toxic * all_clean < RATIO * (clean + 0.5) * all_toxic:
        return False
    share = all_toxic / (all_toxic + all_clean)
    n = toxic + clean
    return 2 * (toxic * log(toxic / (n * share)) + (clean * log(clean / (n * (1 - share))) if clean else 0)) >= SIGNIFICANT**2


def _fit_field(rows: list[tuple[str, int]], known: frozenset[str], tagged: set[str], rounds: int) -> Model:
    """Maximum likelihood with a quadratic penalty, by full-batch Adam steps, on every sentence with a sign, of toxic or clean
    documents, and on every eighth of the others, which stands for eight."""
    chains: list[list[tuple[str, bool]]] = []
    signs: dict[str, bool] = {}

    def sign(w: str) -> bool:
        if w not in signs:
            signs[w] = w in known or any(f in tagged for f in features(w, known)[1:])
        return signs[w]

    for text, y in rows:
        current: list[tuple[str, bool]] = []
        for raw in text.split():
            w = raw.strip(_EDGE).lower()
            current.append((w, bool(y) and sign(w)))
            if raw[-1] in ".!?…":
                chains.append(current)
                current = []
        if current:
            chains.append(current)
    signed = [any(sign(w) for w, _ in c) for c in chains]
    taken = [i for i, s in enumerate(signed) if s or i % 8 == 0]
    chains = [chains[i] for i in taken]
    lengths = np.array([len(c) for c in chains])
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    flat = [w for c in chains for w, _ in c]
    y = np.array([t for c in chains for _, t in c], float)
    weight = np.repeat([1.0 if signed[i] else 8.0 for i in taken], lengths)
    count = Counter(f for w in flat for f in features(w, known))
    number: dict[tuple[str, str], int] = {("bias", ""): 0}
    token, feature = array("i"), array("i")
    index_of = lambda kind, f: number.setdefault((kind, f), len(number))
    at = 0
    for c in chains:
        for i, (w, _) in enumerate(c):
            found = [0, *(index_of("own", f) for f in features(w, known) if count[f] >= 8)]
            if i and count["w=" + c[i - 1][0]] >= 16:
                found.append(index_of("before", c[i - 1][0]))
            if i + 1 < len(c) and count["w=" + c[i + 1][0]] >= 16:
                found.append(index_of("after", c[i + 1][0]))
            token.extend([at] * len(found))
            feature.extend(found)
            at += 1
    token, feature = np.frombuffer(token, np.int32), np.frombuffer(feature, np.int32)
    runs = Chains(starts, lengths)
    pair = np.ones(len(y), bool)
    pair[starts] = False
    here = np.flatnonzero(pair)
    observed = np.bincount((2 * y[here - 1] + y[here]).astype(int), weight[here], minlength=4)
    wanted = np.bincount(feature, y[token], len(number))
    theta = np.zeros(len(number) + 4)
    theta[0] = np.log((y.sum() + 0.5) / ((weight * (1 - y)).sum() + 0.5))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        score = np.bincount(token, theta[feature], len(y))
        marginal, _, pairs = runs.marginals(score, theta[-4:], weight)
        marginal *= weight
        gradient = np.concatenate([np.bincount(feature, marginal[token], len(number)) - wanted, pairs - observed]) + 0.05 * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.98 * second + 0.02 * gradient**2
        theta -= 0.3 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.98**step)) + 1e-6)
    model = Model(known=known, bias=float(theta[0]), move=tuple(theta[-4:].tolist()))
    for (kind, f), i in number.items():
        if kind != "bias" and abs(theta[i]) > 0.05:
            getattr(model, kind)[f] = float(theta[i])
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic regression with a small penalty, by Newton steps."""
    z = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + 0.5 * b
        b -= np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(3), gradient)
    return tuple(b.tolist())


def learn(docs: DataFrame, labels: DataFrame, usable: str = "true", doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Model:
    """Fit a model to labelled documents that meet ``usable`` (an expression over the label rows).

    The class share is counted over all labels. The fitting sample is, per class, the ``fit_rows`` labelled ids that come
    first by a hash, with texts of up to ``fit_bytes`` bytes: at most 2 x fit_rows x fit_bytes reach the driver. Labels or
    texts that are null are left out; an id labelled twice counts with its larger label.
    """
    labelled = labels.filter(usable).filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(
        F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    counts = {r._y: r["count"] for r in labelled.groupBy("_y").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    chosen = None
    for y in (0, 1):
        some = labelled.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
        chosen = some if chosen is None else chosen.unionByName(some)
    # at most 2 x fit_rows ids
    found = docs.filter(F.octet_length(text) <= fit_bytes).select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(
        F.broadcast(chosen), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text")).collect()
    found.sort(key=lambda r: (r._y, str(r._id)))
    return fit([(r._text, r._y) for r in found], share)


def toxic_spans(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", span_level: float = 0.5) -> DataFrame:
    """``doc_id, score, spans`` per row; spans are the (start, end, probability) of tokens whose marginal is at least
    ``span_level``, in code points.

    Null and empty texts have no tokens: their score is the calibrated score of a text without any sign. Repeated rows each
    get theirs; other columns are ignored. No shuffle; the model is bounded by its fitting sample."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cache: dict[str, tuple] = {}

    def step(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column("_text").to_pylist()]
        scores, spans = score_texts(texts, shared.value, span_level, cache)
        return {"_id": batch.column("_id"), "score": scores, "spans": spans}

    return map_texts(
        docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")), step,
        f"_id {kind}, score double, spans array<struct<start:bigint,end:bigint,probability:double>>", "_text", PIECE,
    ).withColumnRenamed("_id", doc_id)


def score_texts(texts: list[str], model: Model, span_level: float = 0.5, cache: dict | None = None) -> tuple[np.ndarray, list[list[dict]]]:
    if model.constant is not None:
        return np.full(len(texts), model.constant), [[] for _ in texts]
    tokens = Texts(texts, model, {} if cache is None else cache)
    marginal = tokens.chains.marginals(tokens.score, np.array(model.move))[0]
    a, b, c = model.document
    x = summary(marginal, tokens)
    spans: list[list[dict]] = [[] for _ in texts]
    high = np.flatnonzero(marginal >= span_level)
    doc = np.searchsorted(tokens.starts, high, "right") - 1
    for d in np.unique(doc):
        places = _places(texts[d])
        for i in high[doc == d]:
            begin, end = places[i - tokens.starts[d]]
            spans[d].append({"start": begin, "end": end, "probability": float(marginal[i])})
    return 1 / (1 + np.exp(-np.clip(a * x[:, 0] + b * x[:, 1] + c, -30, 30))), spans


def _places(text: str) -> list[tuple[int, int]]:
    """Where the tokens of ``text.split()`` stand."""
    out, at = [], 0
    for token in text.split():
        at = text.index(token, at)
        out.append((at, at + len(token)))
        at += len(token)
    return out


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose text scores below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cache: dict[str, tuple] = {}
    return filter_texts(docs, lambda b: score_texts([t or "" for t in b.column(text).to_pylist()], shared.value, 2.0, cache)[0] < threshold, text, PIECE)


def learned_from(spark: SparkSession, sf_dir: str) -> Model:
    """The model of the query and of the pipeline: labels whose remainder is 2 are held out."""
    labels = table(spark, sf_dir, "labels").withColumn("_part", remainder("doc_id", 4))
    return learn(table(spark, sf_dir, "documents"), labels, "_part <> 2")


def op7_toxic_span_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxic_spans(table(spark, sf_dir, "documents"), learned_from(spark, sf_dir))
    return found.select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("spans").cast("bigint").alias("n_spans"),
    )
