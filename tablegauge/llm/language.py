"""Language identification in two steps: the language family first, then one-versus-one linear support vector machines
between the languages of that family.

Both steps look at the relative frequencies of hashed letter sequences (1 to 3 bytes of folded text) of the whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablegauge.llm.common import as_bytes, map_texts, remainder, table

#: Parts into which ids are hashed for drawing.
UNITS = 1 << 40
#: Documented bounds of the fitting sample: rows of a language, rows in all, UTF-8 bytes of a row.
ROWS_PER_LANGUAGE, ROWS, FIT_BYTES = 1000, 8000, 1 << 16
BITS = 12
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
_SLICE = 1 << 20

#: Families of ISO 639-1 languages. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af",
    "romance": "fr es it pt ro ca gl",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn mr gu pa ur ne",
    "semitic": "ar he mt",
    "celtic": "ga cy gd br",
}
_FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().split("-")[0], lang)


def frequencies(texts: list[bytes]) -> np.ndarray:
    """One row per text: square roots of the relative frequencies of hashed sequences, of length 1; zero for no text."""
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for i, raw in enumerate(texts):
        counts = np.zeros(1 << BITS)
        for at in range(0, len(raw), _SLICE):
            codes = _FOLD[np.frombuffer(raw, np.uint8, min(_SLICE + 2, len(raw) - at), at)].astype(np.uint32)
            gram = codes
            for n in range(3):
                if n:
                    gram = (gram[:-1] << np.uint32(8)) | codes[n:]
                key = ((gram + np.uint32(n * 0x5BD1E995)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
                counts += np.bincount(key[:_SLICE], minlength=1 << BITS)
        if total := counts.sum():
            out[i] = np.sqrt(counts / total)
    return out


@dataclass
class Model:
    """Weights of the family step and of each pair of languages; columns of ``weights`` in that order."""

    languages: list[str]
    families: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    offsets: np.ndarray

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        values = frequencies(texts) @ self.weights + self.offsets
        n = len(self.families)
        share = values[:, :n] - values[:, :n].max(axis=1, keepdims=True)
        share = np.exp(share) / np.exp(share).sum(axis=1, keepdims=True)
        votes = np.zeros((len(texts), len(self.languages)))
        margin = 1 / (1 + np.exp(-2 * np.clip(values[:, n:], -15, 15)))
        rivals = np.zeros(len(self.languages))
        for k, (i, j) in enumerate(self.pairs):
            votes[:, i] += margin[:, k]
            votes[:, j] += 1 - margin[:, k]
            rivals[[i, j]] += 1
        inside = np.where(rivals > 0, votes / np.maximum(rivals, 1), 1.0)
        place = np.array([self.families.index(family_of(lang)) for lang in self.languages])
        best = share.argmax(axis=1)
        inside = np.where(place[None, :] == best[:, None], inside, -1.0)
        lang = inside.argmax(axis=1)
        score = share[np.arange(len(texts)), best] * inside[np.arange(len(texts)), lang]
        return [self.languages[i] for i in lang], np.clip(score, 0, 1)


def fit(rows: list[tuple[bytes, str]]) -> Model | None:
    if not rows:
        return None
    x = frequencies([t for t, _ in rows])
    languages = sorted({lang for _, lang in rows})
    families = sorted({family_of(lang) for lang in languages})
    y = np.array([languages.index(lang) for _, lang in rows])
    f = np.array([families.index(family_of(lang)) for lang in languages])[y]
    weights, offsets = _softmax(x, f, len(families))
    columns, shifts, pairs = [weights], [offsets], []
    for i, j in combinations(range(len(languages)), 2):
        if family_of(languages[i]) == family_of(languages[j]):
            some = (y == i) | (y == j)
            w, b = _svm(x[some], np.where(y[some] == i, 1.0, -1.0))
            columns.append(w[:, None])
            shifts.append([b])
            pairs.append((i, j))
    return Model(languages, families, pairs, np.hstack(columns).astype(np.float32), np.concatenate(shifts))


def _softmax(x: np.ndarray, y: np.ndarray, n: int, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression, classes weighted evenly, by accelerated gradient steps."""
    target = np.eye(n)[y]
    weight = (len(y) / (n * np.maximum(1, target.sum(axis=0))))[y][:, None]

    def gradient(w, b):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        error = (weight * (p / p.sum(axis=1, keepdims=True) - target) / len(y)).astype(np.float32)
        return x.T @ error + np.float32(1e-5) * w, error.sum(axis=0)

    return _descend(gradient, (x.shape[1], n), rounds, 4.0)


def _svm(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Linear support vector machine with the squared hinge loss, classes weighted evenly."""
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))

    def gradient(w, b):
        slack = np.maximum(0, 1 - y * (x @ w + b))
        error = (-2 * weight * y * slack / len(y)).astype(np.float32)
        return x.T @ error + np.float32(1e-4) * w, error.sum()

    return _descend(gradient, (x.shape[1],), rounds, 0.4)


def _descend(gradient, shape, rounds: int, rate: float):
    rate = np.float32(rate)
    w = v = np.zeros(shape, np.float32)
    b = c = np.zeros(shape[1:], np.float32)
    for k in range(1, rounds + 1):
        gw, gb = gradient(v, c)
        nw, nb = v - rate * gw, c - rate * gb
        pull = np.float32((k - 1) / (k + 2))
        v, c = nw + pull * (nw - w), nb + pull * (nb - b)
        w, b = nw, nb
    return w, b


def learn(docs: DataFrame, usable: str = "true", doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          per_language: int = ROWS_PER_LANGUAGE, rows: int = ROWS, fit_bytes: int = FIT_BYTES) -> Model | None:
    """Fit a model to documents that meet ``usable`` and name a language.

    Languages are counted over all of them. The sample holds, of each language by itself, the ids that come first by a hash: at most
    ``per_language`` texts of up to ``fit_bytes`` bytes, and over all languages about ``rows``. A language with fewer
    texts gives all of them, however many the others have."""
    some = docs.filter(usable).filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang")).filter(F.octet_length("_text") <= fit_bytes)
    counts = {r._lang: r["count"] for r in some.groupBy("_lang").count().collect()}
    if not counts:
        return None
    wanted = max(1, min(per_language, rows // len(counts)))
    # somewhat more than wanted are drawn, so that enough come whatever the hashes; of those the first ones are taken
    drawn = wanted + 6 * wanted**0.5 + 10
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(UNITS, int(UNITS * drawn / n) + 1))])
    draw = F.pmod(F.xxhash64("_id"), F.lit(UNITS))
    first = Window.partitionBy("_lang").orderBy(draw, "_id", "_text")
    found = some.filter(draw < share[F.col("_lang")]).withColumn(
        "_place", F.row_number().over(first)).filter(F.col("_place") <= wanted).collect()
    sample = [(r._text.encode(), r._lang) for r in sorted(found, key=lambda r: (r._lang, r._place))]
    return fit(sample)


def identify(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` per row, from the whole text.

    A text that is null or has no letter, and any text where there was nothing to learn from, is ``und`` with score 0.
    Repeated rows each get theirs; other columns are ignored. No shuffle; the model has a fixed number of weights per
    language pair."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> dict:
        raw = as_bytes(batch.column("_text"))
        texts = batch.column("_text").to_pylist()
        lettered = [shared.value is not None and t is not None and _LETTER.search(t) is not None for t in texts]
        pred, score = [UNKNOWN] * len(raw), np.zeros(len(raw))
        at = np.flatnonzero(lettered)
        if len(at):
            found, values = shared.value.predict([raw[i] for i in at])
            score[at] = values
            for i, lang in zip(at, found, strict=True):
                pred[i] = lang
        return {"_id": batch.column("_id"), "lang_pred": pred, "score": score}

    return map_texts(
        docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")), step,
        f"_id {kind}, lang_pred string, score double", "_text", limit=2 << 20,
    ).withColumnRenamed("_id", doc_id)


def op10_hierarchical_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.withColumn("_part", remainder("doc_id", 4)), "_part <> 2")
    held = (remainder("doc_id", 4) == 2).alias("held_out")
    return identify(docs, model).select("doc_id", held, "lang_pred", "score")
