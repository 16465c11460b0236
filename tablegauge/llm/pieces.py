"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is read field by field. From it a tokenizer is rebuilt: the normaliser (precompiled character map, white
space rules, dummy prefix), the metaspace marker, unigram scores or ranked merges, and byte fallback. Batches are encoded by
the library's threads. Each id list is verified: it is compared with the reference implementation's ids for the same text.
"""

from __future__ import annotations

import os
import re
import struct
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablegauge.llm.common import Lists, map_texts, table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def _fields(raw: bytes):
    """(field number, value) of one protobuf message; values are integers or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            value = raw[at : at + size]
            at += size
        yield key >> 3, value


def parse_model(raw: bytes) -> Model:
    model = Model()
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            model.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(_fields(value))
            model.model_type = spec.get(3, UNIGRAM)
            model.byte_fallback = bool(spec.get(35, 0))
            model.unk_id = spec.get(40, 0)
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap = spec.get(2, b"")
            model.add_dummy_prefix = bool(spec.get(3, 1))
            model.remove_extra_whitespaces = bool(spec.get(4, 1))
            model.escape_whitespaces = bool(spec.get(5, 1))
    return model


def build_tokenizer(model: Model):
    """The tokenizers-library equivalent of a parsed model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    if model.model_type == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unk_id, model.byte_fallback)
    elif model.model_type == BPE:
        core = models.BPE(
            vocab={p: i for i, (p, _, _) in enumerate(model.pieces)}, merges=_merges(model), fuse_unk=True,
            byte_fallback=model.byte_fallback, unk_token=model.pieces[model.unk_id][0],
        )
    else:
        raise ValueError("only unigram and bpe models can be rebuilt")
    tokenizer = Tokenizer(core)
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p, _, t in model.pieces if t in (NORMAL, USER_DEFINED)):
        # no piece runs on over a marker, so that cutting in front of each run of markers changes nothing but the speed
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    user = [AddedToken(p, normalized=False, special=False) for p, _, t in model.pieces if t == USER_DEFINED]
    if user:
        tokenizer.add_tokens(user)
    tokenizer.decoder = decoders.Sequence(
        [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + ([decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else [])
    )
    return tokenizer


def _merges(model: Model) -> list[tuple[str, str]]:
    """Every split of a piece into two pieces, best piece first: the order in which the model joins neighbours."""
    rank = {p: s for p, s, t in model.pieces if t in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for i, (piece, score, kind) in enumerate(model.pieces):
        if kind in (NORMAL, USER_DEFINED, UNUSED):
            found += [(-score, i, k, piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in rank and piece[k:] in rank]
    return [(a, b) for _, _, _, a, b in sorted(found)]


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, raw: bytes, cache_entries: int = 100_000):
        from tokenizers import pre_tokenizers

        self.model = parse_model(raw)
        self.tokenizer = build_tokenizer(self.model)
        self.cache_entries = cache_entries
        pieces = [p for p, _, _ in self.model.pieces]
        # a character that is in no piece is always spelled in bytes: a line end never joins its neighbours
        alone = self.model.byte_fallback and not any("\n" in p for p in pieces) and "<0x0A>" in pieces
        self.by_chunk = self.tokenizer.pre_tokenizer is not None and not self.model.charsmap and alone
        if self.by_chunk:
            self.core = build_tokenizer(self.model)
            self.core.normalizer = None
            self.core.pre_tokenizer = pre_tokenizers.Split("\n", "isolated")
            self.line_end = pieces.index("<0x0A>")
            self._forget()
        # a byte below 128 is a character by itself; other bytes and control pieces go through the library
        self.plain = [
            p.replace(MARK, " ") if t in (NORMAL, USER_DEFINED, UNUSED) else chr(int(p[3:5], 16)) if t == BYTE and p < "<0x80>" else None
            for p, _, t in self.model.pieces
        ]
        self.chunk = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def _forget(self) -> None:
        self.known, self.known_ids = {"\n": 0}, Lists()
        self.known_ids.add(np.array([self.line_end]), np.array([1]))

    def encode(self, texts: list[str]) -> list[list[int]]:
        flat, ends = self.encode_flat(texts)
        return [x.tolist() for x in np.split(flat, ends[:-1])] if texts else []

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, end of each text's ids). Where the model lets texts be cut in front of markers, each
        distinct chunk is encoded once."""
        if not self.by_chunk:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array(list(chain.from_iterable(ids)), np.int32), np.cumsum([len(x) for x in ids], dtype=np.int64)
        clean = [self._spaced(t) for t in texts]
        usual = np.array([self._is_usual(t) for t in clean], bool)
        lengths = np.zeros(len(texts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for rows, cut, mark in (
            (np.flatnonzero(usual), lambda some: pc.split_pattern(pa.array([t[1:] for t in some], pa.string()), " "), MARK),
            (np.flatnonzero(~usual), lambda some: pa.array([self._chunks(t) for t in some], pa.list_(pa.string())), ""),
        ):
            if len(rows):
                ids, n = self._encode_chunks(cut([clean[i] for i in rows]), mark)
                lengths[rows] = n
                parts.append((rows, np.split(ids, np.cumsum(n)[:-1])))
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        for rows, ids in parts:
            for i, x in zip(rows, ids, strict=True):
                out[i] = x
        return np.concatenate([np.zeros(0, np.int32), *out]), np.cumsum(lengths)

    def _encode_chunks(self, texts: pa.ListArray, mark: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids of texts that are given as lists of chunks, number of ids of each text)."""
        offsets = texts.offsets.to_numpy()
        chunks = texts.flatten().dictionary_encode()
        # a chunk is cut once more at its line ends; the marks tell where chunks end
        lines = pc.binary_join_element_wise(mark, chunks.dictionary, "")
        cut = pc.split_pattern(pc.replace_substring(lines, "\n", "\x01\n\x01"), "\x01") if not pc.any(
            pc.match_substring(lines, "\x01")).as_py() else pa.array([re.split("(\n)", x) for x in lines.to_pylist()], pa.list_(pa.string()))
        pieces = cut.flatten().dictionary_encode()
        codes = self._codes(pieces.dictionary.to_pylist())
        flat, n = self.known_ids.take(codes[pieces.indices.to_numpy()])
        sums = np.concatenate([[0], np.cumsum(n)])[cut.offsets.to_numpy()]
        own = Lists()
        own.add(flat, np.diff(sums))
        ids, n = own.take(chunks.indices.to_numpy().astype(np.int64))
        return ids, np.diff(np.concatenate([[0], np.cumsum(n)])[offsets])

    def _codes(self, pieces: list[str]) -> np.ndarray:
        if len(self.known) > self.cache_entries:
            self._forget()
        if new := list(set(pieces).difference(self.known)):
            ids = np.array(self.core.encode_batch_fast(["\n".join(new)], add_special_tokens=False)[0].ids, np.int32)
            cut = np.flatnonzero(np.append(ids, self.line_end) == self.line_end)
            first = self.known_ids.add(ids[ids != self.line_end], np.diff(cut, prepend=-1) - 1)
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def _spaced(self, text: str) -> str:
        """The text after the model's rules for white space."""
        m = self.model
        if m.remove_extra_whitespaces:
            text = re.sub(" {2,}", " ", text.strip(" "))
        return " " + text if text and m.add_dummy_prefix else text

    def _is_usual(self, text: str) -> bool:
        """Whether every marker will stand alone before a word."""
        return self.model.escape_whitespaces and "  " not in text and MARK not in text and text[:1] == " " and text[-1:] != " "

    def _chunks(self, text: str) -> list[str]:
        return self.chunk.findall(text.replace(" ", MARK) if self.model.escape_whitespaces else text)

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Text of each id list. Lists with byte or control pieces go through the library, others are joined pieces."""
        out: list[str | None] = []
        rest = []
        for one in ids:
            try:
                text = "".join(map(self.plain.__getitem__, one))
            except TypeError:
                rest.append(one)
                out.append(None)
                continue
            out.append(text[1:] if self.model.add_dummy_prefix and text.startswith(" ") else text)
        if rest:
            slow = iter(self.tokenizer.decode_batch(rest, skip_special_tokens=False))
            out = [next(slow) if t is None else t for t in out]
        return out


@lru_cache(maxsize=2)
def load(path: str, threads: int):
    """(codec, reference processor) of a model file, once per worker."""
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    import sentencepiece

    with open(path, "rb") as f:
        raw = f.read()
    return Codec(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model_path: str = MODEL_PATH, threads: int = 2,
            verify: bool = True) -> DataFrame:
    """``doc_id, token_ids, decoded, parity`` per row, whole texts, without special tokens.

    ``decoded`` is the text that the ids stand for; ``parity`` tells whether the reference implementation gives the same
    ids (null without ``verify``). A null or empty text has no ids and decodes to the empty text. The model file must be at
    ``model_path`` on every executor. Repeated rows each get theirs; other columns are ignored. No shuffle.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> dict:
        codec, reference = load(model_path, threads)
        texts = [t or "" for t in batch.column("_text").to_pylist()]
        flat, ends = codec.encode_flat(texts)
        ids = [x.tolist() for x in np.split(flat, ends[:-1])]
        parity = [a == b for a, b in zip(ids, reference.encode(texts, num_threads=threads), strict=True)] if verify else [None] * len(ids)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat, pa.int32()))
        return {"_id": batch.column("_id"), "token_ids": lists, "decoded": codec.decode(ids), "parity": parity}

    return map_texts(
        docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")), step,
        f"_id {kind}, token_ids array<int>, decoded string, parity boolean", "_text", limit=1 << 20,
    ).withColumnRenamed("_id", doc_id)


def decoded(ids: DataFrame, key: str = "doc_id", token_ids: str = "token_ids", model_path: str = MODEL_PATH, threads: int = 2) -> DataFrame:
    """``key, text``: the text of each id list; a null list is the empty text."""
    kind = ids.schema[key].dataType.simpleString()

    def run(batches):
        codec, _ = load(model_path, threads)
        for b in batches:
            texts = codec.decode([x or [] for x in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return ids.select(key, token_ids).mapInArrow(run, f"`{key}` {kind}, text string")


def op2_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, digests of ids and of decoded texts (compared with the text itself), and parity, for every document."""
    docs = table(spark, sf_dir, "documents")
    found = encoded(docs)
    return found.select(
        "doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "parity",
    )
