"""Secret scan with one combined automaton.

All rules are compiled by subset construction over byte classes and minimised into one transition array, which reads every
byte of every text once. Texts in which a rule has matched are then resolved for that rule alone: its reversed automaton
marks where matches start, its own automaton finds the longest match from the leftmost start; matches do not overlap.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablegauge.llm.automata import BREAK, Dfa, Nfa, Scanner
from tablegauge.llm.common import as_bytes, map_texts, table


@dataclass(frozen=True)
class Rule:
    """Spans of ``pattern`` whose ``group`` has ``least`` characters; shorter ones are dropped, but use up their text.

    ``head`` is what each match begins with, where all that follows is optional: it tells where matches start."""

    kind: str
    pattern: bytes
    least: int = 0
    group: int = 0
    head: bytes | None = None


#: The three base kinds. Matches of [0-9a-f]+ are whole runs, so that asking for 24 in the pattern is the same
#: as dropping shorter ones.
BASE = (
    Rule("assign", rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", rb"AKIA[A-Z0-9]+", 20),
    Rule("hex", rb"[0-9a-f]{24,}"),
)
#: A private key: the BEGIN line, then header lines and lines of base64 (or long base64 after blanks) as far as they go, and the
#: END line. A line end may be written as backslash and n. Text that is neither ends the key.
_LINE = rb"([\x20\t]*(\r?\n|(\\r)?\\n)[\x20\t]*)"
_BEGIN = rb"-----BEGIN [A-Z ]*PRIVATE KEY-----"
_PEM = (
    _BEGIN + rb"(" + _LINE + rb"+([A-Z][A-Za-z0-9]*(-[A-Z][A-Za-z0-9]*)+: [^\r\n\\]*|[A-Za-z0-9+/]{20,}={0,2})|\x20+[A-Za-z0-9+/]{32,}={0,2})*"
    rb"(" + _LINE + rb"[A-Za-z0-9+/]{1,19}={1,2})?"
    rb"((" + _LINE + rb"[A-Za-z0-9+/]{1,19})?(" + _LINE + rb"|\x20)*-----END [A-Z ]*PRIVATE KEY-----)?"
)
#: Published token formats of common services, added to the base.
MORE = (
    Rule("github", rb"gh[opsru]_[A-Za-z0-9]+", 40),
    Rule("slack", rb"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", rb"AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", rb"[rs]k_(live|test)_[A-Za-z0-9]+", 24),
    Rule("pem", _PEM, head=_BEGIN),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE


class Automata:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        both, ends, own = Nfa(), [], []
        for r in rules:
            before = len(both.moves)
            ends.append(both.add(r.head or r.pattern))
            own.append(range(before, len(both.moves)))
        self.scanner = Scanner(Dfa(both, [s for s, _ in ends], [f for _, f in ends], search=True, first=own))
        self.single = []
        for r in rules:
            nfa = Nfa()
            start, final = nfa.add(r.pattern)
            forward = Dfa(nfa, [start], [final], search=False)
            if r.head:
                nfa = Nfa()
                start, final = nfa.add(r.head)
            backward = Dfa(nfa.reversed(), [final], [start], search=True)
            self.single.append((forward.table(), forward.marks.tolist(), forward.dead, backward.table(), backward.marks.tolist()))
        self.groups = [re.compile(r.pattern) for r in rules]

    def resolve(self, raw: bytes, k: int) -> list[tuple[int, int]]:
        """Leftmost-longest, non-overlapping spans of rule k in one text, as byte offsets."""
        forward, marks, dead, backward, start_marks = self.single[k]
        starts, state = [], 0
        for i in range(len(raw) - 1, -1, -1):
            state = backward[state][raw[i]]
            if start_marks[state]:
                starts.append(i)
        rule, out, free = self.rules[k], [], 0
        for begin in reversed(starts):
            if begin < free:
                continue
            state, end, i = 0, begin, begin
            while i < len(raw) and state != dead:
                state = forward[state][raw[i]]
                i += 1
                if marks[state]:
                    end = i
            free = end
            if rule.group:
                size = len(self.groups[k].fullmatch(raw, begin, end)[rule.group])
            else:
                size = end - begin
            if size >= rule.least:
                out.append((begin, end))
        return out


_BUILT: dict[tuple[Rule, ...], Automata] = {}


def spans_of(texts: list[bytes], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) in code points of each text, by start, then by the order of the rules."""
    if rules not in _BUILT:
        _BUILT[rules] = Automata(rules)
    automata = _BUILT[rules]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    where, bits = automata.scanner.accepts(np.frombuffer(bytes([BREAK]).join([*texts, b""]), np.uint8))
    if len(where):
        ends = np.cumsum([len(t) + 1 for t in texts])
        doc = np.searchsorted(ends, where, "right")
        for d, k in sorted({(int(d), k) for k in range(len(rules)) for d in np.unique(doc[(bits >> k) & 1 == 1])}):
            raw = texts[d]
            for begin, end in automata.resolve(raw, k):
                a = len(raw[:begin].decode())
                out[d].append((rules[k].kind, a, a + len(raw[begin:end].decode())))
        order = {r.kind: i for i, r in enumerate(rules)}
        for found in out:
            found.sort(key=lambda s: (s[1], order[s[0]]))
    return out


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, spans``: per row the found spans as (kind, start, end), code points, end exclusive.

    Null and empty texts have none; repeated rows each get theirs; other columns are ignored. Rules match ASCII only.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def step(batch: pa.RecordBatch) -> dict:
        found = spans_of(as_bytes(batch.column("_text")), rules)
        return {"_id": batch.column("_id"), "spans": [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found]}

    return map_texts(
        docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")), step,
        f"_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>", "_text",
    ).withColumnRenamed("_id", doc_id)


def redact(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows and columns, with every secret in ``text`` replaced by ``[secret]``; overlapping spans become one.

    Null and empty texts stay as they are, repeated rows are treated alike, and an empty table stays empty."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def step(batch: pa.RecordBatch) -> dict:
        texts = batch.column(text).to_pylist()
        found = spans_of([(t or "").encode() for t in texts], rules)
        return {c: batch.column(c) for c in kinds} | {text: [_cut(t, s) if s else t for t, s in zip(texts, found, strict=True)]}

    return map_texts(docs, step, ", ".join(f"`{c}` {k}" for c, k in kinds.items()), text)


def _cut(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for _, begin, end in spans:
        if begin >= at:
            out += [text[at:begin], "[secret]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def op6_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s.kind.isin([r.kind for r in BASE]))
    return found.select(
        "doc_id", *[of(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
    )
