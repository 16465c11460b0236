"""Regular expressions over bytes as deterministic automata: Thompson construction, subset construction, minimisation."""

from __future__ import annotations

import re
from re import _constants as op, _parser as parser

import numpy as np

_CATEGORY = {op.CATEGORY_DIGIT: rb"\d", op.CATEGORY_WORD: rb"\w", op.CATEGORY_SPACE: rb"\s",
             op.CATEGORY_NOT_DIGIT: rb"\D", op.CATEGORY_NOT_WORD: rb"\W", op.CATEGORY_NOT_SPACE: rb"\S"}
#: A byte that UTF-8 never holds: it separates texts and leads every state back to the start.
BREAK = 0xFF


class Nfa:
    """States with moves on byte sets (bit masks) and empty moves."""

    def __init__(self):
        self.moves: list[list[tuple[int, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, pattern: bytes) -> tuple[int, int]:
        """Start and final state of a pattern: literals, sets, groups, alternatives and greedy repeats."""
        tree = parser.parse(pattern)
        return self._sequence(list(tree), tree.state.flags)

    def _sequence(self, nodes: list, flags: int) -> tuple[int, int]:
        first = at = self.state()
        for kind, value in nodes:
            start, end = self._node(kind, value, flags)
            self.empty[at].append(start)
            at = end
        return first, at

    def _node(self, kind, value, flags: int) -> tuple[int, int]:
        if kind is op.SUBPATTERN:
            _, on, off, body = value
            return self._sequence(list(body), (flags | on) & ~off)
        if kind is op.BRANCH:
            start, end = self.state(), self.state()
            for body in value[1]:
                a, b = self._sequence(list(body), flags)
                self.empty[start].append(a)
                self.empty[b].append(end)
            return start, end
        if kind is op.MAX_REPEAT:
            least, most, body = value
            first = at = self.state()
            for _ in range(least):
                a, b = self._sequence(list(body), flags)
                self.empty[at].append(a)
                at = b
            end = self.state()
            self.empty[at].append(end)
            if most is op.MAXREPEAT:
                a, b = self._sequence(list(body), flags)
                self.empty[at].append(a)
                self.empty[b] += [a, end]
            else:
                for _ in range(most - least):
                    a, b = self._sequence(list(body), flags)
                    self.empty[at].append(a)
                    self.empty[b].append(end)
                    at = b
            return first, end
        start, end = self.state(), self.state()
        self.moves[start].append((_byte_set(kind, value, flags), end))
        return start, end

    def reversed(self) -> Nfa:
        """Every move turned round."""
        out = Nfa()
        for _ in self.moves:
            out.state()
        for s, moves in enumerate(self.moves):
            for mask, t in moves:
                out.moves[t].append((mask, s))
            for t in self.empty[s]:
                out.empty[t].append(s)
        return out


def _byte_set(kind, value, flags: int) -> int:
    if kind is op.LITERAL:
        mask = 1 << value
    elif kind is op.NOT_LITERAL:
        return _all() & ~_byte_set(op.LITERAL, value, flags)
    elif kind is op.ANY:
        return _all() if flags & re.DOTALL else _all() & ~(1 << 10)
    elif kind is op.IN:
        mask, negate = 0, False
        for k, v in value:
            if k is op.NEGATE:
                negate = True
            elif k is op.RANGE:
                mask |= sum(1 << b for b in range(v[0], v[1] + 1))
            elif k is op.CATEGORY:
                mask |= sum(1 << b for b in range(256) if re.match(_CATEGORY[v], bytes([b])))
            else:
                mask |= 1 << v
        if flags & re.IGNORECASE:
            mask = _either_case(mask)
        return _all() & ~mask if negate else mask
    else:
        raise ValueError(f"rule patterns cannot use {kind}")
    return _either_case(mask) if flags & re.IGNORECASE else mask


def _all() -> int:
    return (1 << 256) - 1 - (1 << BREAK)


def _either_case(mask: int) -> int:
    for b in range(65, 91):
        if mask >> b & 1 or mask >> (b + 32) & 1:
            mask |= 1 << b | 1 << (b + 32)
    return mask


class Dfa:
    """Transition array over byte classes. ``marks[s]`` has a bit for each final that state ``s`` stands for.

    ``search`` lets a match begin anywhere. ``first``, with the range of states of each final, drops a rule's other threads
    where it matches: enough to tell which rules match a text, with far fewer states."""

    def __init__(self, nfa: Nfa, starts: list[int], finals: list[int], search: bool, first: list[range] | None = None):
        sets = sorted({mask for moves in nfa.moves for mask, _ in moves})
        signature = [tuple(m >> b & 1 for m in sets) + (b == BREAK,) for b in range(256)]
        kinds = {s: i for i, s in enumerate(dict.fromkeys(signature))}
        self.classes = np.array([kinds[s] for s in signature], np.uint8)
        sample = [signature.index(s) for s in kinds]
        closures: dict[int, frozenset[int]] = {}

        def closed(states) -> frozenset[int]:
            out: set[int] = set()
            for s in states:
                if s not in closures:
                    seen, todo = {s}, [s]
                    while todo:
                        for t in nfa.empty[todo.pop()]:
                            if t not in seen:
                                seen.add(t)
                                todo.append(t)
                    closures[s] = frozenset(seen)
                out |= closures[s]
            return frozenset(out)

        root = closed(starts)
        number, order, rows = {root: 0}, [root], []
        for current in order:
            row = []
            for b in sample:
                moved = {t for s in current for mask, t in nfa.moves[s] if mask >> b & 1}
                after = closed(moved)
                for f, own in zip(finals, first or (), strict=False):
                    if f in after:
                        after = frozenset(s for s in after if s == f or s not in own)
                after = root if b == BREAK else after | root if search else after
                if after not in number:
                    number[after] = len(order)
                    order.append(after)
                row.append(number[after])
            rows.append(row)
        place = {f: i for i, f in enumerate(finals)}
        marks = np.array([sum(1 << place[s] for s in states if s in place) for states in order], np.int64)
        self.next, self.marks = _minimise(np.array(rows, np.int64), marks)
        self.dead = -1 if search else next(
            (s for s in range(len(self.marks)) if not self.marks[s] and (np.delete(self.next[s], self.classes[BREAK]) == s).all()), -1)

    def table(self) -> list[list[int]]:
        """Transitions by state and byte, for walking single texts."""
        return self.next[:, self.classes].tolist()


def _minimise(step: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge states that no text tells apart; the start stays state 0."""
    group = np.unique(marks, return_inverse=True)[1].ravel()
    while True:
        finer = np.unique(np.column_stack([group, group[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    first = np.unique(group, return_index=True)[1]
    rank = np.argsort(np.argsort(first))  # groups in order of their first state, so that 0 stays 0
    order = first[np.argsort(first)]
    return rank[group[step[order]]], marks[order]


#: Times that wrong lanes are run again one behind the other before their states are chained.
REPAIRS = 4


class Scanner:
    """Runs one search automaton over a long byte buffer: equal lanes advance together, then lanes that began in the wrong
    state are run again until they fall in with what was recorded."""

    def __init__(self, dfa: Dfa, lane: int = 2048):
        order = np.argsort(dfa.marks != 0, kind="stable")  # accepting states last
        rank = np.argsort(order)
        width = dfa.next.shape[1]
        self.table = (rank[dfa.next[order]] * width).astype(np.int32).ravel()
        self.root = int(rank[0] * width)
        self.first_accept = int((dfa.marks == 0).sum() * width)
        self.marks, self.width, self.classes, self.lane = dfa.marks[order], width, dfa.classes.astype(np.int32), lane

    def accepts(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of bytes after which a rule has just matched, ascending, and the rules' bits there."""
        n = len(data)
        lanes = max(1, -(-n // self.lane))
        padded = np.full(lanes * self.lane, BREAK, np.uint8)
        padded[:n] = data
        symbols = np.ascontiguousarray(self.classes[padded].reshape(lanes, self.lane).T)
        states = np.empty((self.lane, lanes), np.int32)
        began = np.full(lanes, self.root, np.int32)
        state = began
        for t in range(self.lane):
            state = self.table[state + symbols[t]]
            states[t] = state
        for _ in range(REPAIRS):
            should = np.concatenate([[self.root], states[-1, :-1]]).astype(np.int32)
            wrong = np.flatnonzero(should != began)
            if not len(wrong):
                break
            began = should
            self._again(symbols, states, wrong, should[wrong])
        else:
            should = self._chained(symbols, states)
            wrong = np.flatnonzero(should != began)
            self._again(symbols, states, wrong, should[wrong])
        t, lane = np.nonzero(states >= self.first_accept)
        where = lane * self.lane + t
        order = np.argsort(where)
        return where[order], self.marks[states[t, lane][order] // self.width]

    def _again(self, symbols: np.ndarray, states: np.ndarray, lanes: np.ndarray, state: np.ndarray) -> None:
        """Run lanes from other states until they fall in with what was recorded."""
        for t in range(self.lane):
            if not len(lanes):
                break
            state = self.table[state + symbols[t, lanes]]
            differs = state != states[t, lanes]
            if not differs.all():
                lanes, state = lanes[differs], state[differs]
            states[t, lanes] = state

    def _chained(self, symbols: np.ndarray, states: np.ndarray) -> np.ndarray:
        """The state in which each lane really begins, where a long run carries one state from lane to lane.

        Ends of all lanes are found side by side for each state that a lane can begin in, starting with the recorded
        ends, until no new one comes up; following them from lane to lane is then a lookup. A run repeats, so there are few."""
        number, ends = {self.root: 0}, [states[-1]]
        while True:
            new = [s for s in np.unique(np.concatenate(ends[-1:])).tolist() if s not in number]
            if not new:
                break
            state = np.repeat(np.array(new, np.int32)[:, None], symbols.shape[1], axis=1)
            for t in range(self.lane):
                state = self.table[state + symbols[t]]
            number |= {s: len(number) + i for i, s in enumerate(new)}
            ends.append(state)
        after = np.vstack([e.reshape(-1, symbols.shape[1]) for e in ends])
        out, at = np.empty(symbols.shape[1], np.int32), self.root
        for lane in range(symbols.shape[1]):
            out[lane] = at
            at = int(after[number[at], lane])
        return out
