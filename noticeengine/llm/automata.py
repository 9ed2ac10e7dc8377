"""Probabilistic automata inferred from example strings by state merging.

Examples are counted by cells: a depth, the symbol before it, and the symbol or the end that follows.
The cells of all examples are a bounded table, however many and however long these are, so they can be
added up anywhere; depths from DEEPEST on share their cells. A state is first a depth and the symbol
before it, and states are merged in two passes. First, states of one depth are merged when their stop
and symbol frequencies, and those of all states that follow, differ by less than a Hoeffding bound: a
depth then has as many states as the format has branches, with all the counts that tell it from other
depths. Then states of different depths are merged by the same test, which loops the parts of a format
that may be of any length and keeps those of a fixed one, since a stop at one depth only makes all
depths before it differ.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Pseudo-count of symbols that a state has not seen, dealt out as all states see them.
UNSEEN = 1.0
#: Symbols besides the examples' own that the overall distribution leaves room for.
ROOM = 70
#: From this depth on states are known by the symbol before them only.
DEEPEST = 256


@dataclass
class Automaton:
    """Per state, the state after each symbol and its log2 probability; the state after any other one; and of a stop."""

    moves: list[dict[str, tuple[int, float]]]
    other: list[int]
    escape: list[float]
    stop: list[float]
    overall: dict[str, float]
    rare: float

    def bits(self, text: str) -> float:
        """log2 probability of the text and its end."""
        state, total, moves = 0, 0.0, self.moves
        for c in text:
            move = moves[state].get(c)
            if move is None:
                total += self.escape[state] + self.overall.get(c, self.rare)
                state = self.other[state]
            else:
                state, total = move[0], total + move[1]
        return total + self.stop[state]


def cells(symbols: np.ndarray, offs: np.ndarray, size: int) -> np.ndarray:
    """The cell of each symbol and end of the examples symbols[offs[i]:offs[i + 1]]; symbols are numbers below size."""
    lengths = np.diff(offs)
    own = np.full(len(symbols) + len(lengths), size, np.int64)  # size marks the ends, and so also what is before a start
    own[np.arange(len(symbols)) + np.repeat(np.arange(len(lengths)), lengths)] = symbols
    depth = np.arange(len(own)) - np.repeat(offs[:-1] - offs[0] + np.arange(len(lengths)), lengths + 1)
    last = np.concatenate([[size], own[:-1]])
    return (np.minimum(depth, DEEPEST) * (size + 1) + last) * (size + 1) + own


class _States:
    """The states of a table of cells; a merged state is known by the one that it went into."""

    def __init__(self, found: np.ndarray, n: np.ndarray, size: int):
        state, then = np.divmod(found, size + 1)
        self.known, at = np.unique(state, return_inverse=True)
        self.depth = self.known // (size + 1)
        #: Per state the counts of the symbols that follow and, last, of stops.
        self.seen = np.zeros((len(self.known), size + 1), np.int64)
        np.add.at(self.seen, (at, then), n)
        self.next = np.full((len(self.known), size), -1, np.int64)
        go = then < size
        self.next[at[go], then[go]] = np.searchsorted(self.known, np.minimum(self.depth[at[go]] + 1, DEEPEST) * (size + 1) + then[go])
        self.count = self.seen.sum(1)
        self.share = self.seen / self.count[:, None]
        self.into = np.arange(len(self.known))

    def find(self, s: int) -> int:
        while self.into[s] != s:
            self.into[s] = self.into[self.into[s]]
            s = int(self.into[s])
        return s

    def near(self, a, b: int, bound: float) -> np.ndarray:
        """Whether the frequencies of a, a state or several, are within the bound of b's."""
        reach = bound * (1 / np.sqrt(self.count[a]) + 1 / math.sqrt(self.count[b]))
        return np.abs(self.share[a] - self.share[b]).max(-1) <= reach

    def compatible(self, a: int, b: int, bound: float) -> bool:
        todo, done = [(a, b)], set()
        while todo:
            p, q = (self.find(s) for s in todo.pop())
            if p == q or (p, q) in done:
                continue
            done.add((p, q))
            if not self.near(p, q, bound):
                return False
            x, y = self.next[p], self.next[q]
            both = (x >= 0) & (y >= 0) & (x != y)
            todo += set(zip(x[both].tolist(), y[both].tolist()))
        return True

    def merge(self, a: int, b: int) -> None:
        """b goes into a, and so do the states that follow both by one symbol."""
        todo = [(a, b)]
        while todo:
            p, q = (self.find(s) for s in todo.pop())
            if p == q:
                continue
            self.into[q] = p
            self.seen[p] += self.seen[q]
            self.count[p] += self.count[q]
            self.share[p] = self.seen[p] / self.count[p]
            x, y = self.next[p], self.next[q]
            both = (x >= 0) & (y >= 0) & (x != y)
            todo += zip(x[both].tolist(), y[both].tolist())
            self.next[p] = np.where(x >= 0, x, y)


def infer(examples: list[str], alpha: float = 0.05) -> Automaton:
    """Automaton of the examples; alpha is the confidence of the merge test."""
    symbols = "".join(sorted(set("".join(examples))))
    number = {c: i for i, c in enumerate(symbols)}
    offs = np.concatenate([[0], np.cumsum([len(x) for x in examples])]).astype(np.int64)
    found = cells(np.array([number[c] for x in examples for c in x], np.int64), offs, len(symbols))
    return infer_cells(*np.unique(found, return_counts=True), symbols, alpha)


def infer_cells(found: np.ndarray, n: np.ndarray, symbols: str, alpha: float = 0.05) -> Automaton:
    """Automaton of examples that have each of the cells found n times, in all."""
    size = len(symbols)
    states = _States(found, n, size)
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def settle(todo: list[int], kept: list[int]) -> None:
        """Merge each state of todo into the first of kept that it is compatible with, or keep it."""
        for s in todo:
            if states.find(s) != s:
                continue
            own = np.array(kept, np.int64)
            own = own[states.into[own] == own]
            for k in own[states.near(own, s, bound)].tolist() if len(own) else ():
                if states.compatible(k, s, bound):
                    states.merge(k, s)
                    break
            else:
                kept.append(s)

    order: list[int] = []
    for depth in np.unique(states.depth).tolist():
        at = np.flatnonzero(states.depth == depth)
        layer: list[int] = []
        settle(at[np.argsort(-states.count[at], kind="stable")].tolist(), layer)
        order += layer
    kept: list[int] = []
    settle(order, kept)
    kept = [s for s in dict.fromkeys(states.find(k) for k in kept)]
    index = {s: i for i, s in enumerate(kept)}
    seen = states.seen[kept]
    often = seen[:, :size].sum(0)
    overall = {symbols[c]: int(k) for c, k in enumerate(often) if k}
    stops = int(seen[:, size].sum())
    total = int(often.sum()) + stops + ROOM
    moves, other, escape, stop = [], [], [], []
    for i, s in enumerate(kept):
        after = {symbols[c]: (int(seen[i, c]), index[states.find(int(states.next[s, c]))]) for c in np.flatnonzero(seen[i, :size]).tolist()}
        k = int(states.count[s]) + UNSEEN
        moves.append({c: (to, math.log2((m + UNSEEN * (overall[c] + 1) / total) / k)) for c, (m, to) in after.items()})
        other.append(max(((m, c, to) for c, (m, to) in after.items()), default=(0, "", i))[2])
        escape.append(math.log2(UNSEEN / k))
        stop.append(math.log2((int(seen[i, size]) + UNSEEN * (stops + 1) / total) / k))
    return Automaton(moves, other, escape, stop, {c: math.log2((k + 1) / total) for c, k in overall.items()}, math.log2(1 / total))
