"""Cheapest repairs of role sequences: transfer matrices over four states, for the rules of a Re-Pair grammar.

A conversation reads as symbols, one for each row: its role (``s``, ``u``, ``a`` or ``o`` for others) with its fault, upper case
if the text is cut off, or ``x`` for a row that must go. States say what was kept so far: nothing (0), a system row (1), a user
row last (2), an assistant row last (3). A symbol's matrix says, for each state before and after, what the cheapest edits cost,
inserted rows included; the matrix of symbols in a row is the min-plus product of theirs.

Of edits that cost the same the ASCII-least audit counts. No audit need be formed to compare two: both are edits of the same
rows from the same state, end in an edit of the last row and lead to unlike states, so neither is the start of the other, and
the first part in which they differ decides. A matrix therefore holds, for each state before, the rank of the audits by the
state after, and the product ranks by the first factor's ranks, then the second's. The audit itself is a rope: a rule keeps the
state between its two parts, and a rope is written out, part by part, only for the edits that are chosen.

Rules come in rounds. The pairs that follow each other most often become the rules of a round, such that no symbol ends one
pair and begins another (a pair of one symbol twice stands alone); so no two occurrences overlap, and the order of replacing
doesn't matter.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

SYMBOLS = "suaoSUAOx"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
#: The state each role leads to from each state; a missing one is not allowed there.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTED = (0, 3)
STATES = 4
IMPOSSIBLE = np.int64(1) << 60
BREAK = -1


def edits() -> dict[tuple[str, int, int], tuple[int, str]]:
    """Cost and audit of the cheapest edits of one row from one state to another, the rows inserted before it included."""
    before = {(i, i): "" for i in range(STATES)}
    for i in range(STATES):
        at = i
        for n in (1, 2):
            at = next(to for (state, role), to in NEXT.items() if state == at and role in "ua")
            before.setdefault((i, at), "I" * n)
    best: dict[tuple[str, int, int], tuple[int, str]] = {}
    for symbol in SYMBOLS:
        more = CUT_OFF if symbol.isupper() else 0
        for (i, k), inserted in before.items():
            moves = [(DELETE, "D", k)]
            if symbol != "x":
                moves += [(KEEP + more, "K", to) for (state, role), to in NEXT.items() if state == k and role == symbol.lower()]
                moves += [(REROLE + more, "R", to) for (state, role), to in NEXT.items() if state == k and role in "ua"]
            for cost, letter, to in moves:
                found = (cost + INSERT * len(inserted), inserted + letter)
                best[symbol, i, to] = min(found, best.get((symbol, i, to), found))
    return best


EDITS = edits()


def ranks(first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """For each row of the last axis the place of every entry in rising order of ``first``, then ``second``."""
    key = first if second is None else first * STATES + second
    return np.argsort(np.argsort(key, axis=-1, kind="stable"), axis=-1, kind="stable").astype(np.int64)


def terminals() -> tuple[np.ndarray, np.ndarray]:
    costs = np.full((len(SYMBOLS), STATES, STATES), IMPOSSIBLE)
    places = np.zeros((len(SYMBOLS), STATES, STATES), np.int64)
    for n, symbol in enumerate(SYMBOLS):
        for i in range(STATES):
            # What is impossible comes last; it is never chosen.
            audits = sorted((EDITS[symbol, i, j][1] if (symbol, i, j) in EDITS else "~", j) for j in range(STATES))
            for place, (_, j) in enumerate(audits):
                places[n, i, j] = place
                if (symbol, i, j) in EDITS:
                    costs[n, i, j] = EDITS[symbol, i, j][0]
    return costs, places


def product(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs, ranks and the states between, of pairs of matrices (stacked)."""
    (cost_a, rank_a), (cost_b, rank_b) = a, b
    sums = np.minimum(cost_a[:, :, :, None] + cost_b[:, None, :, :], IMPOSSIBLE)
    # Costs are far below 2 ** 60, so cost and rank fit one number.
    order = sums * STATES + rank_a[:, :, :, None]
    middle = order.argmin(axis=2)
    costs = np.take_along_axis(sums, middle[:, :, None, :], axis=2)[:, :, 0, :]
    first = np.take_along_axis(rank_a, middle, axis=2)
    second = np.take_along_axis(rank_b, middle, axis=1)
    none = costs >= IMPOSSIBLE
    return costs, ranks(np.where(none, STATES, first), np.where(none, 0, second)), middle


class Grammar:
    """Rules in rounds, each with its matrix; symbols below ``len(SYMBOLS)`` are terminals."""

    def __init__(self) -> None:
        self.costs, self.ranks = terminals()
        self.middles = np.zeros_like(self.ranks)
        self.left, self.right = [BREAK] * len(SYMBOLS), [BREAK] * len(SYMBOLS)
        self.rounds: list[tuple[np.ndarray, np.ndarray, int]] = []
        self._texts: dict[tuple[int, int, int], str] = {}

    def __len__(self) -> int:
        return len(self.left)

    def add(self, pairs: Sequence[tuple[int, int]]) -> None:
        """A round of rules; the matrix of each is the product of its two symbols'."""
        a, b = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        costs, places, middles = product((self.costs[a], self.ranks[a]), (self.costs[b], self.ranks[b]))
        code = a.astype(np.int64) << 32 | b
        order = np.argsort(code)
        self.rounds.append((code[order], len(self) + order, len(self)))
        self.costs = np.concatenate([self.costs, costs])
        self.ranks = np.concatenate([self.ranks, places])
        self.middles = np.concatenate([self.middles, middles])
        self.left += a.tolist()
        self.right += b.tolist()

    def rewritten(self, flat: np.ndarray) -> np.ndarray:
        """Symbols (sequences set apart by ``BREAK``) with the rules put in place of their pairs, round by round."""
        for codes, names, _ in self.rounds:
            at, found = occurrences(flat, codes)
            flat = flat.copy()
            flat[at] = names[found]
            keep = np.ones(len(flat), bool)
            keep[at + 1] = False
            flat = flat[keep]
        return flat

    def audit(self, symbol: int, i: int, j: int) -> str:
        """The rope of a symbol from one state to another, written out. Ropes of rules are kept, as many texts share them."""
        known = self._texts.get((symbol, i, j))
        if known is not None:
            return known
        if symbol < len(SYMBOLS):
            return EDITS[SYMBOLS[symbol], i, j][1]
        k = int(self.middles[symbol, i, j])
        # Rules are as deep as there are rounds, at most.
        text = self.audit(self.left[symbol], i, k) + self.audit(self.right[symbol], k, j)
        if len(self._texts) >= 1 << 16:
            self._texts.clear()
        self._texts[symbol, i, j] = text
        return text


def occurrences(flat: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pairs of a round (``codes``, rising) begin, and which; in a run of one symbol every second place counts."""
    if len(flat) < 2 or not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = flat[:-1].astype(np.int64), flat[1:].astype(np.int64)
    code = np.where((a < 0) | (b < 0), -1, a << 32 | np.maximum(b, 0))
    found = np.searchsorted(codes, code).clip(max=len(codes) - 1)
    at = np.flatnonzero(codes[found] == code)
    at = at[evenly(flat, at)]
    return at, found[at]


def evenly(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the places count, where pairs of one symbol twice must not overlap."""
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    start = first[np.searchsorted(first, at, "right") - 1]
    twice = flat[at] == flat[at + 1]
    return ~twice | ((at - start) % 2 == 0)


def pair_counts(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that follow each other, and how often, without overlap."""
    at = np.flatnonzero((flat[:-1] >= 0) & (flat[1:] >= 0)) if len(flat) > 1 else np.empty(0, np.int64)
    at = at[evenly(flat, at)] if len(at) else at
    code = flat[at].astype(np.int64) << 32 | flat[at + 1] if len(at) else np.empty(0, np.int64)
    codes, counts = np.unique(code, return_counts=True)
    return codes >> 32, codes & 0xFFFFFFFF, counts


def chosen(pairs: Sequence[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Of pairs in falling order of how often they occur, those that can be replaced together."""
    starts, ends, out = set(), set(), []
    for a, b in pairs:
        if len(out) == most:
            break
        if a in ends or b in starts or (a == b and (a in starts or b in ends)):
            continue
        starts.add(a)
        ends.add(b)
        out.append((a, b))
    return out


def flattened(texts: Sequence[str]) -> np.ndarray:
    """Terminal symbols of the texts, each text followed by a break."""
    table = np.full(128, BREAK, np.int64)
    table[[ord(c) for c in SYMBOLS]] = range(len(SYMBOLS))
    return table[np.frombuffer("".join(t + "\n" for t in texts).encode("ascii"), np.uint8)]


class Folds:
    """The matrices of several symbol sequences, and the states between their symbols."""

    def __init__(self, sequences: Sequence[np.ndarray], costs: np.ndarray, places: np.ndarray) -> None:
        """``costs`` and ``places`` are the matrices that the symbols number. A sequence without symbols keeps each state."""
        self.sequences = sequences
        lengths = np.array([len(s) for s in sequences], np.int64)
        n = len(sequences)
        self.costs = np.full((n, STATES, STATES), IMPOSSIBLE)
        self.costs[:, range(STATES), range(STATES)] = 0
        self.places = np.tile(np.arange(STATES, dtype=np.int64), (n, STATES, 1))
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []
        for step in range(int(lengths.max(initial=0))):
            active = np.flatnonzero(lengths > step)
            symbols = np.array([sequences[i][step] for i in active])
            if step == 0:
                self.costs[active], self.places[active] = costs[symbols], places[symbols]
                self.steps.append((active, np.empty(0, np.int8)))
                continue
            mine = (self.costs[active], self.places[active])
            self.costs[active], self.places[active], middles = product(mine, (costs[symbols], places[symbols]))
            self.steps.append((active, middles.astype(np.int8)))

    def path(self, number: int, entry: int, leave: int) -> list[int]:
        """The states before, between and after the symbols of a sequence."""
        states = [leave]
        for step in range(len(self.sequences[number]) - 1, 0, -1):
            active, middles = self.steps[step]
            place = int(np.searchsorted(active, number))
            states.append(int(middles[place, entry, states[-1]]))
        return [entry, *reversed(states)] if len(self.sequences[number]) else [entry]


def last_state(costs: np.ndarray, places: np.ndarray) -> tuple[int, int, int]:
    """Of a whole conversation's matrix: the state its edits lead to, what they cost with the rows still to be inserted at the
    end, and how many those are."""
    missing = {0: 0, 1: 2, 2: 1, 3: 0}
    found = [(int(costs[0, j]) + INSERT * missing[j], int(places[0, j]), j) for j in range(STATES) if costs[0, j] < IMPOSSIBLE]
    cost, _, j = min(found)
    return j, cost, missing[j]
