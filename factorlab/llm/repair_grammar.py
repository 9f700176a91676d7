"""Cheapest repairs of sequences of rows, by min-plus transfer matrices over a grammar of repeated pairs.

A repaired conversation is empty or an optional system row and one or more pairs of user and assistant. That is an automaton of four states,
and each row is a matrix of the cheapest way from one state to another: insertions before the row, then keeping, reroling or deleting
it. Costs add up along a way and the least wins, so the matrix of a sequence is the min-plus product of its rows' matrices. The letters
of the edits are a rope that shares its parts with the ropes it was joined from.

Of ways that cost the same the one with the least letters wins. That may be decided part by part, since no way's letters are
the beginning of another's: both have a letter for each row and end with one.

Re-Pair replaces the most frequent pair of neighbouring symbols by a new one, again and again, over all sequences of a batch. Each rule has
one matrix, made of those of its two symbols, which all sequences that hold it share.
"""

from __future__ import annotations

import heapq
from itertools import pairwise

START, SYSTEM, USER, ASSISTANT = range(4)
#: Pairs of states between which there are ways, and for each pair the states in between.
WAYS = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]
_AT = {w: k for k, w in enumerate(WAYS)}
_VIA = [[(_AT[p, r], _AT[r, q]) for r in range(4) if (p, r) in _AT and (r, q) in _AT] for p, q in WAYS]
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Insertions that lead from state to state; longer ones come back to where a shorter one was.
INSERTIONS = {(0, 0): "", (0, 2): "I", (0, 3): "II", (1, 1): "", (1, 2): "I", (1, 3): "II", (2, 2): "", (2, 3): "I", (3, 3): "", (3, 2): "I"}
#: Symbols: a row that must go; else the initial of its role (o: any other), in capitals if its text is truncated.
SYMBOLS = "xsuaoSUAO"
RULES = 50_000

Rope = str | tuple
Matrix = list[tuple[int, Rope] | None]


def letters(rope: Rope) -> str:
    out, todo = [], [rope]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo += (x[1], x[0])
    return "".join(out)


def comes_before(a: Rope, b: Rope) -> bool:
    """Whether a's letters are less than b's. Parts that both share at the same place are not looked at."""
    x, y, left, right = [a], [b], "", ""
    while True:
        while not left and x:
            if not right and y and x[-1] is y[-1]:
                x.pop(), y.pop()
                continue
            top = x.pop()
            if isinstance(top, str):
                left = top
            else:
                x += (top[1], top[0])
                if not right and y and not isinstance(y[-1], str):
                    other = y.pop()
                    y += (other[1], other[0])
        while not right and y:
            top = y.pop()
            if isinstance(top, str):
                right = top
            else:
                y += (top[1], top[0])
        if not left or not right:
            return bool(right)
        n = min(len(left), len(right))
        if left[:n] != right[:n]:
            return left[:n] < right[:n]
        left, right = left[n:], right[n:]


def _better(a: tuple[int, Rope] | None, b: tuple[int, Rope]) -> bool:
    """Whether b wins over a."""
    return a is None or b[0] < a[0] or (b[0] == a[0] and b[1] != a[1] and comes_before(b[1], a[1]))


def row_matrix(symbol: str) -> Matrix:
    """All ways that a row can be taken, with the insertions before it."""
    own, cut = symbol.lower(), TRUNCATED * symbol.isupper()
    moves = [(p, p, DELETE, "D") for p in range(4)]
    if symbol != "x":
        kept = {"s": [(START, SYSTEM)], "u": [(START, USER), (SYSTEM, USER), (ASSISTANT, USER)], "a": [(USER, ASSISTANT)]}.get(own, [])
        moves += [(p, q, KEEP + cut, "K") for p, q in kept]
        moves += [(p, q, REROLE + cut, "R") for p, q in ((START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT))]
    out: Matrix = [None] * len(WAYS)
    for (p, r), put in INSERTIONS.items():
        for a, q, cost, letter in moves:
            way = (INSERT * len(put) + cost, put + letter)
            if a == r and _better(out[_AT[p, q]], way):
                out[_AT[p, q]] = way
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for via in _VIA:
        best = None
        for i, j in via:
            x, y = a[i], b[j]
            if x is None or y is None:
                continue
            cost = x[0] + y[0]
            if best is None or cost < best[0] or (cost == best[0] and comes_before((x[1], y[1]), best[1])):
                best = (cost, (x[1], y[1]))
        out.append(best)
    return out


class Grammar:
    """Rules that sequences share, each with its matrix. They last until there are RULES of them."""

    def __init__(self) -> None:
        self.rule: dict[tuple[int, int], int] = {}
        self.matrices = [row_matrix(s) for s in SYMBOLS]

    def matrices_of(self, sequences: list[str]) -> dict[str, Matrix]:
        """The matrix of each distinct sequence of symbols (none is empty)."""
        if len(self.matrices) > RULES:
            self.__init__()
        distinct = list(dict.fromkeys(sequences))
        short = self._pair_up([[SYMBOLS.index(c) for c in s] for s in distinct])
        return {s: self.matrices[self._one(rest)] for s, rest in zip(distinct, short)}

    def _number(self, a: int, b: int) -> int:
        """The symbol that stands for two, made with its matrix if it is new."""
        if (a, b) not in self.rule:
            self.rule[a, b] = len(self.matrices)
            self.matrices.append(product(self.matrices[a], self.matrices[b]))
        return self.rule[a, b]

    def _one(self, symbols: list[int]) -> int:
        """What no rule joins is joined by halves."""
        while len(symbols) > 1:
            symbols = [self._number(*symbols[k : k + 2]) if k + 1 < len(symbols) else symbols[k] for k in range(0, len(symbols), 2)]
        return symbols[0]

    def _pair_up(self, sequences: list[list[int]]) -> list[list[int]]:
        """Re-Pair: sequences in which no pair of neighbours is found twice."""
        symbol = [x for s in sequences for x in (*s, -1)]
        n = len(symbol)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        places: dict[tuple[int, int], set[int]] = {}
        for k, (a, b) in enumerate(pairwise(symbol)):
            if a >= 0 and b >= 0:
                places.setdefault((a, b), set()).add(k)
        heap = [(-len(v), p) for p, v in places.items() if len(v) > 1]
        heapq.heapify(heap)
        while heap:
            count, pair = heapq.heappop(heap)
            at = places.get(pair, ())
            if len(at) < 2:
                continue
            if len(at) != -count:
                heapq.heappush(heap, (-len(at), pair))
                continue
            del places[pair]
            new = self._number(*pair)
            grown: set[tuple[int, int]] = set()
            for k in sorted(at):
                j = after[k]
                if symbol[k] != pair[0] or j < 0 or symbol[j] != pair[1]:
                    continue  # a neighbour took one of the two
                for i, p in ((before[k], (symbol[before[k]], pair[0])), (j, (pair[1], symbol[after[j]]))):
                    if i >= 0 and p in places:
                        places[p].discard(i)
                symbol[k], symbol[j] = new, -2
                after[k] = after[j]
                before[after[j]] = k  # there is a separator behind each sequence
                for i, p in ((before[k], (symbol[before[k]], new)), (k, (new, symbol[after[k]]))):
                    if i >= 0 and min(p) >= 0:
                        places.setdefault(p, set()).add(i)
                        grown.add(p)
            for p in grown:
                if len(places[p]) > 1:
                    heapq.heappush(heap, (-len(places[p]), p))
        out, start = [], 0
        for s in sequences:
            out.append([x for x in symbol[start : start + len(s)] if x >= 0])
            start += len(s) + 1
        return out


class Walk:
    """The cheapest way through the matrices of one conversation's pieces, taken one after another.

    Letters of pieces before are never compared again: their order among the four states is kept as a rank.
    """

    def __init__(self) -> None:
        self.best: dict[int, tuple] = {START: (0, 0, None)}  # state -> cost, rank of the letters, (way before, start, letters)

    def step(self, ways: list[tuple[int, str] | None]) -> None:
        found: dict[int, tuple] = {}
        for (p, q), way in zip(WAYS, ways):
            if way is not None and p in self.best:
                cost, rank, path = self.best[p]
                key = (cost + way[0], rank, way[1])
                if q not in found or key < found[q][0]:
                    found[q] = (key, (path, p, way[1]))
        ranks = {x: k for k, x in enumerate(sorted({key[1:] for key, _ in found.values()}))}
        self.best = {q: (key[0], ranks[key[1:]], path) for q, (key, path) in found.items()}

    def end(self) -> tuple[int, list[tuple[int, str]]]:
        """The cost, and each piece's state at its beginning and letters; insertions at the end are the last piece's."""
        ways = []
        for q, (cost, rank, path) in self.best.items():
            # what has no row yet may also stay empty
            ways += [(cost + INSERT * len(put), rank, put, path) for put in (INSERTIONS[q, ASSISTANT], "")[: 1 + (q == START)]]
        cost, _, put, path = min(ways, key=lambda w: w[:3])
        pieces = []
        while path:
            path, start, text = path
            pieces.append((start, text))
        pieces.reverse()
        if put:
            pieces[-1] = (pieces[-1][0], pieces[-1][1] + put)
        return cost, pieces
