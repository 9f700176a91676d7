"""Minimal acyclic transducers: sorted words with id sequences as outputs, in an automaton that shares prefixes and suffixes.

Words are added in order of their bytes. Of the word before, the nodes behind the common prefix can change no more; each is looked up among
the nodes made so far and replaced by an equal one, so suffixes are shared. Outputs stand as near to the root as the words that share
an edge allow, which is what makes their ends equal. The finished automaton is three flat arrays in one file, which is mapped into
memory and walked by many words in step.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Arrays of a file, in order, and their types; edges are sorted by state and byte.
ARRAYS = [("edge", np.int64), ("target", np.int32), ("edge_from", np.int32), ("edge_len", np.int32), ("final_from", np.int32), ("final_len", np.int32), ("pool", np.uint32), ("final", np.int8)]
MAGIC = 0x4C455831


class _Node:
    __slots__ = ("edges", "final", "rest")

    def __init__(self) -> None:
        self.edges: list[list] = []  # [byte, state, output]; the last one may still change
        self.final, self.rest = False, ()


def compiled(words: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The file of an automaton for distinct words (not empty, sorted by bytes) and their outputs."""
    states: dict[tuple, int] = {}

    def frozen(node: _Node) -> int:
        return states.setdefault((node.final, node.rest, tuple((b, s, o) for b, s, o in node.edges)), len(states))

    path, before = [_Node()], b""
    for word, output in words:
        if word <= before:
            raise ValueError("words must be distinct, not empty and in order")
        same = next((k for k, (x, y) in enumerate(zip(word, before)) if x != y), min(len(word), len(before)))
        for k in range(len(before), same, -1):
            path[k - 1].edges[-1][1] = frozen(path.pop())
        for k in range(same):
            edge, below = path[k].edges[-1], path[k + 1]
            n = next((i for i, (x, y) in enumerate(zip(edge[2], output)) if x != y), min(len(edge[2]), len(output)))
            rest = edge[2][n:]
            if rest:
                edge[2] = edge[2][:n]
                for e in below.edges:
                    e[2] = rest + e[2]
                if below.final:
                    below.rest = rest + below.rest
            output = output[n:]
        for k in range(same, len(word)):
            path[k].edges.append([word[k], -1, output if k == same else ()])
            path.append(_Node())
        path[-1].final = True
        before = word
    for k in range(len(before), 0, -1):
        path[k - 1].edges[-1][1] = frozen(path.pop())
    root = frozen(path[0])
    return _flat(list(states), root)


def _flat(states: list[tuple], root: int) -> bytes:
    pool: list[int] = []
    place: dict[tuple, int] = {}

    def at(output: tuple) -> int:
        if output not in place:
            place[output] = len(pool)
            pool.extend(output)
        return place[output]

    rows: dict[str, list] = {name: [] for name, _ in ARRAYS}
    for number, (final, rest, edges) in enumerate(states):
        rows["final"].append(final)
        rows["final_from"].append(at(rest))
        rows["final_len"].append(len(rest))
        for byte, target, output in sorted(edges):
            rows["edge"].append(number * 256 + byte)
            rows["target"].append(target)
            rows["edge_from"].append(at(output))
            rows["edge_len"].append(len(output))
    rows["pool"] = pool
    arrays = [np.array(rows[name], dtype=kind) for name, kind in ARRAYS]
    head = np.array([MAGIC, root, *map(len, arrays)], dtype=np.int64).tobytes()
    # the file ends with a byte that is never read, so that no array begins behind its end
    return head + b"".join(x.tobytes() for x in arrays) + b"\0"


class Lexicon:
    """An automaton in a file, mapped into memory."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, dtype=np.uint8, mode="r")
        head = data[: 8 * (len(ARRAYS) + 2)].view(np.int64)
        if head[0] != MAGIC:
            raise ValueError("not a lexicon")
        self.root, start = int(head[1]), head.nbytes
        for (name, kind), n in zip(ARRAYS, head[2:].tolist()):
            size = n * np.dtype(kind).itemsize
            setattr(self, name, data[start : start + size].view(kind))  # larger types come first, so all are aligned
            start += size

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each word is in the lexicon, how many ids it has, and all words' ids behind one another. All words take a step at a time."""
        there, count = np.zeros(len(words), dtype=bool), np.zeros(len(words), dtype=np.int64)
        if not len(self.edge) or not words:
            return there, count, np.zeros(0, np.uint32)
        size = np.array([len(w) for w in words])
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        start = np.cumsum(size) - size
        live = np.arange(len(words))
        state = np.full(len(words), self.root, dtype=np.int64)
        said: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, and where in the pool their next ids are
        for k in range(int(size.max()) + 1):
            at_end = size[live] == k
            if at_end.any():
                good = self.final[state[at_end]] == 1
                word, last = live[at_end][good], state[at_end][good]
                there[word] = True
                said.append((word, self.final_from[last], self.final_len[last]))
                live, state = live[~at_end], state[~at_end]
            if not len(live):
                break
            key = state * 256 + text[start[live] + k]
            edge = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            on = self.edge[edge] == key
            live, edge = live[on], edge[on]
            state = self.target[edge].astype(np.int64)
            said.append((live, self.edge_from[edge], self.edge_len[edge]))
        word, place, n = (np.concatenate([x[i] for x in said]).astype(np.int64) for i in range(3))
        some = there[word] & (n > 0)
        word, place, n = word[some], place[some], n[some]
        in_order = np.argsort(word, kind="stable")
        word, place, n = word[in_order], place[in_order], n[in_order]
        np.add.at(count, word, n)
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(place, n)
        return there, count, self.pool[at]
