"""SentencePiece encoding and decoding: score-ordered agendas of adjacent symbol pairs, for merge-type vocabularies.

A text becomes symbols, one for each character. Its agenda holds the adjacent pairs whose concatenation is a piece; the pair of
the best score goes first, the leftmost of equal ones. Merging it takes its neighbours' old pairs off the agenda and puts new ones
on. In these vocabularies no piece goes on after a white-space mark that follows another character, so texts fall into
independent units, and each distinct unit is merged once: short ones together, as the rows of one array of agendas, long ones by a
heap. Characters without a piece become their bytes' pieces.

Each new unit is held against the sentencepiece library, an Arrow batch at a time, and a difference raises. So the result is the
library's, and pieces are never decided by it.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import sliced

SPACE_MARK = "▁"
#: Symbols in the widest unit that the array of agendas takes; units kept in a worker's memory before it starts anew.
WIDTHS, KEPT = (6, 8, 10, 12, 16, 32), 500_000
NONE = np.iinfo(np.int32).max


class Codec:
    """Encoder for one model file. ids("text") gives the ids without begin, end or sampling."""

    def __init__(self, model: str) -> None:
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        pieces = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces) or not all(sp.is_byte(i) for i in self.byte_id):
            raise ValueError("this codec needs byte pieces, and white-space marks at the head of pieces only")
        # symbols: pieces by their ids, then characters that only occur within pieces
        symbol = dict(pieces)
        for c in sorted({c for p in pieces for c in p} - set(pieces)):
            symbol[c] = n + len(symbol)
        self.pieces, self.n = n, max(symbol.values()) + 1
        self.char = np.full(0x110000, -1, dtype=np.int32)
        for s, i in symbol.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        self.symbol = symbol
        scores = sorted({sp.get_score(i) for i in pieces.values()}, reverse=True)
        level = {x: k for k, x in enumerate(scores)}  # pieces of one score are of one level: of those the leftmost pair goes first
        #: pair of symbols, as one number -> level, merged symbol
        self.pair = {symbol[p[:k]] * self.n + symbol[p[k:]]: (level[sp.get_score(i)], i) for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol}
        self.keys = np.array(sorted(self.pair), dtype=np.int64)
        self.levels, self.merged = (np.array([self.pair[k][x] for k in self.keys.tolist()], dtype=np.int32) for x in (0, 1))
        lone = "" if any("\n" in p and len(p) > 1 for p in pieces) else "\n"
        self.unit = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}{lone}]+|{SPACE_MARK}+" + "|\n" * bool(lone))
        self.decimal = [str(i) for i in range(n)]
        self.lone = lone
        self.known: dict[str, tuple[int, ...]] = {}

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pairs of symbols are in the table, and whether they are."""
        key = left.astype(np.int64) * self.n + right
        key[(left < 0) | (right < 0)] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, self.keys[at] == key

    def _level(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at, there = self._find(left, right)
        return np.where(there, self.levels[at], NONE)

    def _together(self, units: list[str], width: int) -> list[tuple[int, ...]]:
        """The agendas of many short units as the rows of one array, popped in step."""
        count = np.array([len(u) for u in units])
        codes = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        ids = np.full((len(units), width + 1), -2, dtype=np.int32)  # a column more, always empty
        inside = np.arange(width + 1) < count[:, None]
        ids[inside] = np.where(self.char[codes] >= 0, self.char[codes], -3 - codes.astype(np.int32))
        agenda = np.full((len(units), width + 1), NONE, dtype=np.int32)
        agenda[:, :-1] = self._level(ids[:, :-1].reshape(-1), ids[:, 1:].reshape(-1)).reshape(len(units), width)
        rows, live, pairs, columns = np.arange(len(units)), ids.copy(), agenda, np.arange(width)
        while len(rows):
            at = pairs.argmin(axis=1)
            best = pairs[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                ids[rows[done]] = live[done]
                rows, live, pairs, at = rows[~done], live[~done], pairs[~done], at[~done]
                if not len(rows):
                    break
            own = np.arange(len(rows))
            new = self.merged[self._find(live[own, at], live[own, at + 1])[0]]
            after = columns > at[:, None]
            live[:, :-1] = np.where(after, live[:, 1:], live[:, :-1])
            pairs[:, :-1] = np.where(after, pairs[:, 1:], pairs[:, :-1])
            live[:, -1], pairs[:, -1] = -2, NONE
            live[own, at] = new
            pairs[own, at] = self._level(live[own, at], live[own, at + 1])
            left = at > 0
            pairs[own[left], at[left] - 1] = self._level(live[own[left], at[left] - 1], live[own[left], at[left]])
        there = ids != -2
        flat, ends = ids[there].tolist(), np.cumsum(there.sum(axis=1)).tolist()
        out = [tuple(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        for k in np.flatnonzero((ids < -2).any(axis=1) | (ids >= self.pieces).any(axis=1)).tolist():
            out[k] = self._out(list(out[k]))
        return out

    def _out(self, row: list[int]) -> tuple[int, ...]:
        out: list[int] = []
        for x in row:
            if 0 <= x < self.pieces:
                out.append(x)
            else:
                out.extend(self.byte_id[b] for b in (chr(-3 - x) if x < 0 else self._lone(x)).encode())
        return tuple(out)

    def _lone(self, x: int) -> str:
        return next(s for s, i in self.symbol.items() if i == x)

    def _alone(self, unit: str) -> tuple[int, ...]:
        """One long unit: a heap of (level, place) over a linked list of symbols."""
        row = [int(self.char[ord(c)]) if self.char[ord(c)] >= 0 else -3 - ord(c) for c in unit]
        after, before = list(range(1, len(row) + 1)), list(range(-1, len(row) - 1))
        agenda: list[tuple[int, int, int, int]] = []

        def put(i: int, j: int) -> None:
            if i >= 0 and j < len(row) and row[i] >= 0 and row[j] >= 0 and (to := self.pair.get(row[i] * self.n + row[j])):
                heapq.heappush(agenda, (to[0], i, row[i], row[j]))

        for i in range(len(row) - 1):
            put(i, i + 1)
        gone = -2
        while agenda:
            _, i, a, b = heapq.heappop(agenda)
            j = after[i]
            if row[i] != a or j >= len(row) or row[j] != b:
                continue  # one of the two has been merged since
            row[i], row[j] = self.pair[a * self.n + b][1], gone
            after[i] = after[j]
            if after[j] < len(row):
                before[after[j]] = i
            put(before[i], i)
            put(i, after[i])
        return self._out([x for x in row if x != gone])

    def units(self, text: str | None) -> list[str]:
        if not text:
            return []
        if text[0] == " " or "  " in text or SPACE_MARK in text or not self.lone:
            return self.unit.findall(SPACE_MARK + text.replace(" ", SPACE_MARK))
        # the same units, where no two marks meet
        return [u for u in (SPACE_MARK + text).replace(" ", f" {SPACE_MARK}").replace("\n", " \n ").split(" ") if u]

    def learn(self, units: set[str]) -> None:
        """Encodes units that aren't known yet and holds them against the library."""
        if len(self.known) > KEPT:
            self.known.clear()
        fresh = [u for u in units if u not in self.known]
        if not fresh:
            return
        found: dict[str, tuple[int, ...]] = {}
        low = 0
        for width in WIDTHS:
            some = [u for u in fresh if low < len(u) <= width]
            for k in range(0, len(some), 1 << 15):
                found.update(zip(some[k : k + (1 << 15)], self._together(some[k : k + (1 << 15)], width), strict=True))
            low = width
        found.update((u, self._alone(u)) for u in fresh if len(u) > low)
        # the library puts a mark before each text: units with one of their own go without it, and others after a line feed
        theirs = self.library.encode([u[1:] if u[0] == SPACE_MARK else "\n" + u for u in fresh], num_threads=1)
        for u, ids in zip(fresh, theirs, strict=True):
            if u[0] != SPACE_MARK:
                ids = ids[2:]
            elif len(u) == 1:
                ids = list(found[u])  # a lone mark can't be asked for: the library has no ids for an empty text
            if tuple(ids) != found[u]:
                raise AssertionError(f"{u!r} is {found[u]} here and {ids} by the library")
        self.known.update(found)

    def ids(self, text: str | None) -> list[int]:
        units = self.units(text)
        self.learn(set(units))
        return list(chain.from_iterable(map(self.known.__getitem__, units)))


_CODECS: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    """The worker's codec for a model file; its known units serve all its later tasks."""
    if model not in _CODECS:
        _CODECS[model] = Codec(model)
    return _CODECS[model]


def encode_decode(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with_ids also ids and decoded.

    Null and empty texts have no ids and decode to an empty text. Other columns are not read.
    """
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
        names += ["ids", "decoded"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in sliced(batches, "text", 2 << 20):
            cut = [own.units(x) for x in batch.column("text").to_pylist()]
            own.learn(set(chain.from_iterable(cut)))
            ids = [list(chain.from_iterable(map(own.known.__getitem__, u))) for u in cut]
            joined = [",".join(map(own.decimal.__getitem__, x)) for x in ids]
            decoded = own.library.decode(ids, num_threads=1) if ids else []
            columns = [batch.column("doc_id"), pa.array(list(map(len, ids)), pa.int64()), pa.array(list(map(sha, joined))), pa.array(list(map(sha, decoded)))]
            if with_ids:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(each, T.StructType(fields))
