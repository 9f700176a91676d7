"""External induced sorting of suffixes with common prefixes, for one shard.

Suffixes are of type L or S as they are larger or smaller than the next one. The leftmost suffixes of runs of type S (S*) are ordered
first: their substrings are sorted by the same induction, named, and the string of names is sorted, by recursion where it is longer
than IN_MEMORY. From the S* suffixes in order all L suffixes are induced by ascending, from those all S suffixes by descending
scans. What a scan finds goes to a priority queue: its priority is the first character, and among equal ones the order in which they
come is the order of the suffixes. Queues carry tuples of position and common prefix with the tuple before, and put themselves on disk
when they hold more than QUEUED tuples; the text, its types, the S* suffixes and their names are files where they are larger than
RESIDENT bytes, so a shard's memory has a bound whatever its size. Common prefixes are counted up to a cap; the one of two suffixes
put in is one more than the least between the two that induced them. Those of S* neighbours are counted in the text.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Callable

import numpy as np

#: Names that are sorted in memory; tuples that a queue holds in memory; tuples in a step of a scan; bytes of an array that stays in memory.
IN_MEMORY, QUEUED, STEP, RESIDENT = 1 << 23, 1 << 22, 1 << 18, 1 << 25


def room(n: int, kind: type) -> np.ndarray:
    """An array of zeros; a large one in an unnamed file of this task's own, which goes with it."""
    if n * np.dtype(kind).itemsize <= RESIDENT:
        return np.zeros(n, dtype=kind)
    return np.memmap(tempfile.TemporaryFile(), dtype=kind, shape=(n,), mode="w+")


class Growing:
    """An array that gets longer: in memory up to RESIDENT bytes, then in an unnamed file of this task's own."""

    def __init__(self, kind: type) -> None:
        self.kind, self.parts, self.held, self.n, self.file = np.dtype(kind), [], 0, 0, None

    def add(self, values: np.ndarray) -> None:
        self.parts.append(values)
        self.n += len(values)
        self.held += values.nbytes
        if self.held > RESIDENT:
            self.file = self.file or tempfile.TemporaryFile()
            for x in self.parts:
                self.file.write(np.ascontiguousarray(x, dtype=self.kind).tobytes())
            self.parts, self.held = [], 0

    def whole(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate(self.parts).astype(self.kind, copy=False) if self.parts else np.zeros(0, self.kind)
        for x in self.parts:
            self.file.write(np.ascontiguousarray(x, dtype=self.kind).tobytes())
        self.parts = []
        self.file.flush()
        return np.memmap(self.file, dtype=self.kind, shape=(self.n,), mode="r+")


class Queue:
    """A priority queue of (position, common prefix) by character; of one character, first come, first served."""

    def __init__(self, descending: bool = False) -> None:
        self.sign = -1 if descending else 1
        self.parts: dict[int, list] = {}
        self.order: list[int] = []
        self.held = 0
        self.file = None

    def put(self, char: int, position: np.ndarray, prefix: np.ndarray) -> None:
        if char not in self.parts:
            self.parts[char] = []
            heapq.heappush(self.order, self.sign * char)
        self.parts[char].append((position, prefix))
        self.held += len(position)
        if self.held > QUEUED:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for parts in self.parts.values():
            for k, part in enumerate(parts):
                if not isinstance(part[0], int):
                    at = self.file.tell()
                    self.file.write(part[0].astype(np.int64).tobytes())
                    self.file.write(part[1].tobytes())
                    parts[k] = (at, len(part[0]))
        self.held = 0

    def _load(self, part: tuple) -> tuple[np.ndarray, np.ndarray]:
        if not isinstance(part[0], int):
            self.held -= len(part[0])
            return part
        at, n = part
        self.file.seek(at)
        return np.frombuffer(self.file.read(8 * n), dtype=np.int64), np.frombuffer(self.file.read(2 * n), dtype=np.uint16)

    def first(self) -> int | None:
        """The character that is next; it stays until it is taken off."""
        return self.sign * self.order[0] if self.order else None

    def some(self, char: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The next tuples of a character, about STEP of them."""
        parts = self.parts.get(char)
        if not parts:
            return None
        n = k = 0
        while k < len(parts) and n < STEP:
            n += parts[k][1] if isinstance(parts[k][0], int) else len(parts[k][0])
            k += 1
        took = [self._load(x) for x in parts[:k]]
        del parts[:k]
        return np.concatenate([x for x, _ in took]), np.concatenate([y for _, y in took])

    def off(self, char: int) -> None:
        heapq.heappop(self.order)
        del self.parts[char]


def least_between(values: np.ndarray, after: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The least of values[after + 1 .. to] for each pair, by a table of the least of powers of two."""
    size = to - after
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(to), dtype=values.dtype)
    table, k = values, 0
    while True:
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.minimum(table[after[own] + 1], table[to[own] - (1 << k) + 1])
        k += 1
        if k > level.max(initial=-1):
            return out
        table = np.minimum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])


class Scan:
    """Puts what a run of ordered suffixes induces into a queue."""

    def __init__(self, text: np.ndarray, small: np.ndarray, wants_small: bool, queue: Queue, cap: int) -> None:
        self.text, self.small, self.wants, self.queue, self.cap = text, small, wants_small, queue, cap
        self.carry = np.zeros(256, dtype=np.uint16) if cap else None  # of each character, the least prefix since the last tuple

    def take(self, position: np.ndarray, prefix: np.ndarray) -> None:
        before = position - 1
        at = np.flatnonzero(before >= 0)
        at = at[self.small[before[at]] == self.wants]
        if len(at):
            found = before[at]
            char = self.text[found]
            order = np.argsort(char, kind="stable")
            at, found, char = at[order], found[order], char[order]
            cuts = np.flatnonzero(char[1:] != char[:-1]) + 1
            heads = np.append([0], cuts)
        if self.cap:
            low = np.minimum.accumulate(prefix)
            own = np.zeros(len(at), dtype=np.uint16)
            after = np.minimum(self.carry, low[-1])
            if len(at):
                inner = np.ones(len(at), dtype=bool)
                inner[heads] = False
                to = np.flatnonzero(inner)
                own[to] = least_between(prefix, at[to - 1], at[to])
                own[heads] = np.minimum(self.carry[char[heads]], low[at[heads]])
                own = np.minimum(own + 1, self.cap).astype(np.uint16)
                tails = np.append(cuts, len(at)) - 1
                rest = np.append(np.minimum.accumulate(prefix[::-1])[::-1], np.uint16(self.cap))
                after[char[tails]] = rest[at[tails] + 1]
            self.carry = after
        else:
            own = np.zeros(len(at), dtype=np.uint16)
        if len(at):
            for a, b in zip(heads.tolist(), [*cuts.tolist(), len(at)], strict=True):
                self.queue.put(int(char[a]), found[a:b], own[a:b])


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is of type S. The text ends as if by a character smaller than all."""
    small = room(len(text), bool)
    after, kind = -1, False
    for stop in range(len(text), 0, -STEP):
        start = max(0, stop - STEP)
        block = text[start:stop].astype(np.int64)
        sign = np.sign(np.append(block[1:], after) - block)
        place = np.where(sign != 0, np.arange(len(block)), len(block))
        place = np.minimum.accumulate(place[::-1])[::-1]
        own = np.append(sign > 0, kind)[place]
        small[start:stop] = own
        after, kind = int(block[0]), bool(own[0])
    return small


def shared_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of pairs of suffixes of an array of bytes, up to cap: eight bytes are compared at once."""
    out = np.zeros(len(a), dtype=np.uint16)
    n = len(text)
    eight = np.ndarray(max(n - 7, 0), dtype="<u8", buffer=text, strides=(1,)) if n > 7 else None
    for k in range(0, len(a), STEP):
        p, q, own = a[k : k + STEP], b[k : k + STEP], np.zeros(len(a[k : k + STEP]), dtype=np.int64)
        most = np.minimum(n - np.maximum(p, q), cap)
        live = np.arange(len(p))
        while len(live):
            x, y = p[live] + own[live], q[live] + own[live]
            whole = np.maximum(x, y) + 8 <= n
            tail, live, x, y = live[~whole], live[whole], x[whole], y[whole]
            for j in tail.tolist():  # the last bytes of the text, one by one
                while own[j] < most[j] and text[p[j] + own[j]] == text[q[j] + own[j]]:
                    own[j] += 1
            if not len(live):
                break
            off = eight[x] ^ eight[y]
            low = off & (~off + np.uint64(1))  # the lowest bit that differs
            own[live] += np.where(off == 0, 8, (np.frexp(low.astype(np.float64))[1] - 1) >> 3)
            live = live[(off == 0) & (own[live] < most[live])]
        out[k : k + STEP] = np.minimum(own, most)
    return out


def induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, seed_prefix: np.ndarray, cap: int, out: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Calls out(position, prefix) with all suffixes in descending order, prefix being that with the one before (0 where cap is 0)."""
    smaller, larger, kept = Queue(), Queue(descending=True), Queue(descending=True)
    scan = Scan(text, small, False, smaller, cap)
    scan.take(np.array([len(text)]), np.zeros(1, dtype=np.uint16))
    chars = text[seeds]
    starts = np.flatnonzero(np.append([True], chars[1:] != chars[:-1])) if len(seeds) else np.zeros(0, dtype=np.int64)
    groups = [(int(chars[a]), a, b) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(seeds)], strict=False)]
    k = 0
    while smaller.first() is not None or k < len(groups):
        char = smaller.first()
        if char is None or k < len(groups) and groups[k][0] < char:
            char = groups[k][0]
        last = None
        if smaller.first() == char:
            while (found := smaller.some(char)) is not None:
                position, prefix = found
                if last is None:
                    prefix = prefix.copy()
                    prefix[0] = 0
                kept.put(char, position, prefix)
                scan.take(position, prefix)
                last = position[-1:]
            smaller.off(char)
        if k < len(groups) and groups[k][0] == char:
            _, a, b = groups[k]
            k += 1
            for at in range(a, b, STEP):
                position, prefix = seeds[at : min(b, at + STEP)], seed_prefix[at : min(b, at + STEP)]
                if at == a:
                    prefix = prefix.copy()
                    prefix[0] = shared_prefix(text, last, position[:1], cap)[0] if cap and last is not None else 0
                scan.take(position, prefix)
    scan = Scan(text, small, True, larger, cap)
    while larger.first() is not None or kept.first() is not None:
        char = max(x for x in (larger.first(), kept.first()) if x is not None)
        last = None
        if larger.first() == char:
            while (found := larger.some(char)) is not None:
                position, prefix = found
                if last is None:
                    prefix = prefix.copy()
                    prefix[0] = 0
                out(position, prefix)
                scan.take(position, prefix)
                last = position[-1:]
            larger.off(char)
        if kept.first() == char:
            parts = kept.parts[char]
            join = None
            for part in reversed(parts):
                up, prefix = kept._load(part)
                position = up[::-1]
                if join is None:
                    join = shared_prefix(text, last, position[:1], cap)[0] if cap and last is not None else 0
                prefix, join = np.append(np.uint16(join), prefix[:0:-1]).astype(np.uint16), prefix[0]
                out(position, prefix)
                scan.take(position, prefix)
            kept.off(char)


def _doubled(names: np.ndarray, cap: int) -> np.ndarray:
    """The order of the suffixes of a string in memory, by doubling; exact to cap names where cap isn't 0.

    A suffix's rank is where its group of equals begins. Each round sorts the groups that have several by the rank `step` further on.
    """
    n = len(names)
    order = np.argsort(names, kind="stable")
    key = names[order]
    step = 1
    place, suffix = np.arange(n), order
    rank = np.empty(n, dtype=np.int64)
    while True:
        new = np.append([True], key[1:] != key[:-1])
        rank[suffix] = place[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        several = ~(new & np.append(new[1:], True))
        place, suffix = place[several], suffix[several]
        if not len(suffix) or (cap and step >= cap) or step >= n:
            return order
        after = suffix + step
        far = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[suffix] * (n + 2) + far
        by = np.argsort(key)
        key, suffix = key[by], suffix[by]
        order[place] = suffix
        step *= 2


def _where(flags: np.ndarray) -> np.ndarray:
    """Places of what is true, found a step at a time."""
    out = Growing(np.int64)
    for k in range(0, len(flags), STEP):
        out.add(np.flatnonzero(flags[k : k + STEP]) + k)
    return out.whole()


def _by_symbol(text: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """The places in order of their symbols, equal ones as they come."""
    if text.dtype != np.uint8:  # names, of which there can be as many as places
        return stars[np.argsort(text[stars], kind="stable")]
    out, count = room(len(stars), np.int64), np.zeros(256, dtype=np.int64)
    for k in range(0, len(stars), STEP):
        count += np.bincount(text[stars[k : k + STEP]], minlength=256)
    at = np.cumsum(count) - count
    for k in range(0, len(stars), STEP):
        own = stars[k : k + STEP]
        symbol = text[own]
        order = np.argsort(symbol, kind="stable")
        here = np.bincount(symbol, minlength=256)
        out[np.arange(len(own)) + np.repeat(at - (np.cumsum(here) - here), here)] = own[order]
        at += here
    return out


def star_order(text: np.ndarray, small: np.ndarray, cap: int) -> np.ndarray:
    """The S* suffixes in order."""
    is_star = room(len(text), bool)
    for k in range(1, len(text), STEP):
        is_star[k : k + STEP] = small[k : k + STEP] & ~small[k - 1 : min(k + STEP, len(text)) - 1]
    stars = _where(is_star)
    if len(stars) < 2:
        return stars
    first = _by_symbol(text, stars)
    found = Growing(np.int64)
    induce(text, small, first, np.zeros(len(first), dtype=np.uint16), 0, lambda position, _: found.add(position[is_star[position]]))
    ordered = found.whole()[::-1]  # by their substrings up to the next one
    # a substring's name is the number of different ones before it; neighbours are held against each other symbol by symbol
    names = room(len(stars), np.int64)
    last = -1
    before = (-1, 0)
    for k in range(0, len(ordered), STEP):
        own = np.asarray(ordered[k : k + STEP])
        place = np.searchsorted(stars, own)
        size = np.where(place + 1 < len(stars), stars[np.minimum(place + 1, len(stars) - 1)] + 1 - own, 0)  # the last one is like no other
        a, of_a = np.append(before[0], own[:-1]), np.append(before[1], size[:-1])
        new = (of_a != size) | (size == 0)
        new |= ~_same(text, a, own, np.where(new, 0, size))
        name = last + np.cumsum(new)
        names[place] = name
        last, before = int(name[-1]), (int(own[-1]), int(size[-1]))
    if last == len(stars) - 1:
        return ordered
    order = _doubled(names, cap) if len(names) <= IN_MEMORY else suffix_order(names)
    out = room(len(stars), np.int64)
    for k in range(0, len(out), STEP):
        out[k : k + STEP] = stars[order[k : k + STEP]]
    return out


def _same(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether text[a : a + size] and text[b : b + size] are equal, for each pair."""
    out = np.ones(len(a), dtype=bool)
    live, k = np.flatnonzero(size > 0), 0
    while len(live):
        equal = text[a[live] + k] == text[b[live] + k]
        out[live[~equal]] = False
        k += 1
        live = live[equal]
        live = live[size[live] > k]
    return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """All suffixes of a string of numbers from 0 on, in order: the recursion's step."""
    small = types(text)
    seeds = star_order(text, small, 0)
    found = Growing(np.int64)
    induce(text, small, seeds, np.zeros(len(seeds), dtype=np.uint16), 0, lambda position, _: found.add(position))
    return found.whole()[::-1]


def each_suffix(text: np.ndarray, cap: int, out: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Calls out(position, prefix) with all suffixes of an array of bytes, in runs, in descending order.

    Suffixes that agree in their first `cap` bytes may come in any order; prefixes are counted up to cap.
    """
    if len(text):
        small = types(text)
        seeds = star_order(text, small, cap)
        prefix = room(len(seeds), np.uint16)
        for k in range(1, len(seeds), STEP):
            a, b = seeds[k - 1 : k - 1 + STEP], seeds[k : k + STEP]
            prefix[k : k + STEP] = shared_prefix(text, a[: len(b)], b, cap)
        induce(text, small, seeds, prefix, cap, out)


def repeated_starts(text: np.ndarray, size: int) -> np.ndarray:
    """True where a string of `size` bytes starts that starts elsewhere, too."""
    twice = room(len(text), bool)
    last = np.zeros(0, dtype=np.int64)

    def mark(position: np.ndarray, prefix: np.ndarray) -> None:
        nonlocal last
        at = np.flatnonzero(prefix >= size)  # the very first prefix is 0
        twice[position[at]] = True
        twice[np.append(last, position)[at + len(last) - 1]] = True
        last = position[-1:]

    each_suffix(text, size, mark)
    return twice
