"""Vector code compression: product codes of four parts, whose nearest codebook entries are found by equal-average search.

Entries are sorted by the sum of their components. A part's search begins where its own sum falls among theirs and goes outward on both
sides. No entry whose sum is g away can be nearer than g^2 / dimension, so a side ends where that strictly exceeds the best distance;
equal ones are still looked at, so that ties go to the lower index. Parts are taken in order of their sums, some entries at a time: of
neighbouring parts those that still search look at the same entries in one product of matrices.

Codebooks are four tables of at most 256 entries, whatever the input: they go to the driver after each round and to the tasks with the
next. Sums and counts are added up by task before they are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, matched, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Scaled components beyond this count as this, so that squared distances and their sums stay whole numbers of 64 bits.
LIMIT = 1 << 25
#: Below this, squares and products of parts are exact as doubles.
EXACT = 1 << 18
#: Entries that a step of the search looks at; parts that are searched together.
STEP, BLOCK = 8, 1024


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Bounds of each list (equal ones for a null), and all components."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.array(column.value_lengths().fill_null(0))
    return np.concatenate([[0], np.cumsum(size)]), column.flatten()


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose vector has only finite components, as whole numbers."""
    for batch in batches:
        vectors = batch.column("embedding")
        bounds, flat = _lists(vectors)
        value = np.array(flat.cast(pa.float64()).fill_null(np.nan), dtype=np.float64)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(value))])
        keep = np.array(vectors.is_valid()) & (bad[bounds[1:]] == bad[bounds[:-1]])
        of_kept = np.repeat(keep, np.diff(bounds))
        whole = np.clip(np.floor(SCALE * value[of_kept].clip(-LIMIT, LIMIT)), -LIMIT, LIMIT).astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(np.diff(bounds)[keep])]).astype(np.int32)
        chosen = pa.array(keep)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(chosen), batch.column("label").filter(chosen), pa.ListArray.from_arrays(pa.array(ends), pa.array(whole))], ["vec_id", "label", "v"])


def scaled_vectors(df: DataFrame) -> DataFrame:
    """vec_id, label and v, the components as floor(1024 x), of rows whose vector is there and has only finite components."""
    kinds = dict(df.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<int>"
    return df.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_scaled, schema)


class Book:
    """The codebook of one part, sorted by sum for the search."""

    def __init__(self, entries: np.ndarray) -> None:
        total = entries.sum(axis=1)
        self.order = np.lexsort((np.arange(len(entries)), total))
        self.entries, self.sums, self.width = entries[self.order], total[self.order], entries.shape[1]
        self.largest = int(np.abs(entries).max(initial=0))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each part's nearest entry, ties to the lower one, and the squared distance."""
        kind = np.float64 if max(self.largest, int(np.abs(parts).max(initial=0))) < EXACT and self.width <= 1 << 12 else np.int64
        x, y = parts.astype(kind), self.entries.astype(kind)
        squares = (y * y).sum(axis=1)
        sums = parts.sum(axis=1)
        code, best = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        in_order = np.argsort(sums, kind="stable")
        for a in range(0, len(parts), BLOCK):
            rows = in_order[a : a + BLOCK]
            code[rows], best[rows] = self._outward(x[rows], sums[rows], y, squares)
        return code, best

    def _outward(self, x: np.ndarray, sums: np.ndarray, y: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = (x * x).sum(axis=1)
        best = np.full(len(x), np.iinfo(np.int64).max)
        code = np.full(len(x), len(y))

        def look(rows: np.ndarray, a: int, b: int) -> None:
            gap = own[rows, None] + squares[a:b] - 2 * (x[rows] @ y[a:b].T)
            least = gap.min(axis=1)
            first = np.where(gap == least[:, None], self.order[a:b], len(y)).min(axis=1)
            least = least.astype(np.int64)
            better = (least < best[rows]) | ((least == best[rows]) & (first < code[rows]))
            best[rows[better]], code[rows[better]] = least[better], first[better]

        def on(rows: np.ndarray, entry: int) -> np.ndarray:
            """Parts whose best distance doesn't rule out the entry and those behind it. In halves, as a square of sums could be too large."""
            gap = np.abs(sums[rows] - self.sums[entry]).astype(object) if self.largest >= EXACT else np.abs(sums[rows] - self.sums[entry])
            limit = best[rows].astype(object) if self.largest >= EXACT else best[rows]
            return rows[(gap * gap <= limit * self.width).astype(bool)]

        # the entries about the middle part come first, for all parts of the block; then each side goes on for itself
        middle = int(np.searchsorted(self.sums, sums[len(sums) // 2]))
        down = max(0, min(middle, len(y)) - STEP // 2)
        up = min(len(y), down + STEP)
        every = np.arange(len(x))
        look(every, down, up)
        above = below = every
        while len(above) or len(below):
            # a part with a sum beyond the next entries has not come to its own place yet and goes on in any case
            if len(above):
                above = above if up < len(y) else above[:0]
                if len(above):
                    above = np.union1d(on(above, up), above[sums[above] > self.sums[up]])
                    look(above, up, min(len(y), up + STEP)) if len(above) else None
                    up = min(len(y), up + STEP)
            if len(below):
                below = below if down > 0 else below[:0]
                if len(below):
                    below = np.union1d(on(below, down - 1), below[sums[below] < self.sums[down - 1]])
                    look(below, max(0, down - STEP), down) if len(below) else None
                    down = max(0, down - STEP)
        return code, best


def _parts(vectors: pa.Array, width: int) -> np.ndarray:
    """An array (vector, part, component) of vectors that zeros fill up to four parts of `width`."""
    bounds, flat = _lists(vectors)
    size = np.diff(bounds)
    out = np.zeros((len(size), PARTS * width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - bounds[:-1][row]] = np.array(flat)
    return out.reshape(len(size), PARTS, width)


def _sums_of(books: list[np.ndarray], width: int):
    """For mapInArrow: one row for each part and entry, with the sums and the count of what the task assigns to it."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Book(b) for b in books]
        n = len(books[0])
        total, count = np.zeros((PARTS, n, width), np.int64), np.zeros((PARTS, n), np.int64)
        for batch in batches:
            x = _parts(batch.column("v"), width)
            for p in range(PARTS):
                code, _ = search[p].nearest(x[:, p])
                by = np.argsort(code, kind="stable")
                used, first = np.unique(code[by], return_index=True)
                if len(used):
                    total[p, used] += np.add.reduceat(x[by, p], first, axis=0)
                    count[p, used] += np.diff(np.append(first, len(by)))
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), *[pa.array(total[part, entry, j]) for j in range(width)]], ["part", "entry", "n", *[f"s{j}" for j in range(width)]])

    return f


def _codes_of(books: list[np.ndarray], width: int):
    """For mapInArrow: vec_id, label, code and error of each vector."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Book(b) for b in books]
        for batch in batches:
            x = _parts(batch.column("v"), width)
            found = [search[p].nearest(x[:, p]) for p in range(PARTS)]
            code = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
            text = [row.tobytes().hex() for row in code]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(sum(d for _, d in found), pa.int64())], ["vec_id", "label", "code", "error"])

    return f


def fit_books(kept: DataFrame, width: int) -> list[np.ndarray]:
    """The four codebooks, each (entries, width). They start as the parts of the smallest vec_ids (of equal ids that of the smallest vector,
    null ids last) and are moved to the floor of the mean of what is nearest to them, four times."""
    start = kept.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    parts = _parts(pa.array([r["v"] for r in start], pa.list_(pa.int32())), width)
    books = [parts[:, p].copy() for p in range(PARTS)]
    for _ in range(ROUNDS):
        sums = kept.select("v").mapInArrow(_sums_of(books, width), "part long, entry long, n long, " + ", ".join(f"s{j} long" for j in range(width)))
        # at most PARTS * ENTRIES rows
        for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)]).collect():
            books[r["part"]][r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
    return books


def compress_vectors(df: DataFrame) -> DataFrame:
    """vec_id, label, code (two hex digits for each of four parts), error, label_error, codebooks_sha256 of each row with a usable vector.

    Rows whose vector is null or has a null or non-finite component go; an empty vector is a usable one. Rows of equal vec_id are coded
    each for itself, null ids too. Vectors of other lengths count as filled up by zeros to the longest, and that to a multiple of four.
    Components beyond 32,768 count as that. With fewer than 256 usable rows codebooks have as many entries as there are rows; an empty
    table gives an empty result. Null labels are one label. Other columns are not looked at.
    """
    with Scratch(df.sparkSession) as scratch:
        kept = scratch.written(scaled_vectors(df))
        longest = kept.agg(F.max(F.size("v"))).first()[0]
        width = max(1, -(-(longest or 0) // PARTS))
        books = fit_books(kept, width)
        digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
        kinds = dict(kept.dtypes)
        coded = kept.mapInArrow(_codes_of(books, width), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
        coded = scratch.written(coded.withColumn("_l", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))))
        sums = coded.groupBy("_l").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("uses"))
        return written(matched(coded, sums, "_l").select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))
