"""Recursions along sessions, as prefix scans of affine maps.

A step y -> a y + b of a recursion is a map, and maps compose: that of many rows is again an a and a b. A batch of rows is cut into blocks;
the maps of each block's rows are composed up to each row, all blocks at once, and the last y is carried from block to block, and from batch
to batch. A session begins with a = 0, a missing value is the map that changes nothing, and a gap is one with another a. So sessions may
have any length, and no power of a decay ever has to be a number.

All recursions of a call share one pass over the rows, which come in order from the windows before, without another Exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .windows import Session

#: Rows of a block.
BLOCK = 64
PLACE = "_place"


def affine(a: np.ndarray, b: np.ndarray, y: float) -> np.ndarray:
    """All y of y[i] = a[i] y[i-1] + b[i], from the y before the first row."""
    n = len(a)
    pad = -n % BLOCK
    many = np.concatenate([a, np.ones(pad)]).reshape(-1, BLOCK).T.copy()
    more = np.concatenate([b, np.zeros(pad)]).reshape(-1, BLOCK).T.copy()
    for t in range(1, BLOCK):
        more[t] += many[t] * more[t - 1]
        many[t] *= many[t - 1]
    begins = []
    for scale, shift in zip(many[-1].tolist(), more[-1].tolist()):
        begins.append(y)
        y = scale * y + shift
    return (many * np.array(begins) + more).T.reshape(-1)[:n]


class Scan:
    """The recursions of one partition's sessions. Each call of a method is one recursion; calls come in the same order for each batch."""

    def __init__(self) -> None:
        self.carried: list = []
        self.call = 0

    def begin(self, place: np.ndarray) -> None:
        """place: each row's number in its session."""
        self.place, self.call = place, 0
        self.first = place == 0
        row = np.arange(len(place))
        #: The row in which each row's session begins, -1 if that was in a batch before.
        self.start = np.maximum.accumulate(np.where(self.first, row, -1))

    def _carry(self, default):
        if self.call == len(self.carried):
            self.carried.append(default)
        self.call += 1
        return self.call - 1

    def _run(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = self._carry(0.0)
        y = affine(np.where(self.first, 0.0, a), b, self.carried[k])
        self.carried[k] = float(y[-1])
        return y

    def total(self, x: np.ndarray) -> np.ndarray:
        """The sum of a session's values so far; missing ones are none."""
        return self._run(np.ones(len(x)), np.nan_to_num(x))

    def count(self, x: np.ndarray) -> np.ndarray:
        return self._run(np.ones(len(x)), (~np.isnan(x)).astype(np.float64))

    def previous(self, x: np.ndarray) -> np.ndarray:
        """The value of the row before, missing in a session's first row."""
        k = self._carry(np.nan)
        out = np.concatenate([[self.carried[k]], x[:-1]])
        self.carried[k] = float(x[-1])
        return np.where(self.first, np.nan, out)

    def _last(self, there: np.ndarray) -> np.ndarray:
        """The number, in its session, of the last row before each row that is there; -1 if none is."""
        k = self._carry(-1)
        row = np.arange(len(there))
        last = np.maximum.accumulate(np.where(there, row, -1))
        before = np.concatenate([[-1], last[:-1]])
        own = (before >= 0) & (before >= self.start)
        out = np.where(own, self.place[np.maximum(before, 0)], np.where(self.start < 0, self.carried[k], -1))
        self.carried[k] = int(self.place[-1]) if there[-1] else int(out[-1])
        return np.where(self.first, -1, out)

    def smooth(self, x: np.ndarray, alpha: float, start: int = 0) -> np.ndarray:
        """y[i] = alpha x[i] + (1 - alpha) y[i-1], from the first value in row `start` of a session or later, where y = x.

        Missing values repeat the last y. After a gap the last y has the weight (1 - alpha)^rows against alpha, both over their sum, so
        that its age counts.
        """
        there = ~np.isnan(x) & (self.place >= start)
        last = self._last(there)
        old = (1 - alpha) ** (self.place - last)
        known = there & (last >= 0)
        a = np.where(known, old / (old + alpha), np.where(there, 0.0, 1.0))
        b = np.where(known, alpha * np.nan_to_num(x) / (old + alpha), np.where(there, x, 0.0))
        y = self._run(a, b)
        return np.where(there | (last >= 0), y, np.nan)

    def adjusted(self, x: np.ndarray, span: int) -> np.ndarray:
        """The mean of the rows so far with weights (1 - 2 / (span + 1))^age; rows without a value have none."""
        decay = np.full(len(x), 1 - 2 / (span + 1))
        up, down = self._run(decay, np.nan_to_num(x)), self._run(decay, (~np.isnan(x)).astype(np.float64))
        return np.divide(up, down, out=np.full(len(x), np.nan), where=down > 0)


Compute = Callable[[dict[str, np.ndarray], Scan], dict[str, np.ndarray]]


def scanned(df: DataFrame, session: Session, sources: list[str], names: list[str], compute: Compute) -> DataFrame:
    """df with the columns `names`, doubles, as `compute` makes them of the sources along each session; what it makes as NaN is NULL.

    compute gets a batch's columns, with NaN for NULL, and "place", the row's number in its session.
    """
    plain = [c for c in df.columns if c not in names]
    rows = df.select(*plain).withColumn(PLACE, session.ordinal()).sortWithinPartitions(*session.by, "ts")  # the windows' own order: nothing is sorted
    schema = T.StructType([*[rows.schema[c] for c in plain], *[T.StructField(c, T.DoubleType()) for c in names]])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan()
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.array(batch.column(PLACE)).astype(np.int64)
            scan.begin(place)
            inputs = {c: np.array(batch.column(c).cast(pa.float64()).fill_null(np.nan)) for c in sources}
            with np.errstate(all="ignore"):
                found = compute({**inputs, "place": place}, scan)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in plain], *[pa.array(found[c], pa.float64(), mask=~np.isfinite(found[c])) for c in names]], [*plain, *names])

    return rows.mapInArrow(f, schema)


def smoothed(df: DataFrame, session: Session, name: str, c: str, alpha: float, start: int = 0) -> DataFrame:
    """Adds Scan.smooth of a column."""
    return scanned(df, session, [c], [name], lambda x, scan: {name: scan.smooth(x[c], alpha, start)})


def ewm_adjusted(df: DataFrame, session: Session, name: str, c: str, span: int) -> DataFrame:
    """Adds Scan.adjusted of a column."""
    return scanned(df, session, [c], [name], lambda x, scan: {name: scan.adjusted(x[c], span)})
