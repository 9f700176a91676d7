"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise sum is half of sum_f (sum_i v_if x_i)^2 -
sum_i v_if^2 x_i^2, so scoring takes time in proportion to the features that a document has.

The model is fitted on a bounded sample of labelled rows, SAMPLE of them at most, those of the smallest hashes of their ids; the model is a
few hundred kilobytes and goes to all tasks. Labels, language, source and id are not among the inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_words, sliced

#: Slots of hashed words, cells of each statistic, rank of the interactions.
SLOTS, CELLS, RANK = 1 << 14, 24, 8
#: Labelled rows that the model is fitted on at most; passes over them, and steps, at least; rows in a step; step size; shrinkage.
SAMPLE, PASSES, STEPS, ROWS, STEP, SHRINK = 8000, 6, 600, 64, 0.05, 1e-5
#: Rows whose crc32(doc_id) leaves this remainder are held out.
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

KINDS = {"newline": b"\n", "space": b" \t\r\x0b\x0c", "digit": b"0123456789", "upper": bytes(range(65, 91)), "symbol": b"#*$%&|<>@^~_=+{}[]\\", "stop": b".,;:!?\"'()-/", "wide": bytes(range(128, 256))}
STATISTICS = ["words", "letters", "distinct", "common", "dup_lines", "line_words", *KINDS, "n_chars"]
FEATURES = SLOTS + CELLS * len(STATISTICS)


class Rows(NamedTuple):
    """Sparse rows: row k has index[begin[k] : begin[k + 1]] with the values there."""

    begin: np.ndarray
    index: np.ndarray
    value: np.ndarray


def features(texts: list[str | None], n_chars: list[int | None]) -> Rows:
    """The features of some documents. Words weigh log(1 + count), scaled to length 1; each statistic marks one of CELLS cells."""
    n = len(texts)
    words = list(batch_words(texts))
    many = np.array([len(w) for w in words], dtype=np.int64)
    slot = (np.concatenate(words) & np.uint64(SLOTS - 1)).astype(np.int64) if n else np.zeros(0, np.int64)
    key, count = np.unique(np.repeat(np.arange(n), many) * SLOTS + slot, return_counts=True)
    own = key // SLOTS
    weight = np.log1p(count)
    length = np.sqrt(np.bincount(own, weight * weight, minlength=n))
    distinct = np.bincount(own, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, own, count)
    raw = [(t or "").encode() for t in texts]
    sizes = np.array([len(r) for r in raw])
    kind = np.zeros(256, dtype=np.int64)
    for k, chars in enumerate(KINDS.values()):
        kind[list(chars)] = k + 1
    shares = np.zeros((len(KINDS), n))
    for j, r in enumerate(raw):
        shares[:, j] = np.bincount(kind[np.frombuffer(r, np.uint8)], minlength=len(KINDS) + 1)[1:]
    lines = [[x for x in (t or "").split("\n") if x.strip()] for t in texts]
    n_lines = np.array([len(x) for x in lines])
    kept_lines = np.array([len(set(x)) for x in lines])
    some, full = np.maximum(many, 1), np.maximum(sizes, 1)
    log = lambda x: np.log2(np.maximum(x, 1e-9))
    cells = [
        log(many + 1) * 1.5,
        (sizes - shares[0] - shares[1]) / some * 1.5,
        distinct / some * 20,
        log(1 + 256 * top / some) * 2.5,
        (n_lines - kept_lines) / np.maximum(n_lines, 1) * 20,
        log(1 + many / np.maximum(n_lines, 1)) * 2,
        *[np.where(x > 0, 1 + log(1 + 4096 * x / full) * 1.8, 0) for x in shares],
        log(np.array([max(0, x or 0) for x in n_chars]) + 1) * 1.2,
    ]
    cell = np.stack([np.clip(c, 0, CELLS - 1).astype(np.int64) + SLOTS + CELLS * k for k, c in enumerate(cells)], axis=1) if n else np.zeros((0, len(STATISTICS)), np.int64)
    rows = np.concatenate([own, np.repeat(np.arange(n), len(STATISTICS))])
    order = np.argsort(rows, kind="stable")
    index = np.concatenate([key % SLOTS, cell.reshape(-1)])[order]
    value = np.concatenate([weight / length[own], np.full(cell.size, 1 / np.sqrt(len(STATISTICS)))])[order]
    return Rows(np.append([0], np.cumsum(np.bincount(rows, minlength=n))), index.astype(np.int32), value.astype(np.float32))


class Model(NamedTuple):
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def odds(self, x: Rows) -> np.ndarray:
        """Log odds of label 1, by the sum-of-squares identity."""
        if len(x.begin) < 2:
            return np.zeros(0)
        # each row has its statistics, so none is empty
        vx = self.factors[x.index] * x.value[:, None]
        sums = np.add.reduceat(vx, x.begin[:-1], axis=0, dtype=np.float64)
        squares = np.add.reduceat((vx * vx).sum(axis=1), x.begin[:-1], dtype=np.float64)
        return self.bias + np.add.reduceat(self.linear[x.index] * x.value, x.begin[:-1], dtype=np.float64) + 0.5 * ((sums * sums).sum(axis=1) - squares)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: Rows, labels: np.ndarray, seed: int = 5) -> Model:
    """Logistic loss, adaptive steps over small batches in a seeded order. Without labels, or with one kind only, a constant model."""
    rate = (labels.sum() + 1) / (len(labels) + 2)
    linear, bias = np.zeros(FEATURES, dtype=np.float32), float(np.log(rate / (1 - rate)))
    draw = np.random.default_rng(seed)
    factors = draw.normal(0, 0.05, (FEATURES, RANK)).astype(np.float32)
    if len(np.unique(labels)) < 2:
        return Model(bias, linear, np.zeros_like(factors))
    past_linear, past_factors, past_bias = np.full(FEATURES, 1e-6, np.float32), np.full((FEATURES, RANK), 1e-6, np.float32), 1e-6
    for _ in range(max(PASSES, -(-STEPS * ROWS // len(labels)))):
        order = draw.permutation(len(labels))
        for at in range(0, len(order), ROWS):
            own = order[at : at + ROWS]
            sizes = x.begin[own + 1] - x.begin[own]
            row = np.repeat(np.arange(len(own)), sizes)
            place = np.arange(len(row)) + np.repeat(x.begin[own] - np.append([0], np.cumsum(sizes)[:-1]), sizes)
            part = Rows(np.append([0], np.cumsum(sizes)), x.index[place], x.value[place])
            off = ((sigmoid(Model(bias, linear, factors).odds(part)) - labels[own]) / len(own)).astype(np.float32)
            vx = factors[part.index] * part.value[:, None]
            sums = np.add.reduceat(vx, part.begin[:-1], axis=0)
            pull = (off[row] * part.value)[:, None]
            which, back = np.unique(part.index, return_inverse=True)
            by = np.argsort(back, kind="stable")
            heads = np.flatnonzero(np.append([True], np.diff(back[by]) > 0))
            add = lambda g: np.add.reduceat(g[by], heads, axis=0)  # noqa: B023, E731
            slope = add(pull[:, 0]) + SHRINK * linear[which]
            past_linear[which] += slope * slope
            linear[which] -= STEP * slope / np.sqrt(past_linear[which])
            slope = add(pull * (sums[row] - vx)) + SHRINK * factors[which]
            past_factors[which] += slope * slope
            factors[which] -= STEP * slope / np.sqrt(past_factors[which])
            past_bias += float(off.sum()) ** 2
            bias -= STEP * float(off.sum()) / past_bias**0.5
    return Model(bias, linear, factors)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text", 2 << 20):
        x = features(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())
        cut = lambda a, k: a[x.begin[k] : x.begin[k + 1]].tobytes()  # noqa: B023, E731
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([cut(x.index, k) for k in range(n)], pa.binary()), pa.array([cut(x.value, k) for k in range(n)], pa.binary())], ["doc_id", "quality", "index", "value"])


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on SAMPLE labelled rows outside the held-out fold at most. Null labels are left out. Of several texts of one doc_id a label is of the
    one with the least hash, so no more rows than labels come to the driver."""
    sample = labels.filter(~held_out() & F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE)
    # the sample's size is bounded, so that it can go to where the texts are
    found = docs.select("doc_id", F.struct(F.xxhash64("text").alias("h"), "text", "n_chars").alias("row")).join(F.broadcast(sample), "doc_id")
    one = found.groupBy("doc_id", "quality").agg(F.min("row").alias("row")).select("doc_id", "row.text", "row.n_chars", "quality")
    rows = one.mapInArrow(_featured, "doc_id long, quality int, index binary, value binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], r["index"]))
    index = [np.frombuffer(r["index"], np.int32) for r in rows]
    value = [np.frombuffer(r["value"], np.float32) for r in rows]
    none = np.zeros(0, np.int32)
    x = Rows(np.append([0], np.cumsum([len(i) for i in index])).astype(np.int64), np.concatenate([none, *index]), np.concatenate([none.astype(np.float32), *value]))
    return fit(x, np.array([r["quality"] for r in rows], dtype=np.float32))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted, one row for each row of docs (doc_id, text, n_chars; other columns are not read).

    Null and empty texts are scored by their statistics. Without labels every score is 0.5. An empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(tuple(train(docs, labels)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*model.value)
        for batch in sliced(batches, "text", 2 << 20):
            x = features(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(sigmoid(own.odds(x)), 9))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text", "n_chars").mapInArrow(each, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
