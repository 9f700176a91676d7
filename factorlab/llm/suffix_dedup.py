"""Suffix-array dedup: removes every byte that a 400-byte string covers which also starts anywhere else.

A window is a string of SIZE bytes of one document. Its key is the least hash of its GRAM-byte strings, so equal windows have equal
keys; successive windows of one key are a segment. A window belongs to one segment only, and all that can equal it are in segments
of its key. So:

1. one pass over the texts gives a narrow row for each segment; keys that occur once go at once, unless their segment can repeat itself;
2. segments that are equal byte by byte repeat in full; of each such group one goes on, as do all others whose key other segments have
   or that can repeat themselves;
3. the bytes of those are fetched and dealt out by key, and each shard's suffixes are put in order by external induced sorting, with
   common prefixes: neighbours that share SIZE bytes are windows that repeat;
4. keys whose different segments are more than KEY_BYTES together would be one task's, and in runs of a short period, which are segments
   of more than KEY_WINDOWS windows, a scan goes on one period at a time; theirs are told apart window by window, by 128-bit hashes that
   are counted before they are shuffled;
5. what repeats is joined back to its documents.

Segments are taken for equal if the 64-bit hashes of their keys and of their bytes agree, which are of different kinds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql import types as T

from .common import BYTE_VALUE, PIECE, U64, Scratch, _tables, mix, sliced, written
from .induced_sorting import Growing, repeated_starts

SIZE, GRAM = 400, 200
#: Bytes of segments that a shard should have.
SHARD_BYTES = 8 << 20
#: Bytes of different segments that a key has at most in a shard, and windows that one of its segments has at most.
KEY_BYTES, KEY_WINDOWS = 8 << 20, 4096
#: Between segments: a byte that no UTF-8 text has.
BETWEEN = b"\xff"


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` successive values."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


PLACE = U64(PIECE - 1)


def segments(data: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, hash, first and last window (exclusive) of the segments of an array of `size` to PIECE bytes, and whether one can repeat itself.

    Hashes are compared by their upper bits, with the place in the lower ones, so that of equal ones the leftmost is found. Two equal
    windows of one segment have their least gram in different places; a segment with a single place has no equal windows.
    """
    sums = _sums(data)
    n = len(data) - gram + 1
    grams = mix((sums[gram:] - sums[:n]) * _tables(len(data) + 1)[1][:n])
    place = (sliding_least((grams & ~PLACE) | np.arange(n, dtype=U64), size - gram + 1) & PLACE).astype(np.int64)
    key = grams[place]
    start = np.flatnonzero(np.append([True], key[1:] != key[:-1]))
    stop = np.append(start[1:], len(key))
    moves = np.append([0], np.cumsum(place[1:] != place[:-1]))
    return key[start], _hash(data, start, stop + size - 1), start, stop, moves[stop - 1] > moves[start]


def _sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(BYTE_VALUE[data] * _tables(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def _hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from start to end."""
    raw = memoryview(data)
    return np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)], dtype=U64)


def _groups(texts: list[str | None], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, begins, ends, documents) in pieces: several documents, or a part of a long one. Windows are within begin and end.

    Parts of a document overlap by size - 1 bytes, so each window is in one part.
    """
    parts: list[tuple[bytes, int, int]] = []
    total = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        begins = np.cumsum([0, *(len(x) for x, _, _ in parts)])
        return np.frombuffer(b"".join(x for x, _, _ in parts), dtype=np.uint8), begins, np.array([k for _, k, _ in parts]), np.array([at for _, _, at in parts])

    for k, text in enumerate(texts):
        raw = (text or "").encode()
        for at in range(0, len(raw) - size + 1, PIECE - size + 1):
            part = raw[at : at + PIECE]
            if parts and total + len(part) > PIECE:
                yield flush()
                parts, total = [], 0
            parts.append((part, k, at))
            total += len(part)
    if parts:
        yield flush()


SEGMENTS = "doc_id long, h long, key long, seg long, a long, n int, own boolean"


def _segments(size: int, gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text"):
        doc_ids, hashes = batch.column("doc_id"), batch.column("h")
        for data, begins, docs, offsets in _groups(batch.column("text").to_pylist(), size):
            key, seg, start, stop, own = segments(data, size, gram)
            # windows that reach over the end of a document aren't windows: segments with such are cut
            doc = np.searchsorted(begins, start, side="right") - 1
            if (stop > begins[doc + 1] - size + 1).any():
                times = np.searchsorted(begins, stop - 1, side="right") - doc
                index = np.repeat(np.arange(len(key)), times)
                doc = doc[index] + (np.arange(len(index)) - np.repeat(np.cumsum(times) - times, times))
                start, stop = np.maximum(start[index], begins[doc]), np.minimum(stop[index], begins[doc + 1] - size + 1)
                keep = start < stop
                index, doc, start, stop = index[keep], doc[keep], start[keep], stop[keep]
                key, own, seg = key[index], own[index], _hash(data, start, stop + size - 1)
            rows = pa.array(docs[doc])
            yield pa.RecordBatch.from_arrays(
                [doc_ids.take(rows), hashes.take(rows), pa.array(key.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(start - begins[doc] + offsets[doc]), pa.array((stop - start).astype(np.int32)), pa.array(own)],
                ["doc_id", "h", "key", "seg", "a", "n", "own"],
            )


def _fetch(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of documents."""
    for batch in sliced(batches, "text", 2 << 20):
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for doc_id, h, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "text", "wanted")), strict=True):
            raw = text.encode()
            for x in wanted:
                for column, value in zip(out, (doc_id, h, x["key"], x["hot"], x["a"], raw[x["a"] : x["a"] + x["n"] + size - 1]), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["doc_id", "h", "key", "hot", "a", "bytes"])


def _windows(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of the given segments: (doc_id, h, a, and its hash in two halves)."""
    for batch in batches:
        for doc_id, h, a, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "a", "bytes")), strict=True):
            windows = len(raw) - size + 1
            for start in range(0, windows, 1 << 16):
                n = min(windows - start, 1 << 16)
                halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[k : k + size]) for k in range(start, start + n)), dtype=np.int64).reshape(n, 2)
                first = pa.array(np.arange(a + start, a + start + n))
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * n, pa.int64()), pa.array([h] * n, pa.int64()), first, pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc_id", "h", "a", "w", "v"])


def _sort(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: (doc_id, h, first, last byte exclusive) of what its repeated windows cover. Its text is a file where it is large."""
    ids, hashes, places, sizes, text = [], [], [], [], Growing(np.uint8)
    for batch in batches:
        ids.append(batch.column("doc_id"))  # can have nulls
        for column, name in ((hashes, "h"), (places, "a")):
            column.append(batch.column(name).to_numpy())
        for raw in batch.column("bytes").to_pylist():
            sizes.append(len(raw) + 1)
            text.add(np.frombuffer(raw + BETWEEN, dtype=np.uint8))
    if not sizes:
        return
    begins = np.cumsum([0, *sizes])
    text = text.whole()
    twice = repeated_starts(text, size)
    at, own_ids, own_hashes = np.concatenate(places), pa.concat_arrays(ids), np.concatenate(hashes)
    for k in range(0, len(sizes), 1 << 14):  # segments, a stretch at a time
        stop = min(k + (1 << 14), len(sizes))
        part = twice[begins[k] : begins[stop]]
        inside = np.zeros(len(part) + 1, dtype=np.int8)  # only strings that end within their segment count
        inside[begins[k:stop] - begins[k]], inside[begins[k + 1 : stop + 1] - size - begins[k]] = 1, -1
        edge = np.diff((part & (np.cumsum(inside[:-1], dtype=np.int8) > 0)).astype(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edge == 1) + begins[k], np.flatnonzero(edge == -1) + begins[k]
        own = np.searchsorted(begins, first, side="right") - 1
        start = at[own] - begins[own]
        yield pa.RecordBatch.from_arrays([own_ids.take(pa.array(own)), pa.array(own_hashes[own]), pa.array(first + start), pa.array(last + start + size - 1)], ["doc_id", "h", "a", "b"])


SPANS = "doc_id long, h long, a long, b long"


def repeats(texts: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(doc_id, h, a, b): the bytes from a to b that repeated windows cover, possibly overlapping; texts has doc_id, h, text."""
    spark = texts.sparkSession
    with Scratch(spark) as scratch:
        all_segments = scratch.written(texts.filter(F.octet_length("text") >= size).mapInArrow(partial(_segments, size, gram), SEGMENTS))
        again = scratch.written(all_segments.groupBy("key").agg(F.count(F.lit(1)).alias("_many"), F.max("own").alias("_own")).filter("_many > 1 or _own").select("key"))
        found = scratch.written(all_segments.join(again, "key"))
        scratch.drop(all_segments, again)
        kinds = scratch.written(found.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("_many"), F.min(F.struct("doc_id", "h", "a", "n")).alias("one"), F.max("own").alias("own")))
        twice = scratch.written(kinds.filter("_many > 1").select("key", "seg"))
        whole = scratch.written(found.join(twice, ["key", "seg"]).select("doc_id", "h", "a", (F.col("a") + F.col("n") + size - 1).alias("b")))
        scratch.drop(found, twice)
        volume = F.sum(F.col("one.n") + size)
        several = scratch.written(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("_kinds"), F.max("own").alias("_own"), volume.alias("volume"), F.max("one.n").alias("longest")).filter("_kinds > 1 or _own").select("key", ((F.col("volume") > KEY_BYTES) | (F.col("longest") > KEY_WINDOWS)).alias("hot"), "volume"))
        rest = scratch.written(kinds.join(several.drop("volume"), "key").select("key", "hot", "one.*"))
        scratch.drop(kinds)
        total, hot = several.agg(F.sum(F.when(~F.col("hot"), F.col("volume"))), F.max("hot")).first()
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // SHARD_BYTES))
        wanted = scratch.written(rest.groupBy(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).agg(F.collect_list(F.struct("key", "hot", "a", "n")).alias("wanted")))
        theirs = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h"))).drop("_d", "_h")
        bytes_of = theirs.mapInArrow(partial(_fetch, size), "doc_id long, h long, key long, hot boolean, a long, bytes binary")
        if hot:
            bytes_of = scratch.written(bytes_of)
            windows = scratch.written(bytes_of.filter("hot").select("doc_id", "h", "a", "bytes").mapInArrow(partial(_windows, size), "doc_id long, h long, a long, w long, v long"))
            again = scratch.written(windows.groupBy("w", "v").agg(F.count(F.lit(1)).alias("_many")).filter("_many > 1").select("w", "v"))
            whole = whole.union(windows.join(again, ["w", "v"]).select("doc_id", "h", "a", (F.col("a") + size).alias("b")))
            bytes_of = bytes_of.filter("not hot")
        sorted_out = bytes_of.repartition(shards, "key").mapInArrow(partial(_sort, size), SPANS)
        return written(whole.union(sorted_out))


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


DIGEST = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])


def _kept(text: str | None, spans: list[dict] | None) -> tuple[bytes, bytes, list[tuple[int, int]]]:
    raw, runs = (text or "").encode(), _merged(spans or [])
    edges = [0, *(x for run in runs for x in run), len(raw)]
    return raw, b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), runs


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "text", 4 << 20):
        rows = [_kept(*x) for x in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in ([len(raw) for raw, _, _ in rows], [len(raw) - len(kept) for raw, kept, _ in rows], [len(runs) for _, _, runs in rows])), pa.array([hashlib.sha256(kept).hexdigest() for _, kept, _ in rows])],
            DIGEST.names,
        )


def _with_spans(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """docs with null texts made empty, and the column _spans."""
    keyed = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_h", F.xxhash64("text"))
    spans = repeats(keyed.select("doc_id", F.col("_h").alias("h"), "text"), size, gram).groupBy(F.col("doc_id").alias("_d"), F.col("h").alias("_hash")).agg(F.collect_list(F.struct("a", "b")).alias("_spans"))
    return keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_hash")), "left").drop("_d", "_h", "_hash")


def removal_digest(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, one row for each row of docs (doc_id, text; other columns are not read).

    Null and empty texts have no bytes. Rows with null doc_ids, and rows of one doc_id, are documents like all others. Rows that repeat a text of `size` bytes or more lose all of it. An empty table gives no rows.
    """
    return _with_spans(docs.select("doc_id", "text"), size, gram).mapInArrow(_digest, DIGEST)


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """docs with the repeated bytes cut from `text` and n_chars, if there is such a column, set to what is left; a character that is cut in part
    goes whole. All other columns stay as they are, whatever their names."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 4 << 20):
            texts = [_kept(*x)[1].decode(errors="ignore") for x in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist(), strict=True)]
            given = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())}
            others = batch.column("_row").flatten() if kept else []
            given = dict(zip(kept, others)) | {"doc_id": batch.column("doc_id")} | {c: x.cast(batch_types[c]) for c, x in given.items() if c in batch_types}
            yield pa.RecordBatch.from_arrays([given[c] for c in docs_columns], docs_columns)

    # the caller's columns travel as one, so none can be taken for one of this module's
    docs_columns, batch_types = docs.columns, {f.name: to_arrow_type(f.dataType) for f in docs.schema if f.name in ("text", "n_chars")}
    kept = [c for c in docs_columns if c not in ("doc_id", "text", "n_chars")]
    return _with_spans(docs.select("doc_id", "text", *([F.struct(*kept).alias("_row")] if kept else [])), size, gram).mapInArrow(each, docs.schema)
