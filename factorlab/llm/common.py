"""Helpers shared by the training-data operators: reading, cutting lineage, hashing words in bulk."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words; every other character belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

U64 = np.uint64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset and the master is local, one of our own."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factorlab-checkpoint-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """For small tables that are read more than once: lineage ends in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """For large tables that are read more than once: a compressed Parquet table in the shared folder."""
    return _parquet(df, f"{shared_dir(df.sparkSession)}/factorlab-{uuid.uuid4().hex}")


def _parquet(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_of(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and the folder of a path in the shared folder, for files that are not Spark's."""
    if path.startswith("file:"):
        path = "file:///" + path.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class Scratch:
    """Parquet tables in the shared folder that are deleted when the work that reads them is done, or when one of them is done with."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/factorlab-{uuid.uuid4().hex}", 0
        self.paths: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.base)

    def written(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        table = _parquet(df, path)
        self.paths.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more; what was read from them must have been written."""
        for table, path in self.paths:
            if any(table is x for x in tables):
                self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def matched(left: DataFrame, right: DataFrame, key: str, most: int = 1000) -> DataFrame:
    """left joined with right, which has each key of left once, with `uses`, the rows that left has of it (dropped).

    Fewer than `most` keys can have more than one in `most` of the rows; those are broadcast, so that no task gets more than that of a key.
    """
    total = right.agg(F.sum("uses")).first()[0] or 0
    often = F.col("uses") * most > total
    hot, others = F.broadcast(right.filter(often).drop("uses")), right.filter(~often).drop("uses")
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(others, key))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n reproducible 64-bit constants."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15))


#: Documents are hashed in pieces of about so many bytes, so that memory doesn't follow the batch.
PIECE = 1 << 20
BYTE_VALUE = stream(256, 11)
BASE = 0x9E3779B97F4A7C13  # 3 modulo 8, so that differences of its powers keep few factors of two
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PIECE, 1 << (n - 1).bit_length())
    if size not in _POWER:
        _POWER.clear()
        _POWER[size] = powers(BASE, size), powers(pow(BASE, -1, 1 << 64), size)
    return _POWER[size]


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, starts and ends of the words in an array of bytes."""
    if not len(data):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _tables(len(data))
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64)), start, end


def doc_words(text: str | None, lower: bool = True) -> np.ndarray:
    """Hashes of one document's words; long texts are taken in pieces that end at white space."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    if lower:
        raw = LOWER[raw]
    found, at = [], 0
    while at < len(raw):
        stop = min(at + PIECE, len(raw))
        if stop < len(raw):
            gaps = np.flatnonzero(SPACE[raw[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:  # one word longer than a piece: go on to its end
                gaps = np.flatnonzero(SPACE[raw[stop:]])
                stop = stop + int(gaps[0]) if len(gaps) else len(raw)
        found.append(words_of(raw[at:stop])[0])
        at = stop
    return np.concatenate(found) if found else np.zeros(0, U64)


def batch_words(texts: list[str | None], lower: bool = True) -> Iterator[np.ndarray]:
    """doc_words of each text, hashed together in pieces."""
    group: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if not group:
            return
        data = np.frombuffer(b"\n".join(group), dtype=np.uint8)
        hashes, start, _ = words_of(LOWER[data] if lower else data)
        stops = np.cumsum([len(x) + 1 for x in group])
        yield from np.split(hashes, np.searchsorted(start, stops[:-1]))

    for text in texts:
        if text is not None and len(text) > PIECE // 2:
            yield from flush()
            group, size = [], 0
            yield doc_words(text, lower)
            continue
        raw = (text or "").encode()
        group.append(raw)
        size += len(raw) + 1
        if size > PIECE // 2:
            yield from flush()
            group, size = [], 0
    yield from flush()


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of the column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.array([len(x) if x is not None else 0 for x in batch.column(column).to_pylist()]) if batch.num_rows < 2 else np.diff(_offsets(batch.column(column)))
        part = np.cumsum(size + 16) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
