"""Token counts: scans flat token files for the end-of-document id.

A token file is nothing but 16-bit ids, documents one after another, each with an end-of-document id after it, and no index. Tasks read
blocks of it, search them for the separator in one vectorised comparison, and return the counts within and at both edges of the block.
A prefix scan over the blocks of a file then stitches the documents that go over their boundaries and numbers all documents.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, checkpointed, shared_dir, sliced, store_of, written

#: Ids in a block that a task scans at once.
BLOCK = 1 << 20
#: Blocks that a task scans, about.
TASK_BLOCKS = 4
WIDTH = 2


def _encoding(ranks_file: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, path: str, ranks_file: str, pattern: str, end: int) -> DataFrame:
    """Encodes documents into token files in the folder `path`, one for each task; returns (file, ordinal, doc_id).

    A file gets its name when it is whole, so a task that is done again leaves nothing in between. Null texts have no ids.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks_file, pattern)
        store, folder = store_of(path)
        name = f"{TaskContext.get().partitionId():06d}.tokens"
        part = f"{folder}/{name}.{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        n = 0
        with store.open_output_stream(part) as out:
            for batch in sliced(batches, "text", 1 << 20):
                for text in batch.column("text").to_pylist():
                    out.write(np.append(np.array(encoding.encode_ordinary(text or ""), dtype="<u2"), np.uint16(end)).astype("<u2").tobytes())
                k = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * k), pa.array(np.arange(n, n + k)), batch.column("doc_id")], ["file", "ordinal", "doc_id"])
                n += k
        store.move(part, f"{folder}/{name}")

    return docs.select("doc_id", "text").mapInArrow(each, "file string, ordinal long, doc_id long")


def blocks_of(spark, path: str, block: int) -> DataFrame:
    """(file, block, at, ids): the blocks of all token files in a folder. Spark lists the files; their bytes are not read here."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    n = F.ceil(F.col("length") / (WIDTH * block)).cast("long")
    each = files.filter("length > 0").select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block"))
    return each.select("file", "block", (F.col("block") * block * WIDTH).alias("at"), F.least(F.lit(block).cast("long"), (F.col("length") - F.col("block") * block * WIDTH) / WIDTH).cast("long").alias("ids"))


def scan_blocks(blocks: DataFrame, path: str, end: int) -> DataFrame:
    """(file, block, ids, head, tail, inner): ids before the first separator, after the last, and of the documents between.

    head is null in a block without a separator.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = store_of(path)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{folder}/{row['file']}") as f:
                    f.seek(row["at"])
                    ids = np.frombuffer(f.read(row["ids"] * WIDTH), dtype="<u2")
                ends = np.flatnonzero(ids == end)
                some = len(ends) > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["file"]]),
                        pa.array([row["block"]], pa.int64()),
                        pa.array([len(ids)], pa.int64()),
                        pa.array([int(ends[0]) if some else None], pa.int64()),
                        pa.array([len(ids) - 1 - int(ends[-1]) if some else len(ids)], pa.int64()),
                        pa.array([(np.diff(ends) - 1).tolist()], pa.list_(pa.int64())),
                    ],
                    ["file", "block", "ids", "head", "tail", "inner"],
                )

    # tasks by the number of blocks: by their few bytes of names Spark would put them all into one
    return blocks.repartition(max(1, -(-blocks.count() // TASK_BLOCKS)), "file", "block").mapInArrow(each, "file string, block long, ids long, head long, tail long, inner array<long>")


def stitched(scanned: DataFrame) -> DataFrame:
    """(file, ordinal, n_tokens) of each document, from the blocks' counts. Ids after a file's last separator are of no document."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # blocks since the last one with a separator, that one's tail included, are carried into the next head
    open_run = scanned.withColumn("_run", F.coalesce(F.sum(F.col("head").isNotNull().cast("long")).over(before), F.lit(0)))
    within = Window.partitionBy("file", "_run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    closed = F.when(F.col("head").isNotNull(), F.size("inner") + 1).otherwise(0)
    last_tail = F.max(F.when(F.col("head").isNotNull(), F.struct("block", "tail"))).over(before)["tail"]
    run = open_run.withColumns({"_tail": F.coalesce(last_tail, F.lit(0)), "_since": F.coalesce(F.sum(F.when(F.col("head").isNull(), F.col("ids"))).over(within), F.lit(0)), "_first": F.coalesce(F.sum(closed).over(before), F.lit(0))})
    counts = F.concat(F.array(F.col("head") + F.col("_tail") + F.col("_since")), F.col("inner"))
    return run.filter("head is not null").select("file", "_first", F.posexplode(counts).alias("_k", "n_tokens")).select("file", (F.col("_first") + F.col("_k")).alias("ordinal"), "n_tokens")


def count_tokens(docs: DataFrame, ranks_file: str, pattern: str, end: int, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, file and ordinal, one row for each row of docs (doc_id, text; other columns are not read).

    Documents are written to token files in the shared folder; the counts come from those alone. Null and empty texts have 0 tokens. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    with Scratch(spark) as scratch:
        order = scratch.written(write_token_files(docs, path, ranks_file, pattern, end))
        if not order.limit(1).count():
            return checkpointed(order.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), "file", "ordinal"))
        counts = stitched(scan_blocks(blocks_of(spark, path, block), path, end))
        # both sides have a row for each document: neither is ever small enough to be broadcast
        return written(order.hint("merge").join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal"))
