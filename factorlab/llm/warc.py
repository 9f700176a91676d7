"""WARC archives of pages, and an external merge of their capture indexes.

Writing: one record for each page, each a gzip member of its own, so that a reader can go to any offset; archives are cut by bytes. A
file gets its name when it is whole, so a task that is done again leaves nothing in between. Records of equal payloads of REVISIT
bytes or more are revisits of the one with the largest page_id.

Reading: archives are streams of records, parsed by the lengths in their headers. Each gives a run of captures, ordered by URL key and
timestamp, as a file of its own. A loser tree merges FAN_IN runs into one, pass after pass, until FAN_IN are left; those are merged
by ranges of the key at once, each range finding its place in every run by bisection. Merges read a batch of each run at a time. So
all ranges, one after another, are the captures in order, and each capture knows its place in the history of its URL.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from datetime import UTC, datetime, timedelta
from functools import partial
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, shared_dir, sliced, store_of, written

#: Payloads from so many bytes on are stored once.
REVISIT = 1000
#: Bytes of an archive after which another is begun.
ARCHIVE_BYTES = 64 << 20
#: Runs that are merged at once; captures in a batch of a run, and in a range of the last merge, about.
FAN_IN, BATCH, RANGE = 64, 1024, 1 << 16
#: Pages have no time of capture: a page is taken to be captured page_id seconds, modulo a century, after this.
EPOCH, CENTURY = datetime(2000, 1, 1, tzinfo=UTC), 36525 * 86400
END = "\r\n"

CAPTURE = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url_key", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()),
    ]
)
FIELDS = CAPTURE.names
_CAPTURE = pa.schema([(f, pa.string() if f in ("url_key", "timestamp", "payload_digest", "record_type", "archive") else pa.int64()) for f in FIELDS])


def url_key(url: str | None) -> str:
    """The host's labels from the last to the first, then path and query, in lower case; empty for no URL."""
    if not url or "://" not in url:
        return ""
    try:
        x = urlsplit(url)
        host, port = x.hostname or "", f":{x.port}" if x.port else ""
    except ValueError:
        return url.lower()
    return f"{','.join(reversed(host.split('.')))}{port}){x.path}{'?' + x.query if x.query else ''}".lower()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in sliced(batches, "html", 2 << 20):
        for page_id, url, html, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
            payload = (html or "").encode()
            size = len(payload)
            target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
            http = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: {size}{END}{END}".encode()
            # what a revisit does not store again it names: the digest, the size, and the record it refers to
            body = http if refers_to is not None else http + payload
            head = [
                "WARC/1.1",
                f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
                f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
                f"WARC-Date: {(EPOCH + timedelta(seconds=(page_id or 0) % CENTURY)).strftime('%Y-%m-%dT%H:%M:%SZ')}",
                f"WARC-Target-URI: {target}",
                f"WARC-Payload-Digest: sha1:{digest}",
                "Content-Type: application/http; msgtype=response",
            ]
            if refers_to is not None:
                head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
            head.append(f"Content-Length: {len(body)}")
            yield (END.join(head) + END + END).encode() + body + (END + END).encode()


def _archived(path: str, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Writes archives and returns their names, with the task and the number within it."""
    store, folder = store_of(path)
    store.create_dir(folder, recursive=True)
    task, k, out, part, size = TaskContext.get().partitionId(), 0, None, "", 0

    def done() -> pa.RecordBatch:
        out.close()
        name = f"{task:06d}-{k:06d}.warc.gz"
        store.move(part, f"{folder}/{name}")
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([task], pa.int64()), pa.array([k], pa.int64())], ["archive", "task", "k"])

    for record in _records(batches):
        if out is None:
            part = f"{folder}/{uuid.uuid4().hex}.part"
            out, size = store.open_output_stream(part), 0
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = pack.compress(record) + pack.flush()
        out.write(member)
        size += len(member)
        if size >= most:
            yield done()
            out, k = None, k + 1
    if out is not None:
        yield done()


ARCHIVES = "archive string, task long, k long"


def write_archives(pages: DataFrame, path: str, scratch: Scratch) -> DataFrame:
    """Writes the WARC records of pages (page_id, url, html; other columns are not read) to the folder path; returns the archives. Null html is empty.

    Records are named by page_id, so those of equal ids share a name; a null id gives an empty name and the first date. A row is a
    revisit by its own payload and id, however often the id occurs: it refers to the record of that name with its own digest. Rows
    of the largest id and rows without one are responses.
    """
    pages = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    large = pages.filter(F.col("size") >= REVISIT).select("page_id", "digest")
    shared = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.min("page_id").alias("last")).filter("first > last")
    # one row for each id and digest: a join on both neither mixes up the payloads of an id nor repeats rows, and a digest that very many pages have is still dealt out
    revisits = large.distinct().join(shared, "digest").filter("page_id < first").select("page_id", "digest", F.col("first").alias("refers_to"))
    records = pages.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")
    return scratch.written(records.mapInArrow(partial(_archived, path, ARCHIVE_BYTES), ARCHIVES))


def members(stream, step: int = 1 << 14) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member of a stream."""
    at, held = 0, b""
    while True:
        start, parts, member = at, [], zlib.decompressobj(31)
        while not member.eof:
            held = held or stream.read(step)
            if not held:
                break
            parts.append(member.decompress(held))
            at += len(held) - len(member.unused_data)
            held = member.unused_data
        if not parts:
            return
        if not member.eof:
            raise ValueError(f"the archive ends within the record at byte {start}")
        yield start, b"".join(parts)


def parse(raw: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of each record of an archive."""
    at = 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        lines = raw[at:stop].decode().split(END)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(headers["Content-Length"])
        block = raw[stop + 4 : stop + 4 + size]
        if len(block) != size or raw[stop + 4 + size : stop + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is damaged")
        yield at, headers, block
        at = stop + 8 + size


def _capture(archive: str, at: int, headers: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split(END)[1:])["Content-Length"])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda name: int(x) if (x := headers.get(name, "")[len("<urn:page:") : -1]) else None
    if headers["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload at byte {at} of {archive} is damaged")
    return number("WARC-Record-ID"), url_key(headers["WARC-Target-URI"]), headers["WARC-Date"], size, digest, headers["WARC-Type"], number("WARC-Refers-To"), archive, at


def _order(capture: tuple) -> tuple:
    """Rows without an id come first, as in Spark."""
    return capture[1], capture[2], capture[0] is not None, capture[0] or 0


# -- runs

INDEX = "run string, task long, k long, rows long, url_key string, timestamp string, page_id long"


def _put(path: str, name: str, task: int, k: int, most: int, captures: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Writes ordered captures as a run, in batches of `most`; returns the first key of each batch."""
    store, folder = store_of(path)
    store.create_dir(folder, recursive=True)
    part = f"{folder}/{uuid.uuid4().hex}.part"
    index: list[tuple] = []
    with store.open_output_stream(part) as sink, pa.ipc.new_file(sink, _CAPTURE) as out:
        rows: list[tuple] = []

        def flush() -> None:
            index.append((name, task, k, len(rows), rows[0][1], rows[0][2], rows[0][0]))
            out.write_batch(_batch(rows, _CAPTURE))
            rows.clear()

        for row in captures:
            rows.append(row)
            if len(rows) == most:
                flush()
        if rows:
            flush()
    store.move(part, f"{folder}/{name}")
    if index:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), [pa.string(), *[pa.int64()] * 3, pa.string(), pa.string(), pa.int64()], strict=True)], ["run", "task", "k", "rows", "url_key", "timestamp", "page_id"])


def _get(path: str, name: str, held: ExitStack, low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple]:
    """(key, capture) of a run from the key low on and below high; one batch is in memory."""
    store, folder = store_of(path)
    run = pa.ipc.open_file(held.enter_context(store.open_input_file(f"{folder}/{name}")))

    def rows(k: int) -> list[tuple]:
        batch = run.get_batch(k)
        return list(zip(*(batch.column(c).to_pylist() for c in FIELDS), strict=True))

    first, stop = 0, run.num_record_batches
    while low is not None and stop - first > 1:  # the last batch that begins at low or below it
        middle = (first + stop) // 2
        first, stop = (middle, stop) if _order(rows(middle)[0]) < low else (first, middle)
    for k in range(first, run.num_record_batches):
        for row in rows(k):
            key = _order(row)
            if high is not None and key >= high:
                return
            if low is None or key >= low:
                yield *key, row


def read_archives(path: str, archives: DataFrame, runs: str, scratch: Scratch) -> DataFrame:
    """Reads each archive as a stream and writes its captures, in order, as a run to the folder `runs`; returns the runs' batches. A damaged record is an error."""
    most = BATCH

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = store_of(path)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_stream(f"{folder}/{row['archive']}", compression=None) as stream:
                    found = [_capture(row["archive"], at, headers, block) for at, raw in members(stream) for _, headers, block in parse(raw)]
                yield from _put(runs, f"{row['archive']}.run", row["task"], row["k"], most, sorted(found, key=_order))

    # a task for each archive: without a number Spark would put so few bytes of names into one task
    return scratch.written(archives.repartition(max(1, archives.count()), "archive").mapInArrow(each, INDEX))


class LoserTree:
    """Merges ordered runs of tuples, by all their items but the last. Inner nodes keep the loser of the match below them; the winner is played up again after each item."""

    def __init__(self, runs: list[Iterator]) -> None:
        self.runs = runs
        self.n = max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.losers = [-1] * self.n
        for k in range(self.n):
            self._play(k)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x[:-1], a) < (y[:-1], b))

    def _play(self, k: int) -> None:
        winner, at = k, (k + self.n) // 2
        while at > 0:
            if self.losers[at] < 0:  # the first to come waits for its match
                self.losers[at] = winner
                return
            if self._beats(self.losers[at], winner):
                winner, self.losers[at] = self.losers[at], winner
            at //= 2
        self.winner = winner

    def __iter__(self) -> Iterator:
        while (item := self.heads[self.winner]) is not None:
            yield item
            self.heads[self.winner] = next(self.runs[self.winner], None)
            self._play(self.winner)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _merged_runs(index: DataFrame, runs: str, level: int, scratch: Scratch) -> DataFrame:
    """One pass: FAN_IN runs, those of neighbouring tasks or, with one task left, of neighbouring numbers, become one."""
    most = BATCH
    one = index.agg(F.max("task")).first()[0] == 0
    groups = index.select("run", F.col("task") if one else F.floor(F.col("task") / FAN_IN).cast("long").alias("task"), F.floor(F.col("k") / FAN_IN).cast("long").alias("k") if one else F.col("k")).distinct()
    groups = groups.groupBy("task", "k").agg(F.sort_array(F.collect_list("run")).alias("runs"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with ExitStack() as held:
                    tree = LoserTree([_get(runs, name, held) for name in row["runs"]])
                    yield from _put(runs, f"{level}-{row['task']}-{row['k']}.run", row["task"], row["k"], most, (x[-1] for x in tree))

    return scratch.written(groups.repartition(groups.count(), "task", "k").mapInArrow(each, INDEX))


_HISTORY = pa.schema([pa.field("range", pa.int64()), *_CAPTURE, pa.field("place", pa.int64()), pa.field("in_range", pa.int64())])
HISTORY = T.StructType([T.StructField("range", T.LongType()), *CAPTURE.fields, T.StructField("place", T.LongType()), T.StructField("in_range", T.LongType())])


def _ranged(runs: str, names: list[str], lows: list[tuple | None]) -> Callable:
    """Merges the runs' pieces of the given ranges; place counts within the range, in_range within the range and URL."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("range").to_pylist():
                with ExitStack() as held:
                    out: list[tuple] = []
                    last, place, own = None, 0, 0
                    for *key, row in LoserTree([_get(runs, name, held, lows[k], lows[k + 1]) for name in names]):
                        own = own + 1 if key[0] == last else 1
                        last, place = key[0], place + 1
                        out.append((k, *row, place, own))
                        if len(out) == 4 * BATCH:
                            yield _batch(out, _HISTORY)
                            out = []
                    if out:
                        yield _batch(out, _HISTORY)

    return each


def capture_histories(index: DataFrame, runs: str, scratch: Scratch) -> DataFrame:
    """The captures of all runs with range, place and capture: by range and place they are in order of URL key, timestamp and page_id, and
    capture is the number within the whole history of the URL, over all ranges. The driver gets FAN_IN names and a key for each range.
    """
    spark, level = scratch.spark, 0
    while index.select("run").distinct().count() > FAN_IN:
        level += 1
        index = _merged_runs(index, runs, level, scratch)
    names = sorted(r["run"] for r in index.select("run").distinct().collect())
    total = index.agg(F.sum("rows")).first()[0] or 0
    keys = ["url_key", "timestamp", "page_id"]
    cut = index.repartitionByRange(max(1, -(-total // RANGE)), *keys).groupBy(F.spark_partition_id().alias("_p")).agg(F.min(F.struct(*keys)).alias("_low"))
    lows = sorted(_order((r["page_id"], r["url_key"], r["timestamp"])) for r in cut.select("_low.*").collect())
    lows = [None, *lows[1:], None]
    ranges = spark.range(len(lows) - 1).select(F.col("id").alias("range")) if names else spark.range(0).select(F.col("id").alias("range"))
    found = scratch.written(ranges.repartition(max(1, len(lows) - 1), "range").mapInArrow(_ranged(runs, names, lows), HISTORY))
    # a history that goes on from ranges before: what each range has of its last URL counts for its first one in the ranges after
    edges = found.groupBy("range").agg(F.min("url_key").alias("first"), F.max(F.struct("url_key", "in_range")).alias("last"))
    marks = edges.select(F.col("first").alias("key"), "range", F.lit(0).alias("ends"), F.lit(0).cast("long").alias("n")).union(edges.select("last.url_key", "range", F.lit(1), "last.in_range"))
    before = Window.partitionBy("key").orderBy("range", "ends").rowsBetween(Window.unboundedPreceding, -1)
    since = marks.withColumn("since", F.coalesce(F.sum("n").over(before), F.lit(0))).filter("ends = 0").select("range", F.col("key").alias("url_key"), "since")
    capture = (F.col("in_range") + F.coalesce("since", F.lit(0))).alias("capture")
    return found.join(scratch.written(since), ["range", "url_key"], "left").select(*FIELDS, "range", "place", capture)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes pages as WARC archives to the shared folder, reads them back and returns the merged histories.

    One row for each row of pages: page_id, url_key, timestamp, payload_bytes, payload_digest, record_type, refers_to, archive, offset
    (of the record's gzip member), range, place, capture. Ids can be any. An empty table gives no rows. The archives stay.
    """
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    with Scratch(pages.sparkSession) as scratch:
        runs = f"{scratch.base}/runs"
        index = read_archives(path, write_archives(pages, path, scratch), runs, scratch)
        return written(capture_histories(index, runs, scratch))
