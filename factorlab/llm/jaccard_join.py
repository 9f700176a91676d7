"""N-gram Jaccard join: documents link when their sets of 5-word shingles have a Jaccard similarity of at least 0.75.

Shingles are 64-bit hashes, and their order by value is the global order. Documents of one set are one class.

1. Prefixes. Sets of n and of any similar size that reach the threshold share at least l of the first n - ceil(3n/4) + l shingles
   of the global order. With l = n/8 these prefixes, by parts of the hash space, show which of their shingles another class has; a
   class with too few of them links with nothing. Of the others, ordered by how many classes have them, all but the last l - 1 are
   enough for two classes that link to meet: these are a class's link shingles.
2. Chunks. Classes that meet in large groups have one home; a chunk is a bounded number of classes of one home and of similar sizes. Each class is in one chunk.
3. Blocks. Chunks of which some classes meet are held against each other, so each pair of classes that meet is tested in one block.

A block's one side is stored in a trie of ordered sets. The trie is walked once for all sets of the other side: a vector of partial
overlaps is carried from node to node, and a subtree is left when what remains of its sets can't reach the threshold any more.
A block returns a count of links for each of its classes, and of the links only those that join components: never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Scratch, batch_words, mix, sliced, stream, written
from .components import components

WORDS = 5
PLACES = stream(WORDS, 23) | U64(1)
#: Sets and shingles that one side of a block has at most, about.
SIDE, SIDE_SHINGLES = 512, 1 << 17
#: Bytes of text for each part of the hash space; a part's prefix shingles take about as much in its task.
PART_BYTES = 16 << 20


def shingles(words: np.ndarray) -> np.ndarray:
    """The ordered set of a document, from its words' hashes."""
    n = len(words)
    with np.errstate(over="ignore"):
        if n >= WORDS:
            return np.unique(mix(sum(words[k : n - WORDS + 1 + k] * PLACES[k] for k in range(WORDS))))
        if n:
            return mix((words * PLACES[:n]).sum(keepdims=True) + U64(n))
    return np.zeros(0, U64)


def set_id(own: np.ndarray) -> int:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        return int(mix(mix(own).sum(keepdims=True) + U64(len(own))).view(np.int64)[0])


def needed(n: np.ndarray | int) -> np.ndarray | int:
    """ceil(3n / 4): what a set of n shares at least with any that it links to."""
    return -(-3 * n // 4)


def spare(n: int) -> int:
    """l, the shingles that prefixes share at least."""
    return max(1, n // 8)


# -- the trie


class Node:
    """Shingles that all sets below share after those of the node above; sets that end here; nodes below."""

    __slots__ = ("segment", "ends", "below", "least", "left")

    def __init__(self, segment: np.ndarray, ends: list[int], below: list[Node], least: int, left: int) -> None:
        self.segment, self.ends, self.below = segment, ends, below
        self.least, self.left = least, left  # size of the smallest set below; most shingles that a set has still to come


def _shared(a: np.ndarray, b: np.ndarray, at: int) -> int:
    n = min(len(a), len(b))
    off = np.flatnonzero(a[at:n] != b[at:n])
    return at + int(off[0]) if len(off) else n


def trie(rows: list[np.ndarray], sizes: np.ndarray) -> Node:
    """A path-compressed trie of ordered sets; sizes are those of the whole sets, of which rows can leave out what can't match."""
    order = sorted(range(len(rows)), key=lambda k: rows[k].astype(">u4").tobytes())

    def node(own: list[int], at: int) -> Node:
        stop = _shared(rows[own[0]], rows[own[-1]], at)
        ends = [k for k in own if len(rows[k]) == stop]
        groups: list[list[int]] = []
        last = None
        for k in own[len(ends) :]:
            if rows[k][stop] != last:
                last = rows[k][stop]
                groups.append([])
            groups[-1].append(k)
        return Node(rows[own[0]][at:stop], ends, [node(g, stop) for g in groups], int(sizes[own].min()), max(len(rows[k]) for k in own) - stop)

    return node(order, 0)


def block_links(a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(j, i): for sets b[j] that link, the indices i of all sets a[i] that they link with."""
    if not a or not b:
        return
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))
    if not len(both):
        return

    def columns(own: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(both, own), len(both) - 1)
        return at[both[at] == own]

    has = np.zeros((len(both), len(a)), dtype=np.uint8)
    for i, own in enumerate(a):
        has[columns(own), i] = 1
    size_a, size_b = (np.array([len(x) for x in side]) for side in (a, b))
    stack = [(trie([columns(x) for x in b], size_b), np.zeros(len(a), dtype=np.int64))]
    while stack:
        node, overlap = stack.pop()
        if len(node.segment):
            overlap = overlap + has[node.segment].sum(axis=0, dtype=np.int64)
        if not (7 * (overlap + node.left) >= 3 * (size_a + node.least)).any():
            continue
        for j in node.ends:
            found = np.flatnonzero(7 * overlap >= 3 * (size_a + size_b[j]))
            if len(found):
                yield j, found
        stack.extend((x, overlap) for x in node.below)


# -- sets and prefixes

FACTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("cls", T.LongType()), T.StructField("n", T.LongType()), T.StructField("shingle", T.LongType()), T.StructField("df", T.LongType())])
_FACTS = pa.schema([(f.name, pa.int64()) for f in FACTS])
PACKS = "part int, doc_id long, h long, cls long, n long, pack binary"
_PACKS = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("h", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("pack", pa.binary())])


def _prefixes(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, those of one class in all parts, and for each part of the hash space one with the batch's prefix shingles, their classes and sizes."""
    for batch in sliced(batches, "text"):
        sets = [shingles(w) for w in batch_words(batch.column("text").to_pylist())]
        ids, sizes = np.array([set_id(x) for x in sets], dtype=np.int64), np.array([len(x) for x in sets], dtype=np.int64)
        n = len(sets)
        doc_ids, h = batch.column("doc_id"), batch.column("h")
        nulls = pa.nulls(n, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(((ids + np.arange(n)) % parts).astype(np.int32)), doc_ids, h, pa.array(ids), pa.array(sizes), nulls], schema=_PACKS)
        first = np.unique(ids, return_index=True)[1]
        heads = [sets[k][: len(sets[k]) - needed(len(sets[k])) + spare(len(sets[k]))] for k in first]
        shingle = np.concatenate(heads) if heads else np.zeros(0, U64)
        own = np.repeat(first, [len(x) for x in heads])
        part = ((shingle >> U64(33)) % U64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        groups = [g for g in np.split(order, cuts) if len(g)]
        packs = [b"".join([len(g).to_bytes(8, "little"), shingle[g].tobytes(), ids[own[g]].tobytes(), sizes[own[g]].astype(np.int32).tobytes()]) for g in groups]
        k = len(groups)
        yield pa.RecordBatch.from_arrays([pa.array([int(part[g[0]]) for g in groups], pa.int32()), *[pa.nulls(k, pa.int64())] * 4, pa.array(packs, pa.binary())], schema=_PACKS)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents' rows, and (class, size, shingle, df) of the prefix shingles that several classes have."""
    shingle, cls, size = [], [], []
    for batch in batches:
        docs = batch.filter(batch.column("pack").is_null())
        if docs.num_rows:
            none = pa.nulls(docs.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([docs.column("doc_id"), docs.column("h"), docs.column("cls"), docs.column("n"), none, none], schema=_FACTS)
        for raw in batch.column("pack").to_pylist():
            if raw is not None:
                k = int.from_bytes(raw[:8], "little")
                shingle.append(np.frombuffer(raw, np.int64, k, 8))
                cls.append(np.frombuffer(raw, np.int64, k, 8 + 8 * k))
                size.append(np.frombuffer(raw, np.int32, k, 8 + 16 * k))
    if not shingle:
        return
    s, c, n = np.concatenate(shingle), np.concatenate(cls), np.concatenate(size)
    # shingles met once go first, before the larger sort
    order = np.argsort(s, kind="stable")
    s, c, n = s[order], c[order], n[order]
    same = s[1:] == s[:-1]
    twice = np.append(same, False) | np.append([False], same)
    s, c, n = s[twice], c[twice], n[twice]
    if not len(s):
        return
    order = np.lexsort((c, s))
    s, c, n = s[order], c[order], n[order]
    new = np.append([True], (s[1:] != s[:-1]) | (c[1:] != c[:-1]))
    s, c, n = s[new], c[new], n[new]
    starts = np.flatnonzero(np.append([True], s[1:] != s[:-1]))
    df = np.diff(np.append(starts, len(s)))
    df = np.repeat(df, df)
    keep = df > 1
    for k in range(0, int(keep.sum()), 1 << 16):
        cut = slice(k, k + (1 << 16))
        rows = int(len(s[keep][cut]))
        yield pa.RecordBatch.from_arrays([*[pa.nulls(rows, pa.int64())] * 2, pa.array(c[keep][cut]), pa.array(n[keep][cut].astype(np.int64)), pa.array(s[keep][cut]), pa.array(df[keep][cut].astype(np.int64))], schema=_FACTS)


def facts(docs: DataFrame) -> DataFrame:
    """One pass over the texts: rows of documents (doc_id, the hash h of the text, cls, n) and rows of meetings (cls, n, shingle, df)."""
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-volume // PART_BYTES))
    packed = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(partial(_prefixes, parts), PACKS)
    return packed.repartition(parts, "part").mapInArrow(_meetings, FACTS)


def _links_at(n: Column) -> Column:
    """Shingles that a class of n shares with any that it links to, within prefixes."""
    return F.greatest(F.lit(1), F.floor(F.ceil(3 * n / 4) / 8))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls and its ordered shingles, for the documents (doc_id, h) in wanted; a doc_id can be null.

    Both sides grow with the documents, so the join is by merge at every size.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sets = [shingles(w) for w in batch_words(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["cls", "shingles"])

    wanted = wanted.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).hint("merge")
    theirs = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_h")), "left_semi")
    return theirs.mapInArrow(each, "cls long, shingles binary").dropDuplicates(["cls"])


LINKS = "a long, b long, links long"


def _block(table: pa.Table) -> pa.Table:
    """Of one block: (class, null, documents that it links with), and (class, class, null) for links that join what no link before them did."""
    sides: tuple[list, list] = ([], [])
    for row in zip(*(table.column(c).to_pylist() for c in ("cls", "copies", "side", "shingles")), strict=True):
        sides[row[2]].append((row[0], row[1], np.frombuffer(row[3], dtype=U64)))
    a, b = sides[0], sides[1] or sides[0]
    after = len(a) if sides[1] else 0  # where the second side's classes begin
    cls, copies = (np.array([x[k] for x in a + sides[1]], dtype=np.int64) for k in (0, 1))
    links, label = np.zeros(len(cls), dtype=np.int64), np.arange(len(cls))
    joined: list[tuple[int, int]] = []
    for j, found in block_links([x for _, _, x in a], [x for _, _, x in b]):
        j += after
        found = found[found != j]
        if not len(found):
            continue
        links[j] += copies[found].sum()
        if after:
            links[found] += copies[j]
        if (label[found] != label[j]).any():
            for k in np.unique(label[found], return_index=True)[1]:
                i = found[k]
                if label[i] != label[j]:
                    joined.append((i, j))
                    label[label == label[i]] = label[j]
    some = np.flatnonzero(links)
    x, y = (np.array([e[k] for e in joined], dtype=np.int64) for k in (0, 1))
    return pa.table({"a": pa.array(np.append(cls[some], cls[x])), "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(cls[y])]), "links": pa.concat_arrays([pa.array(links[some]), pa.nulls(len(joined), pa.int64())])})


def _chunks(members: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """members with a salt, so that those of equal keys and salt are SIDE sets and SIDE_SHINGLES shingles at most, about."""
    counts = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_many"), F.sum("n").alias("_sum"))
    salts = F.ceil(F.greatest(F.col("_many") / SIDE, F.col("_sum") / SIDE_SHINGLES)).cast("long")
    return members.join(scratch.written(counts.select(*keys, salts.alias("_salts"))), keys).withColumn("salt", F.pmod(F.xxhash64("cls"), "_salts")).drop("_salts")


def _blocks(link: DataFrame, scratch: Scratch) -> DataFrame:
    """(block, side 0 or 1, cls), from the link shingles (cls, n, shingle) of classes. A block without a side 1 is held against itself.

    Tables of a row for each key are written before they are joined, so that Spark can split the keys that very many rows have.
    """
    groups = scratch.written(link.groupBy("shingle").agg(F.count(F.lit(1)).alias("_many")).filter("_many > 1"))
    met = scratch.written(link.join(groups, "shingle"))
    # a class is at home in the largest group that it meets in three steps, so that families of near copies have one home; sizes
    # within 3/4 of each other are in the same band or in neighbouring ones
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(4.0 / 3)) + 1e-9).cast("int")
    homes = met.groupBy("cls", "n").agg(F.max(F.struct("_many", "shingle")).alias("home"))
    for _ in range(2):
        best = scratch.written(met.join(homes.select("cls", "home"), "cls").groupBy("shingle").agg(F.max("home").alias("home")))
        homes = scratch.written(met.join(best, "shingle").groupBy("cls", "n").agg(F.max("home").alias("home")))
    homes = homes.select("cls", "n", F.col("home.shingle").alias("home"), band.alias("band"))
    homes = scratch.written(_chunks(homes, ["home", "band"], scratch).select("cls", F.struct("band", "home", "salt").alias("chunk")))
    # groups that meet the same chunks are taken once
    chunks = F.sort_array(F.collect_set("chunk"))
    groups = met.select("shingle", "cls").join(homes, "cls").groupBy("shingle").agg(chunks.alias("_met")).select("_met").distinct()
    groups = scratch.written(groups.withColumn("g", F.monotonically_increasing_id()).select("g", F.explode("_met").alias("chunk")))
    x, y = groups.select("g", F.col("chunk").alias("x")), groups.select("g", F.col("chunk").alias("y"))
    pairs = x.join(y, "g").filter("x <= y and y.band <= x.band + 1").select("x", "y").distinct()
    pairs = scratch.written(pairs.withColumn("block", F.monotonically_increasing_id()))
    sides = pairs.select("block", F.lit(0).alias("side"), F.col("x").alias("chunk")).union(pairs.filter("x != y").select("block", F.lit(1).alias("side"), F.col("y").alias("chunk")))
    return sides.join(homes, "chunk").select("block", "side", "cls")


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, stays and h (xxhash64 of the text) for each row of docs (doc_id, text; other columns are not read).

    component_id is the smallest doc_id that is reachable by links, the row's own included; n_links counts the other rows that the row
    links with; stays is true for rows of one text of each component: that with the smallest doc_id, rows without one last, and of
    those with the smallest h. Null texts and those without words have no shingles and are linked with nothing. Equal texts, and texts of equal
    sets, are linked. Rows with null doc_ids link like all others; component_id is null where no row of the component has an id. An
    empty table gives no rows.
    """
    with Scratch(docs.sparkSession) as scratch:
        table = scratch.written(facts(docs))
        own, meetings = scratch.written(table.filter("shingle is null").select("doc_id", "h", "cls", "n")), table.filter("shingle is not null")
        classes = scratch.written(own.groupBy("cls", "n").agg(F.min(F.struct("doc_id", "h")).alias("one"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("first"), F.count(F.lit(1)).alias("copies")))

        # classes that share enough, and their link shingles
        m = _links_at(F.col("n"))
        by_class = meetings.groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("_all")).filter(F.size("_all") >= m)
        link = scratch.written(by_class.select("cls", "n", F.explode(F.slice("_all", F.lit(1), (F.size("_all") - m + 1).cast("int"))).alias("_one")).select("cls", "n", "_one.shingle"))
        scratch.drop(table)
        blocks = scratch.written(_blocks(link, scratch))
        held = classes.join(blocks.select("cls").distinct(), "cls", "left_semi")
        sets = scratch.written(_sets(docs, held.select("one.*")).join(held.select("cls", "copies"), "cls"))
        scratch.drop(link)
        found = scratch.written(blocks.hint("merge").join(sets, "cls").groupBy("block").applyInArrow(_block, LINKS))
        scratch.drop(sets, blocks)
        comps = components(found.filter("b is not null").select("a", "b"), scratch).withColumnRenamed("id", "cls")
        links = found.filter("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))

        # components of classes, then of rows
        n_links = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
        placed = scratch.written(classes.filter("n > 0").join(comps, "cls", "left").join(links, "cls", "left").select("cls", "first", F.coalesce("comp", "cls").alias("comp"), n_links.alias("n_links")))
        least = scratch.written(placed.groupBy("comp").agg(F.min("first").alias("rep")))
        named = scratch.written(placed.join(least, "comp").select("cls", "rep.doc_id", F.col("rep.h").alias("_h"), "n_links").withColumnRenamed("doc_id", "_least"))
        some = F.col("n") > 0
        component = F.when(some, F.col("_least")).otherwise(F.col("doc_id"))
        stays = ~some | (F.col("doc_id").eqNullSafe(F.col("_least")) & (F.col("h") == F.col("_h")))
        return written(own.join(named, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), stays.alias("stays"), "h"))
