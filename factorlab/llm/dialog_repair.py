"""Conversation structure repair: faults of each conversation, and its cheapest repair by a grammar-compressed dynamic programme.

Rows are put in order without their texts, by ranges of (conversation, turn, role, digest), and cut into blocks of BLOCK of them. A
conversation's rows of a block are a piece; each piece's sequence of roles and faults goes through the grammar (repair_grammar) and comes
out as costs and letters for each two states. A conversation's pieces are then walked in order, as a stream. Its texts come last, once, as
a stream in the same order beside the chosen letters, and go straight into the digest. So no task holds a conversation, however long; what
follows its length in one task is the stream that its digest is of, and the string of its edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import WORD, Scratch, sliced, written
from .repair_grammar import ASSISTANT, START, SYMBOLS, SYSTEM, USER, Grammar, Walk, letters

#: Rows in a block are 2 to the power of this.
BLOCK_BITS = 8
DAMAGES = 20
#: The characters that separate words, as a string of SQL.
SPACES = "' \\t\\n\\u000b\\u000c\\r'"
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _text(c: Column | str) -> Column:
    """A value as text, a null as one space."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (1 or 2) of the rows that damage leaves, by the crc32 of `conv_id:turn`."""
    kind = F.crc32(F.concat_ws(":", _text("conv_id"), _text("turn"))) % DAMAGES
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(_text("text"), "[.!?]", "")).otherwise(_text("text"))
    rows = df.filter(kind != 0)
    return rows.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(_text("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"))


def _facts(rows: DataFrame) -> DataFrame:
    """Distinct rows of (conv_id, turn, role, digest of the text), how often each is there, and what its text says of it."""
    shown = F.expr(f"rtrim({SPACES}, text)")
    blank = ~F.col("text").rlike(WORD)
    cut = ~F.right(shown, F.lit(1)).isin(".", "!", "?")
    keyed = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "copies", blank.alias("blank"), cut.alias("cut"))
    return keyed.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece of a conversation: its counts, and costs and letters of the ways between each two states."""
    grammar = Grammar()
    for batch in batches:
        if not batch.num_rows:
            continue
        of = grammar.matrices_of(batch.column("symbols").to_pylist())
        shown: dict[str, list] = {}
        costs, texts = [], []
        for symbols, n in zip(batch.column("symbols").to_pylist(), batch.column("n").to_pylist()):
            if symbols not in shown:
                shown[symbols] = [(-1, "") if w is None else (w[0], letters(w[1])) for w in of[symbols]]
            ways = shown[symbols]
            if max(n) > 1:  # further equal rows go, right behind the first one
                more = 4 * (sum(n) - len(n))
                ways = [(c + more if c >= 0 else c, _with_copies(t, n)) for c, t in ways]
            costs.append([c for c, _ in ways])
            texts.append([t for _, t in ways])
        kept = [c for c in batch.schema.names if c not in ("symbols", "n")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(costs, pa.list_(pa.int64())), pa.array(texts, pa.list_(pa.string()))], [*kept, "costs", "ways"])


def _with_copies(text: str, n: list[int]) -> str:
    out, row = [], iter(n)
    for letter in text:
        out.append(letter)
        if letter != "I":
            out.append("D" * (next(row) - 1))
    return "".join(out)


class _Conversation:
    """What has been seen of a conversation while its pieces go by."""

    def __init__(self) -> None:
        self.walk, self.keys = Walk(), []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last_turn = None
        self.last_role = ""

    def add(self, r: dict) -> None:
        self.walk.step([(c, t) if c >= 0 else None for c, t in zip(r["costs"], r["ways"])])
        self.keys.append((r["turn"], r["role"], r["digest"]))
        for c in ("blank", "duplicate", "truncated"):
            setattr(self, c, getattr(self, c) + r[c])
        self.illegal += r["illegal"] + (self.last_role != "" and self.last_role + r["first_role"] not in ("su", "ua", "au"))
        self.last_role = r["last_role"]
        if r["low"] is not None:
            self.turns += r["turns"] - (r["low"] == self.high)
            self.low = r["low"] if self.low is None else self.low
            self.high = r["high"]

    def rows(self) -> list[tuple]:
        """A row for each piece, with its state and letters; the last has the conversation's numbers and all letters."""
        cost, pieces = self.walk.end()
        out = [[*key, start, text, None, None] for key, (start, text) in zip(self.keys, pieces)]
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        out[-1][-2:] = [[gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost], "".join(t for _, t in pieces)]
        return out


def _walked(kinds: list[pa.DataType]):
    """For mapInArrow over pieces in order: the chosen letters of each."""
    names = ["conv_id", "turn", "role", "digest", "state", "letters", "numbers", "audit"]
    types = [*kinds, pa.string(), pa.binary(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.string()]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, out = None, None, []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out.clear()
            return batch

        for batch in batches:
            for r in batch.to_pylist():
                if own is None or r["conv_id"] != now:
                    if own is not None:
                        out += [(now, *x) for x in own.rows()]
                        if len(out) > 5000:
                            yield flush()
                    now, own = r["conv_id"], _Conversation()
                own.add(r)
        if own is not None:
            out += [(now, *x) for x in own.rows()]
            yield flush()

    return f


class _Repair:
    """A conversation's repaired text as a digest, while its rows and letters go by."""

    def __init__(self) -> None:
        self.digest, self.empty, self.numbers, self.audit = hashlib.sha256(), True, [0] * len(COUNTS), ""
        self.state, self.letters, self.at = START, "", 0

    def _say(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.empty else '\n'}{role}:{text}".encode())
        self.empty = False

    def piece(self, r: dict) -> None:
        self.insert()
        self.state, self.letters, self.at = r["state"], r["letters"], 0
        if r["numbers"] is not None:
            self.numbers, self.audit = r["numbers"], r["audit"]

    def insert(self) -> None:
        while self.letters[self.at : self.at + 1] == "I":
            self._next("")
            self.at += 1

    def _next(self, text: str) -> None:
        """The row that must come here, by its state."""
        self._say("assistant" if self.state == USER else "user", text)
        self.state = ASSISTANT if self.state == USER else USER

    def row(self, role: str, text: str) -> None:
        self.insert()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "R":
            self._next(text)
        elif letter == "K":
            self._say(role, text)
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]

    def end(self) -> tuple:
        self.insert()
        return (*self.numbers, self.audit, self.digest.hexdigest())


def _repaired(kind: pa.DataType):
    """For mapInArrow over each conversation's beginning, and its letters and texts in order: its numbers and digests."""
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    types = [kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, out = None, None, []
        for batch in sliced(batches, "text"):
            for r in batch.to_pylist():
                if r["part"] == 0:
                    if own is not None:
                        out.append((now, *own.end()))
                    now, own = r["conv_id"], _Repair()
                elif r["part"] == 1 and r["kind"] == 0:
                    own.piece(r)
                else:
                    for _ in range(r["copies"]):
                        own.row(r["role"], r["text"])
            if len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out = []
        if own is not None:
            out.append((now, *own.end()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return f


def repair_conversations(df: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of damaged().

    Rows go by turn (nulls first), rows of one turn by role and by the digest of their text. Null roles and texts are one space, and so are
    null ids and turns in the number that decides on damage; rows with a null conv_id are one conversation. Of equal rows those behind the first
    one are duplicates. A role counts by its first letter (s, u, a; any other, or none, fits nowhere). Conversations without rows after
    damage have zeros, no audit and the digest of nothing. An empty table gives an empty result. Other columns are not looked at.
    """
    spark = df.sparkSession
    df = df.select("conv_id", "turn", "role", "text")
    rows = damaged(df)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    kinds = dict(df.dtypes)
    arrow = [to_arrow_type(df.schema[c].dataType) for c in ("conv_id", "turn")]
    with Scratch(spark) as scratch:
        facts = _facts(rows).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
        facts = scratch.written(facts)
        first = facts.filter("not blank").groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
        known = facts.join(first, "pos", "left").withColumn("first", F.coalesce("first", F.lit(False)))
        initial = F.left("role", F.lit(1))
        role = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
        symbol = F.when(F.col("blank") | ~F.col("first"), F.lit(SYMBOLS[0])).when(F.col("cut"), F.upper("_role")).otherwise(F.col("_role"))
        each = known.withColumn("_role", role).select("conv_id", F.shiftright("pos", BLOCK_BITS).alias("block"), F.struct("pos", "turn", "role", "digest", symbol.alias("symbol"), F.col("_role").alias("initial"), "n", "blank", "first").alias("row"))
        pieces = each.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("row")).alias("rows"))  # at most a block's rows
        every = lambda name: F.transform("rows", lambda x: x[name])
        total = lambda value: F.aggregate("rows", F.lit(0).cast("long"), lambda sum_, x: sum_ + value(x))
        pieces = pieces.withColumns({"roles": F.array_join(every("initial"), ""), "symbols": F.array_join(every("symbol"), ""), "n": every("n"), "turns": F.filter(every("turn"), lambda t: t.isNotNull())})
        lawful = F.expr("size(filter(sequence(1, length(roles)), i -> substr(roles, i, 2) in ('su', 'ua', 'au')))")
        pieces = pieces.select(
            "conv_id",
            "block",
            *[F.col("rows")[0][c].alias(c) for c in ("turn", "role", "digest")],
            "symbols",
            "n",
            total(lambda x: F.when(x["blank"], x["n"]).otherwise(0)).alias("blank"),
            total(lambda x: F.when(x["blank"], 0).otherwise(x["n"] - x["first"].cast("long"))).alias("duplicate"),
            F.length(F.regexp_replace("symbols", "[a-z]", "")).cast("long").alias("truncated"),
            # equal rows side by side have equal initials, which no two neighbours may have
            (total(lambda x: x["n"]) - 1 - lawful).alias("illegal"),
            F.left("roles", F.lit(1)).alias("first_role"),
            F.right("roles", F.lit(1)).alias("last_role"),
            F.array_min("turns").alias("low"),
            F.array_max("turns").alias("high"),
            F.size(F.array_distinct("turns")).cast("long").alias("turns"),
        )
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name not in ("symbols", "n"))
        pieces = pieces.mapInArrow(_pieces, f"{schema}, costs array<long>, ways array<string>").repartition("conv_id").sortWithinPartitions("conv_id", "block")
        chosen = pieces.mapInArrow(_walked(arrow), f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, digest binary, state int, letters string, numbers array<long>, audit string")
        chosen = scratch.written(chosen)
        begins = df.groupBy("conv_id").agg(F.lit(0).alias("part"))
        letters_ = chosen.withColumns({"part": F.lit(1), "kind": F.lit(0)})
        texts = rows.withColumns({"digest": F.unhex(F.sha2("text", 256)), "part": F.lit(1), "kind": F.lit(1)})
        stream = texts.unionByName(letters_, allowMissingColumns=True).unionByName(begins, allowMissingColumns=True)
        stream = stream.repartition("conv_id").sortWithinPartitions("conv_id", "part", *order[1:], "kind")
        return written(stream.mapInArrow(_repaired(arrow[0]), f"conv_id {kinds['conv_id']}, {RESULT}"))
