"""BPE encoding and decoding with word ends: a lexicon of frequent words as a minimal acyclic transducer, exact merges for all others.

The corpus's words are counted, and those that are at least one in LEXICON of all words are compiled with their ids into the transducer
(there can't be more than LEXICON of them). Its file lies in the shared folder; Spark hands it to each executor, which maps it into
memory. A batch's distinct words walk it together; those that it hasn't are merged by rank, the leftmost pair first.

Words are what the vocabulary file's own pattern finds in normalised lower-case text. Code points that Python's Unicode tables don't know
yet are split as the tokenizers library's newer tables say.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Scratch, shared_dir, sliced, store_of
from .word_lexicon import Lexicon, compiled

#: A word of the lexicon is at least one in so many words of the corpus; and it has at most so many bytes.
LEXICON, WORD_BYTES = 200_000, 64
#: Chunks and words that a task keeps with their ids before it starts anew, chunks that it counts before it hands them on, and the bytes of
#: text in a step.
KEPT, COUNTED, STEP = 300_000, 400_000, 4 << 20
#: Symbols in a word from which on merges go by a heap; the widest words of the arrays that merge in step, and their rows.
LONG, WIDTHS, BLOCK = 48, (4, 6, 8, 10, 12, 16, 24, 40), 8192
NONE = 1 << 40

#: Parts of a text, in order: what is between white space, or the id of a special token.
Unit = str | int


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printable Latin-1, else one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class WordBpe:
    """Splits texts and merges words as the file of a tokenizer of the tokenizers library says."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, normalizers, splitters = spec["model"], spec["normalizer"]["normalizers"], spec["pre_tokenizer"]["pretokenizers"]
        shape = [x["type"] for x in normalizers + splitters]
        plain = not any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not plain or not model["end_of_word_suffix"] or shape != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] or spec["decoder"] or spec["post_processor"] or any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError("this codec needs byte-level BPE with word ends, on normalised lower-case text")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.n = 1 + max([*vocab.values(), *[x["id"] for x in spec["added_tokens"]]])
        self.token = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.letters = _byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        self.inner, self.last = [vocab[c] for c in self.letters], [vocab[c + end] for c in self.letters]
        #: pair of ids, as one number -> rank, merged id
        self.pair: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pair[vocab[a] * self.n + vocab[b]] = (rank, vocab[a + b])
        self.keys = np.array(sorted(self.pair), dtype=np.int64)
        self.ranks = np.array([self.pair[k][0] for k in self.keys.tolist()], dtype=np.int64)
        self.made = np.array([new for _, new in sorted(self.pair.values())], dtype=np.int64)
        self.spaced = np.array([self.token.get(i, "") + " " for i in range(self.n)], dtype=object)
        self.word = regex.compile(splitters[0]["pattern"]["Regex"])
        self.line = regex.compile(splitters[0]["pattern"]["Regex"] + "|\n")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.unassigned = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])
        self.space, self.controls = regex.compile(r"\s+"), re.compile("[\x1c-\x1f]")
        self.path, self.library = path, None

    def _unknown(self, text: str) -> bool:
        """Whether a text has code points that Python's Unicode tables don't know."""
        return not text.isascii() and bool(self.unassigned[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)].any())

    def words(self, chunk: str) -> list[str]:
        """The words of a text without special tokens."""
        if self._unknown(chunk):
            if self.library is None:
                self.library = Tokenizer.from_file(self.path)
            found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))
            return [bytes(self.byte_of[c] for c in w).decode() for w, _ in found]
        chunk = unicodedata.normalize("NFC", chunk)
        # lower case letter by letter: Python's own looks at the neighbours of a capital sigma
        return self.word.findall("".join(map(str.lower, chunk)) if "Σ" in chunk else chunk.lower())

    def words_of(self, chunks: list[str]) -> list[list[str]]:
        """The words of each chunk; chunks have no white space, so all are split as the lines of one text."""
        text = "\n".join(chunks)
        if self._unknown(text):
            return [self.words(c) for c in chunks]
        text = unicodedata.normalize("NFC", text)
        found = self.line.findall("".join(map(str.lower, text)) if "Σ" in text else text.lower())
        ends = [k for k, w in enumerate(found) if w == "\n"]
        return [found[a:b] for a, b in zip([0, *[k + 1 for k in ends]], [*ends, len(found)])] if chunks else []

    def units(self, text: str) -> list[Unit]:
        """A text's chunks between white space, and special tokens. No word and no composed letter goes over white space."""
        parts = self.cut.split(text) if self.cut and any(x in text for x in self.special) else [text]
        out: list[Unit] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special[part])
            else:  # str.split also takes four control characters for white space
                out += self.space.split(part) if self.controls.search(part) else part.split()
        return out

    def merged(self, word: bytes) -> tuple[int, ...]:
        """The ids of a word by merges alone: the pair of the lowest rank first, the leftmost of equal ones."""
        ids = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        if len(ids) > LONG:
            return self._by_heap(ids)
        pair, n = self.pair, self.n
        none = (1 << 60, 0)
        ranks = [pair.get(a * n + b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            k = ranks.index(best)
            ids[k : k + 2] = [best[1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = pair.get(ids[k] * n + ids[k + 1], none)
            if k:
                ranks[k - 1] = pair.get(ids[k - 1] * n + ids[k], none)
        return tuple(ids)

    def merged_together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has by merges alone, and all words' ids behind one another. Short words are rows of one array and merge in step."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        count, found = np.zeros(len(words), np.int64), []
        for low, high in pairwise((0, *WIDTHS)):
            of = np.flatnonzero((size > low) & (size <= high))
            for a in range(0, len(of), BLOCK):
                rows = of[a : a + BLOCK]
                ids, n = self._in_step([words[k] for k in rows.tolist()], high)
                count[rows] = n
                found.append((rows, n, ids))
        for k in np.flatnonzero(size > WIDTHS[-1]).tolist():
            ids = np.array(self.merged(words[k]), dtype=np.uint32)
            count[k] = len(ids)
            found.append((np.array([k]), count[[k]], ids))
        start = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.uint32)
        for rows, n, ids in found:
            out[np.repeat(start[rows] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return count, out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = np.where((left < 0) | (right < 0), -1, left * self.n + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def _in_step(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(w) for w in words])
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width)
        column = np.arange(width)
        ids = np.where(column < size[:, None], np.array(self.inner)[text], -1)
        every = np.arange(len(words))
        ids[every, size - 1] = np.array(self.last)[text[every, size - 1]]
        rank = np.full((len(words), width), NONE)
        rank[:, :-1] = self._rank(ids[:, :-1], ids[:, 1:])
        done = np.full((len(words), width), -1)
        live = every
        while True:
            k = rank.argmin(axis=1)
            best = rank[np.arange(len(live)), k]
            on = best < NONE
            done[live[~on]] = ids[~on]
            live, ids, rank, k, best = live[on], ids[on], rank[on], k[on], best[on]
            if not len(live):
                break
            behind = column > k[:, None]
            ids = np.where(behind, np.pad(ids[:, 1:], ((0, 0), (0, 1)), constant_values=-1), ids)
            rank = np.where(behind, np.pad(rank[:, 1:], ((0, 0), (0, 1)), constant_values=NONE), rank)
            row = np.arange(len(live))
            new = ids[row, k] = self.made[best]
            rank[row, k] = self._rank(new, np.where(k + 1 < width, ids[row, np.minimum(k + 1, width - 1)], -1))
            some = row[k > 0]
            rank[some, k[some] - 1] = self._rank(ids[some, k[some] - 1], new[some])
        there = done >= 0
        return done[there].astype(np.uint32), there.sum(axis=1)

    def _by_heap(self, ids: list[int]) -> tuple[int, ...]:
        n, pair = self.n, self.pair
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(*pair[x], k) for k, x in ((k, a * n + b) for k, (a, b) in enumerate(zip(ids, ids[1:]))) if x in pair]
        heap = [(rank, k, new) for rank, new, k in heap]
        heapq.heapify(heap)
        while heap:
            _, k, new = heapq.heappop(heap)
            right = after[k]
            if ids[k] < 0 or right < 0 or pair.get(ids[k] * n + ids[right], (0, -1))[1] != new:
                continue  # one of the two has been merged since
            ids[k], ids[right] = new, -1
            after[k] = after[right]
            if after[right] >= 0:
                before[after[right]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and ids[a] * n + ids[b] in pair:
                    rank, made = pair[ids[a] * n + ids[b]]
                    heapq.heappush(heap, (rank, a, made))
        return tuple(x for x in ids if x >= 0)


class Coder:
    """Ids of chunks, whose words are in the lexicon or merged, as far as they are kept."""

    def __init__(self, bpe: WordBpe, lexicon: Lexicon | None) -> None:
        self.bpe, self.lexicon = bpe, lexicon
        #: Ids, as little-endian 32-bit numbers, of chunks and of words.
        self.ids: dict[Unit, bytes] = {}
        self.word_ids: dict[str, bytes] = {}

    def learn(self, units: set[Unit]) -> None:
        if len(self.ids) + len(self.word_ids) > KEPT:
            self.ids, self.word_ids = {}, {}
        new = [u for u in units if u not in self.ids]
        self.ids.update((u, u.to_bytes(4, "little")) for u in new if isinstance(u, int))
        new = [u for u in new if isinstance(u, str)]
        split = self.bpe.words_of(new)
        known = self.word_ids
        self._learn_words(list(set(chain.from_iterable(split)).difference(known)))
        self.ids.update((unit, known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])) for unit, words in zip(new, split))

    def _learn_words(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        if self.lexicon:
            there, count, ids = self.lexicon.ids([w if len(w) <= WORD_BYTES else b"" for w in raw])
            self._keep([w for w, t in zip(words, there.tolist()) if t], count[there], ids)
            others = np.flatnonzero(~there).tolist()
        else:
            others = range(len(words))
        self._keep([words[k] for k in others], *self.bpe.merged_together([raw[k] for k in others]))

    def _keep(self, words: list[str], count: np.ndarray, ids: np.ndarray) -> None:
        data = ids.astype("<u4").tobytes()
        ends = (4 * np.cumsum(count)).tolist()
        self.word_ids.update((word, data[a:b]) for word, a, b in zip(words, [0, *ends], ends))

    def text_ids(self, units: list[Unit]) -> bytes:
        return b"".join(map(self.ids.__getitem__, units))

    def shown(self, ids: bytes) -> str:
        """The tokens with a space between each two."""
        return "".join(self.bpe.spaced[np.frombuffer(ids, "<u4")].tolist())[:-1]


def _counted(path: str):
    """For mapInArrow: words that may enter the lexicon, with their counts; and all others as one."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, chunks = WordBpe(path), Counter()

        def flush() -> pa.RecordBatch:
            words: dict[str | None, int] = {}
            for found, n in zip(bpe.words_of(list(chunks)), chunks.values()):
                for w in found:
                    w = w if len(w) <= WORD_BYTES and len(w.encode()) <= WORD_BYTES else None
                    words[w] = words.get(w, 0) + n
            rows = list(words.items())
            chunks.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])

        for batch in sliced(batches, "text", STEP):
            for text in batch.column("text").to_pylist():
                chunks.update(bpe.units(text or ""))
                if len(chunks) > COUNTED:
                    for i in bpe.special.values():
                        del chunks[i]
                    yield flush()
        for i in bpe.special.values():
            del chunks[i]
        if chunks:
            yield flush()

    return f


def build_lexicon(docs: DataFrame, path: str, share: int = LEXICON) -> str:
    """Path, in the shared folder, of the transducer of all words that are at least one in `share` of the words of the texts."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        counts = scratch.written(docs.select("text").mapInArrow(_counted(path), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
        total = counts.agg(F.sum("n")).first()[0] or 0
        # at most `share` words of at most WORD_BYTES bytes
        often = [r["word"] for r in counts.filter(F.col("word").isNotNull() & (F.col("n") * share >= total)).select("word").collect()]
    bpe = WordBpe(path)
    data = compiled((w, bpe.merged(w)) for w in sorted(w.encode() for w in often))
    place = f"{shared_dir(spark)}/lexicon-{uuid.uuid4().hex}"
    store, at = store_of(place)
    with store.open_output_stream(at) as f:
        f.write(data)
    return place


def _encoded(path: str, lexicon: str, with_ids: bool):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(path)
        coder = Coder(bpe, Lexicon(SparkFiles.get(lexicon)))
        for batch in sliced(batches, "text", STEP):
            split = [bpe.units(t or "") for t in batch.column("text").to_pylist()]
            coder.learn({u for units in split for u in units})
            ids = [coder.text_ids(units) for units in split]
            shown = [coder.shown(x) for x in ids]
            named = {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in shown], pa.string())}
            if with_ids:
                named |= {"ids": pa.array([memoryview(x).cast("I").tolist() for x in ids], pa.list_(pa.int64())), "decoded": pa.array(shown, pa.string())}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *named.values()], ["doc_id", *named])

    return f


def encode_words(docs: DataFrame, path: str, with_ids: bool = False, share: int = LEXICON) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256; with_ids: also ids and decoded, the tokens
    with a space between each two.

    A row is encoded for itself, whatever its doc_id; a null or empty text has no tokens. Strings of special tokens in a text are those
    tokens. Other columns are not looked at; an empty table gives an empty result. A text's chunks are in memory while it is encoded.
    """
    lexicon = build_lexicon(docs, path, share)
    docs.sparkSession.sparkContext.addFile(lexicon)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(_encoded(path, lexicon.rsplit("/", 1)[1], with_ids), schema)
