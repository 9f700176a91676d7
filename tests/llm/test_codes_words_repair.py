"""Vector codes, word-level BPE and conversation repair against brute force, on small tables with every odd case in them."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factorlab.llm import dialog_repair, vector_codes, word_bpe
from factorlab.llm.dialog_repair import repair_conversations
from factorlab.llm.repair_grammar import SYMBOLS, Grammar, Walk, letters
from factorlab.llm.vector_codes import Book, compress_vectors
from factorlab.llm.word_bpe import WordBpe, build_lexicon, encode_words
from factorlab.llm.word_lexicon import Lexicon, compiled

WORDS = public_tokenizers.path("word_bpe_49k.json")

# -- conversation repair


def lawful(roles: str) -> bool:
    return roles == "" or (roles.removeprefix("s") != "" and roles.removeprefix("s") == "ua" * (len(roles.removeprefix("s")) // 2))


def every_repair(symbols: str) -> tuple[int, str]:
    """The least cost and letters of all ways with at most two insertions in a place."""
    found = []
    puts = ["", "u", "a", "ua", "au"]
    for choice in itertools.product(*[[("D", "", 4)] + ([] if s == "x" else [("K", s.lower(), 3 * s.isupper()), ("R", "u", 3 + 3 * s.isupper()), ("R", "a", 3 + 3 * s.isupper())]) for s in symbols]):
        for put in itertools.product(puts, repeat=len(symbols) + 1):
            roles = "".join(p + c[1] for p, c in zip(put, choice)) + put[-1]
            if lawful(roles):
                found.append((sum(c[2] for c in choice) + 3 * sum(map(len, put)), "".join("I" * len(p) + c[0] for p, c in zip(put, choice)) + "I" * len(put[-1])))
    return min(found)


def walked(symbols: str, cuts: list[int] | None = None) -> tuple[int, str]:
    parts = [symbols[a:b] for a, b in itertools.pairwise([0, *(cuts or []), len(symbols)])]
    of, walk = Grammar().matrices_of(parts), Walk()
    for p in parts:
        walk.step([None if w is None else (w[0], letters(w[1])) for w in of[p]])
    cost, pieces = walk.end()
    return cost, "".join(t for _, t in pieces)


def test_repairs_are_the_cheapest_and_least():
    r = random.Random(1)
    for n in (1, 2):
        for s in itertools.product(SYMBOLS, repeat=n):
            assert walked("".join(s)) == every_repair("".join(s))
    for _ in range(60):
        s = "".join(r.choice(SYMBOLS) for _ in range(3))
        assert walked(s) == every_repair(s)


def plain_repair(symbols: str) -> tuple[int, str]:
    best = {"0": (0, "")}
    after = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("A", "u"): "U", ("U", "a"): "A"}

    def least(ways):
        out = {}
        for q, w in ways:
            out[q] = min(out.get(q, w), w)
        return out

    def inserted(best):
        for _ in range(3):
            best = least([*best.items(), *[(q, (c + 3, t + "I")) for p, (c, t) in best.items() for q in [after.get((p, "u")), after.get((p, "a"))] if q]])
        return best

    for s in symbols:
        ways = []
        for p, (c, t) in inserted(best).items():
            ways.append((p, (c + 4, t + "D")))
            for role, letter, cost in [] if s == "x" else [(s.lower(), "K", 0), ("u", "R", 3), ("a", "R", 3)]:
                if (p, role) in after:
                    ways.append((after[p, role], (c + cost + 3 * s.isupper(), t + letter)))
        best = least(ways)
    return min([w for q, w in inserted(best).items() if q in "0A"])


def test_pieces_and_grammar_change_nothing():
    r = random.Random(2)
    for _ in range(150):
        s = "".join(r.choice("uauauaxoSs" if r.random() < 0.5 else SYMBOLS) for _ in range(r.randrange(1, 60)))
        assert walked(s) == walked(s, sorted(r.sample(range(1, len(s)), min(len(s) - 1, 3)))) == plain_repair(s)
    many = ["".join(r.choice("ua") for _ in range(40)) for _ in range(50)] + ["ua" * 100, "x" * 33, "u" * 64]
    g = Grammar()
    of = g.matrices_of(many)
    assert len(g.rule) < sum(map(len, many)) / 3  # shared
    for s in many:
        walk = Walk()
        walk.step([None if w is None else (w[0], letters(w[1])) for w in of[s]])
        assert (walk.end()[0], "".join(t for _, t in walk.end()[1])) == plain_repair(s)


def plain_conversation(rows: list[tuple]) -> tuple:
    """Numbers and digests of one conversation's rows (conv_id, turn, role, text)."""
    out = []
    blanks = " \t\n\x0b\x0c\r"
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = {1: "", 2: "".join(c for c in text if c not in ".!?")}.get(kind, text)
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.sha256(x[2].encode()).digest()))
    seen, symbols, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for turn, role, text in out:
        shown = text.rstrip(blanks)
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        own = role[:1] if role[:1] in ("s", "u", "a") else "o"
        symbols += "x" if fault in ("blank", "duplicate") else own.upper() if fault else own
    cost, audit = plain_repair(symbols) if symbols else (0, "")
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(out))
    turns = [t for t, _, _ in out if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    lines, left = [], iter(out)
    size = sum(x != "D" for x in audit)
    for x in audit:
        row = next(left) if x != "I" else None
        if x != "D":
            must = "assistant" if (size - len(lines)) % 2 else "user"
            lines.append(f"{row[1] if x == 'K' else must}:{row[2] if row else ''}")
    return (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


CONVERSATIONS = "conv_id long, turn long, role string, text string, n int, block string, part long, digest string, state int"


def conversation_rows() -> list[tuple]:
    r = random.Random(3)
    texts = ["Yes.", "No", "what?", "", None, " \x0b\x0c\t", "ends in blanks. \n\t ", "é!", "x" * 3000, "a\nb."]
    out = []
    for conv in [None, *range(40)]:
        for k in range(r.randrange(1, 12)):
            out.append((conv, r.choice([None, k, k, k, k * 3, 2]), r.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "ueser"]), r.choice(texts)))
    out += [(99, k, ["user", "assistant"][k % 2], f"row {k}." if k % 7 else "again.") for k in range(900)]  # more than a block
    out += [(98, 5, "user", "equal rows.")] * 700
    out += [(97, k, "user", "a") for k in range(2000) if zlib.crc32(f"97:{k}".encode()) % 20 == 0]  # nothing is left
    return [(*x, 1, "b", 2, "d", 3) for x in out]


def test_repair(spark, monkeypatch):
    rows = conversation_rows()
    monkeypatch.setattr(dialog_repair, "BLOCK_BITS", 5)
    found = {r["conv_id"]: tuple(r)[1:] for r in repair_conversations(spark.createDataFrame(rows, CONVERSATIONS).repartition(5)).collect()}
    by = {c: [x[:4] for x in rows if x[0] == c] for c in {x[0] for x in rows}}
    assert found == {c: plain_conversation(v) for c, v in by.items()}
    assert found[97] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair_conversations(spark.createDataFrame([], CONVERSATIONS)).count() == 0


# -- word-level BPE


def looked_up(lexicon: Lexicon, words: list[bytes]) -> list[tuple | None]:
    there, count, ids = lexicon.ids(words)
    return [tuple(x.tolist()) if t else None for t, x in zip(there, np.split(ids, np.cumsum(count)[:-1]))]


def test_lexicon_holds_words_and_no_others(tmp_path):
    r = random.Random(5)
    words = sorted({bytes(r.choice(b"abcd\xff\x00") for _ in range(r.randrange(1, 7))) for _ in range(3000)})
    of = {w: tuple(r.randrange(5) for _ in range(r.randrange(1, 4))) for w in words if r.random() < 0.6}
    for table in (of, {}, {b"a": (7,)}):
        path = tmp_path / f"{len(table)}"
        path.write_bytes(compiled(sorted(table.items())))
        assert looked_up(Lexicon(str(path)), [*words, b"", b"zz"]) == [table.get(w) for w in [*words, b"", b"zz"]]
    # minimal: equal ends are one
    path = tmp_path / "ends"
    path.write_bytes(compiled([(x + b"ingly", (1,)) for x in (b"a", b"b", b"c", b"d")]))
    assert len(Lexicon(str(path)).edge) == 4 + 5
    with pytest.raises(ValueError):
        compiled([(b"b", (1,)), (b"a", (1,))])


ODD = "aA bB'sSΣσİé́ \n\t0١<|>!?中国😀Ᲊ՘\x1c\x85‍ͅǅß'tEndoftext\xa0"


def word_rows() -> list[tuple]:
    r = random.Random(6)
    texts = [None, "", " \n ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|", "it's IT'S we'Ll", "ab" * 4000 + "é" * 500, "ΑΣ ΣΑ. Σ", "x" * 100_000, "é <|endoftext|>́", "\x1c\x1d a\x1fb", "the the the the of"]
    texts += ["".join(r.choice(ODD) for _ in range(r.randrange(60))) for _ in range(150)]
    out = [(k, t, 1, "u", "i") for k, t in enumerate(texts)]
    return [*out, out[5], (None, "null id", 1, "u", "i")]


@pytest.mark.parametrize("share", [word_bpe.LEXICON, 20])
def test_words_are_the_librarys(spark, share):
    rows = word_rows()
    t = Tokenizer.from_file(WORDS)
    t.no_truncation(), t.no_padding()
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, word string, ids string").repartition(3)
    found = sorted(map(tuple, encode_words(df, WORDS, with_ids=True, share=share).collect()), key=str)
    want = []
    for d, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        shown = t.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest(), ids, shown))
    assert found == sorted(want, key=str)
    assert encode_words(spark.createDataFrame([], df.schema), WORDS).count() == 0


def test_frequent_words_come_from_the_lexicon(spark):
    df = spark.createDataFrame([(1, "one two two three three three " + "x" * 90)], "doc_id long, text string")
    path = build_lexicon(df, WORDS, 3)  # seven words: those found three times or more
    bpe = WordBpe(WORDS)
    assert looked_up(Lexicon(path), [b"one", b"two", b"three", b"x" * 90]) == [None, None, bpe.merged(b"three"), None]


def test_long_words_merge_alike(monkeypatch):
    bpe, r = WordBpe(WORDS), random.Random(7)
    words = [bytes(r.choice(b"aehinrst") for _ in range(r.randrange(1, 80))) for _ in range(300)]
    short = []
    for limit in (10_000, 0):
        monkeypatch.setattr(word_bpe, "LONG", limit)
        short.append([bpe.merged(w) for w in words])
    assert short[0] == short[1]
    count, ids = bpe.merged_together(words)
    assert [tuple(x.tolist()) for x in np.split(ids, np.cumsum(count)[:-1])] == short[0]


# -- vector codes


@pytest.mark.parametrize("width, size", [(1, 3), (3, 40), (16, 1 << 12), (4, 1 << 24)])
def test_search_is_exact(width, size):
    r = np.random.default_rng(width)
    entries = r.integers(-size, size, (r.integers(2, 256), width))
    entries[len(entries) // 2 :] = entries[: len(entries) - len(entries) // 2]  # ties go to the lower index
    parts = np.concatenate([r.integers(-size, size, (2500, width)), entries])
    code, error = Book(entries).nearest(parts)
    every = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (code == every.argmin(axis=1)).all() and (error == every.min(axis=1)).all()


def test_search_leaves_entries_out(monkeypatch):
    r = np.random.default_rng(0)
    centre = r.integers(-3000, 3000, (256, 16))
    looked = []
    whole = Book._outward
    monkeypatch.setattr(vector_codes, "BLOCK", 32)

    class Counting(np.ndarray):
        def __matmul__(self, other):
            looked.append(len(self) * other.shape[1])
            return np.asarray(self) @ np.asarray(other)

    monkeypatch.setattr(Book, "_outward", lambda self, x, *rest: whole(self, x.view(Counting), *rest))
    parts = centre[r.integers(0, 256, 3000)] + r.integers(-20, 20, (3000, 16))
    Book(centre).nearest(parts)
    assert sum(looked) < 0.3 * len(parts) * len(centre)


def plain_codes(rows: list[tuple]) -> list[tuple]:
    kept = [(v, lab, [max(-(1 << 25), min(1 << 25, math.floor(1024 * max(-1e9, min(1e9, x))))) for x in vec]) for v, vec, lab, *_ in rows if vec is not None and all(x is not None and math.isfinite(x) for x in vec)]
    if not kept:
        return []
    width = max(1, -(-max(len(x[2]) for x in kept) // 4))
    full = [x[2] + [0] * (4 * width - len(x[2])) for x in kept]
    start = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][2]))[:256]
    books = [[full[k][p * width : (p + 1) * width] for k in start] for p in range(4)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))
    for _ in range(4):
        for p in range(4):
            own = [near(x[p * width : (p + 1) * width], books[p])[1] for x in full]
            for k in set(own):
                of = [x[p * width : (p + 1) * width] for x, o in zip(full, own) if o == k]
                books[p][k] = [sum(c) // len(of) for c in zip(*of)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[near(x[p * width : (p + 1) * width], books[p]) for p in range(4)] for x in full]
    errors = [sum(d for d, _ in f) for f in found]
    total = lambda lab: sum(e for e, x in zip(errors, kept) if x[1] == lab)
    return [(x[0], x[1], "".join(f"{k:02x}" for _, k in f), e, total(x[1]), digest) for x, f, e in zip(kept, found, errors)]


VECTORS = "vec_id long, embedding array<float>, label int, v string, error double, part int"


def vector_rows(n: int, width: int = 8) -> list[tuple]:
    r = random.Random(n)
    out = [(k, [r.gauss(r.choice([-1, 0, 1]), 0.2) for _ in range(width)], r.choice([None, 1, 1, 2])) for k in range(n)]
    out += [out[0], (None, [0.5] * width, 3), (3, [0.25] * width, None)]
    odd = [None, [], [None] * width, [1.0, None], [float("nan")] * width, [float("inf")] + [0.0] * (width - 1), [1.0] * (width - 3), [0.0] * width, [3e38] * width]
    out += [(10_000 + k, v, 1) for k, v in enumerate(odd)]
    r.shuffle(out)
    return [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab, "v", 1.0, 2) for k, v, lab in out]


@pytest.mark.parametrize("n, width", [(1, 8), (5, 8), (290, 8), (20, 3)])
def test_codes(spark, n, width):
    rows = vector_rows(n, width)
    found = compress_vectors(spark.createDataFrame(rows, VECTORS).repartition(3)).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain_codes(rows), key=str)


def test_no_vectors(spark):
    assert compress_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    assert compress_vectors(spark.createDataFrame([(1, None, 1, "", 0.0, 1)], VECTORS)).count() == 0


def test_one_label_of_most_rows_is_one_row_of_the_sums(spark):
    df = spark.createDataFrame([(k, [float(k % 7)] * 4, None if k % 3 else k) for k in range(400)], "vec_id long, embedding array<float>, label int")
    found = compress_vectors(df)
    sums = {r["label"]: r["s"] for r in found.groupBy("label").agg(F.sum("error").alias("s")).collect()}
    assert all(r["label_error"] == sums[r["label"]] for r in found.collect())
