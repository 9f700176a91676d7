"""The training-data operators against brute force, on small tables with every odd case in them."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from factorlab.llm import fm_classifier, induced_sorting, jaccard_join, media_ts, mixing, quality_rules, suffix_dedup, token_counts, url_filter, warc
from factorlab.llm.components import components
from factorlab.llm.jaccard_join import block_links, link_components, trie
from factorlab.llm.mixing import apportion, mix_sources
from factorlab.llm.quality_rules import judge
from factorlab.llm.queries import QUERIES
from factorlab.llm.sentencepiece_codec import Codec, encode_decode
from factorlab.llm.suffix_dedup import removal_digest, remove_repeats
from factorlab.llm.url_filter import RULES, Splitter, judge_urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, cls long, n int, h string, a long, size string"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def prose(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(["th", "er", "on", "an", "re", "é", "ß"]) for _ in range(r.randrange(1, 5))) for _ in range(n))


def rows() -> list[tuple]:
    """Null and empty texts, one word, exact and near copies, a shared passage, repeated lines, odd characters, a long word, equal rows."""
    r = random.Random(4)
    base, passage = prose(r, 200), prose(r, 90)
    near = base.split()
    near[100] = "changed"
    texts = [None, "", " \n\t ", "word", "Two WORDS", base, base, " ".join(near), base.upper(), f"{prose(r, 80)} {passage} {prose(r, 80)}", f"{prose(r, 70)} {passage}", "same line here\n" * 60, "x" * 5000, "a b c " * 300, "é漢😀\x00\r\n<unk> ▁▁x", passage, "%%% $$$ ### " * 60, "ÀÉ ab cd ef gh ij", "àÉ ab cd ef gh ij"]
    texts += [prose(r, r.randrange(1, 300)) for _ in range(30)]
    sources = [None, "b", "a", "Z", "é"]
    # the columns after n_chars are the caller's own and clash with names that the operators use
    out = [(k, t, ["en", None, "fr"][k % 3], sources[k % 5], None if t is None else len(t), 7, 1, "h", 0, "s") for k, t in enumerate(texts)]
    return [*out, out[5]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCUMENTS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


# -- 1


def test_mixing(docs, none):
    got = mix_sources(docs).collect()
    assert len(got) == len(rows())
    want = Counter()
    for _, text, _, source, *_ in rows():
        want[source] += len(words(text))
    assert {r["source"]: r["source_size"] for r in got} == dict(want)
    order = sorted((s for s in want if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target = dict.fromkeys(want, 0.0)
    free, left = set(want), float(sum(want.values()))
    while free:  # share by weight, take out those above their cap, again
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * want[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * want[s]
            left -= target[s]
        free -= over
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in want:
        assert abs(taken[s] - target[s]) <= 70
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(docs.repartition(5)).collect()))
    assert mix_sources(none).count() == 0


def test_mixing_of_equal_rows_and_many_shards(spark, monkeypatch):
    """Thousands of equal rows without ids fill all shards of their source, whose shards are apportioned part by part."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1 << 9)
    monkeypatch.setattr(mixing, "SHARDS", 8)
    monkeypatch.setattr(mixing, "CHUNK", 100)
    r = random.Random(9)
    table = [(None, "a b c d", "a")] * 5000 + [(k, prose(r, r.randrange(0, 60)), [None, "a", "b", "c"][k % 4]) for k in range(600)]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string").repartition(5)
    shards = mixing.plan(docs).filter("source = 'a' and size > 0").groupBy("_shard").agg(F.sum("size").alias("n")).collect()
    assert len(shards) == -(-sum(len(words(t)) for _, t, s in table if s == "a") // 512) > 8
    assert max(x["n"] for x in shards) < 2 * 512
    got = mix_sources(docs).collect()
    assert Counter((x["doc_id"], x["source"], x["size"]) for x in got) == Counter((k, s, len(words(t))) for k, t, s in table)
    for s in (None, "a", "b", "c"):
        own = [x for x in got if x["source"] == s]
        assert abs(sum(x["taken"] for x in own) - own[0]["target"]) <= 70
        assert all(x["taken"] <= 3 * x["size"] for x in own)
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(docs.repartition(2)).collect()))


def test_apportionment_is_by_highest_quotients(spark):
    r = random.Random(2)
    for _ in range(6):
        votes, seats = [r.randrange(0, 400) for _ in range(7)], r.randrange(1, 60)
        df = spark.createDataFrame([(str(k), float(v), seats) for k, v in enumerate(votes)], "p string, v double, s long")
        got = {int(x["p"]): x["n"] for x in apportion(df, [], "v", "s", "n", ["p"]).collect()}
        best = sorted(((-v / (2 * k + 1), str(p), k) for p, v in enumerate(votes) if v for k in range(seats)))[:seats]
        assert got == {p: sum(x[1] == str(p) for x in best) for p in range(7)}


# -- 2


def test_sentencepiece_is_the_library(docs, none):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {(r["doc_id"], r["ids_sha256"]): r for r in encode_decode(docs, MODEL, with_ids=True).collect()}
    for doc_id, text, *_ in rows():
        ids = library.encode(text or "")
        r = got[doc_id, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert encode_decode(none, MODEL).count() == 0


def test_codec_on_odd_texts():
    own, r = Codec(MODEL), random.Random(1)
    odd = ["", " ", "  ", "\n", " \n ", "a  b", "▁a▁▁b", "ab" * 3000 + " é", "</s> <unk> <0x0A>", "trailing   ", "====" * 50, ");\r\n {\r"]
    odd += ["".join(r.choice("ab \n▁é漢the(){};\r\t") for _ in range(r.randrange(80))) for _ in range(500)]
    assert [own.ids(x) for x in odd] == own.library.encode(odd)


# -- 3


def covered(texts: list[bytes], size: int) -> list[np.ndarray]:
    count = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if count[t[i : i + size]] > 1:
                mask[i : i + size] = True
        out.append(mask)
    return out


@pytest.mark.parametrize(("size", "gram"), [(400, 200), (40, 12)])
def test_suffix_dedup(docs, none, size, gram):
    texts = [(r[1] or "").encode() for r in rows()]
    want = []
    for (doc_id, *_), t, mask in zip(rows(), texts, covered(texts, size), strict=True):
        kept = bytes(np.frombuffer(t, np.uint8)[~mask])
        want.append((doc_id, len(t), int(mask.sum()), int((np.diff(mask.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert sorted(tuple(r) for r in removal_digest(docs, size, gram).collect()) == sorted(want)
    cut = remove_repeats(docs, size, gram)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    assert removal_digest(none, size, gram).count() == 0


def test_suffix_dedup_of_null_ids(spark):
    r = random.Random(12)
    passage, whole = prose(r, 90), prose(r, 150)
    table = [(None, f"{prose(r, 60)} {passage} {prose(r, 60)}"), (1, f"{prose(r, 60)} {passage} {prose(r, 60)}"), (None, f"{prose(r, 80)} {whole}"), (None, whole), (2, whole), (3, f"{whole} {prose(r, 40)}"), (3, f"{prose(r, 30)} {passage}"), (None, None)]
    texts = [(t or "").encode() for _, t in table]
    want = [(k, len(t), int(mask.sum())) for (k, _), t, mask in zip(table, texts, covered(texts, 400), strict=True)]
    got = [(x["doc_id"], x["n_bytes"], x["n_removed"]) for x in removal_digest(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()]
    assert Counter(got) == Counter(want)


@pytest.mark.parametrize("limits", [{}, {"STEP": 3, "QUEUED": 5}, {"IN_MEMORY": 2, "STEP": 7, "QUEUED": 9, "RESIDENT": 10}])
def test_induced_sorting(monkeypatch, limits):
    """Small limits put queues and arrays on disk and make names recurse."""
    for k, v in limits.items():
        monkeypatch.setattr(induced_sorting, k, v)
    r = random.Random(3)
    for _ in range(150):
        alphabet = r.choice([b"ab", b"abc", b"\x00\xff", bytes(range(256))])
        b = bytes(r.choice(alphabet) for _ in range(r.randrange(1, 60)))
        b = r.choice([b, b + b"\xff" + b, bytes([b[0]]) * len(b)])
        cap = r.choice([1, 2, 5, 17, 400])
        found = []
        induced_sorting.each_suffix(np.frombuffer(b, np.uint8), cap, lambda p, n: found.append((p, n)))
        place, prefix = (np.concatenate([x[k] for x in found]).tolist() for k in (0, 1))
        assert sorted(place) == list(range(len(b)))
        for (p, q), n in zip(itertools.pairwise(place), prefix[1:], strict=True):
            x, y = b[p : p + cap], b[q : q + cap]
            assert x >= y
            assert n == next((k for k, (s, t) in enumerate(zip(x, y, strict=False)) if s != t), min(len(x), len(y)))


def test_suffix_dedup_of_hot_keys(spark, docs, monkeypatch):
    """Keys with more different segments than a shard takes are settled window by window."""
    monkeypatch.setattr(suffix_dedup, "KEY_BYTES", 1000)
    r = random.Random(17)
    passage = prose(r, 120)
    table = [(k, f"{prose(r, 40)} {passage[: r.randrange(430, 600)]} {prose(r, 40)}") for k in range(30)] + [(k, "ab" * r.randrange(300, 400) + str(k)) for k in range(40, 44)] + [(None, passage), (50, None)]
    texts = [(t or "").encode() for _, t in table]
    want = [(k, len(t), int(mask.sum())) for (k, _), t, mask in zip(table, texts, covered(texts, 400), strict=True)]
    got = [(x["doc_id"], x["n_bytes"], x["n_removed"]) for x in removal_digest(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()]
    assert Counter(got) == Counter(want)


def test_suffix_dedup_of_long_texts(spark):
    """Texts of several pieces: repeats that reach over the end of a piece, and a text of one symbol."""
    r = random.Random(18)
    long, passage = " ".join(f"{r.random():.9f}" for _ in range(130_000)), prose(r, 150)
    at = (1 << 20) - 200
    table = [(1, long[:at] + passage + long[at:]), (2, passage + long[1_300_000 : 1_300_000 + 700]), (3, "z" * 1_200_000), (4, long[:at][-399:])]
    mask = [[(at, at + len(passage)), (1_300_000 + len(passage), 1_300_000 + len(passage) + 700)], [(0, len(passage) + 700)], [(0, 1_200_000)], []]
    assert len(table[0][1]) > 1_400_000 and passage.isascii() is False
    got = {x["doc_id"]: x for x in removal_digest(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    for (k, text), spans in zip(table, mask, strict=True):
        raw, kept, end = text.encode(), b"", 0
        for a, b in spans:
            a, b = len(text[:a].encode()), len(text[:b].encode())
            kept, end = kept + raw[end:a], b
        kept += raw[end:]
        assert (got[k]["n_removed"], got[k]["n_spans"], got[k]["kept_sha256"]) == (len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())


def test_sorting_within_memory(monkeypatch):
    """With small limits a shard's arrays and queues are files, and what is held in memory is much less."""
    r = np.random.default_rng(4)
    text = r.integers(97, 101, 1 << 20, dtype=np.uint8)
    text[700_000:740_000] = text[100_000:140_000]
    text[[99_999, 140_000]], text[[699_999, 740_000]] = 97, 98
    want = np.zeros(len(text), bool)
    want[100_000 : 140_000 - 399] = want[700_000 : 740_000 - 399] = True
    peak = []
    for limits in ({}, {"STEP": 1 << 14, "QUEUED": 1 << 16, "RESIDENT": 1 << 16}):
        for k, v in limits.items():
            monkeypatch.setattr(induced_sorting, k, v)
        tracemalloc.start()
        assert (np.asarray(induced_sorting.repeated_starts(text, 400)) == want).all()
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peak[1] < 0.7 * peak[0]


# -- 4


def test_token_counts(docs, none):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoding = token_counts._encoding(ranks, public_tokenizers.PATTERN)
    want = sorted((r[0], len(encoding.encode_ordinary(r[1] or ""))) for r in rows())
    for block in (1 << 20, 64, 7, 1):  # documents that go over many blocks, and blocks of a single id
        got = token_counts.count_tokens(docs, ranks, public_tokenizers.PATTERN, 50256, block)
        assert sorted((r["doc_id"], r["n_tokens"]) for r in got.collect()) == want
    assert token_counts.count_tokens(none, ranks, public_tokenizers.PATTERN, 50256).count() == 0


# -- 5


def brute_links(table: list[tuple]) -> list[tuple[int, int, int]]:
    """Size of the set, smallest id reachable, and number of links of each row."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text, *_ in table:
        w = words((text or "").translate(lower))
        sets.append(set(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)} if w else set())
    parent, links = list(range(len(sets))), [0] * len(sets)

    def find(a: int) -> int:
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            links[a] += 1
            links[b] += 1
            parent[find(b)] = find(a)
    least: dict[int, list] = defaultdict(list)
    for k, (doc_id, *_) in enumerate(table):
        least[find(k)].append(doc_id)
    return [(len(x), min((i for i in least[find(k)] if i is not None), default=None), links[k]) for k, x in enumerate(sets)]


def linked(df) -> Counter:
    return Counter(tuple(x) for x in link_components(df).select("doc_id", "n_shingles", "component_id", "n_links").collect())


def want_linked(table: list[tuple]) -> Counter:
    return Counter((row[0], *x) for row, x in zip(table, brute_links(table), strict=True))


def test_jaccard_join(spark, docs, none):
    assert linked(docs) == want_linked(rows())
    assert link_components(none).count() == 0
    # a family whose members are near its first text, but some not near each other
    r = random.Random(8)
    base = prose(r, 300).split()
    family = [(900 + k, " ".join(base)) for k in range(3)]
    for k in range(60):
        w = list(base)
        for _ in range(r.randrange(0, 14)):
            w[r.randrange(300)] = f"w{r.random()}"
        family.append((k, " ".join(w[: r.randrange(220, 300)])))
    df = spark.createDataFrame(family, "doc_id long, text string")
    assert linked(df) == want_linked(family)


def test_jaccard_join_of_null_ids(spark):
    """A text without an id links two that don't link; an id can have two texts."""
    w = prose(random.Random(13), 300).split()
    table = [(1, w[:250]), (None, w), (2, w[50:]), (None, w[::-1]), (None, w[::-1][:280]), (7, w[::2]), (7, w[::3])]
    df = spark.createDataFrame([(k, " ".join(x)) for k, x in table], "doc_id long, text string").repartition(3)
    want = want_linked([(k, " ".join(x)) for k, x in table])
    assert (None, 296, 1, 2) in want and (None, 276, None, 1) in want
    assert linked(df) == want


def test_jaccard_join_of_many_blocks(spark, monkeypatch):
    """Small chunks make a family, sets of other sizes and passers-by meet in many blocks."""
    monkeypatch.setattr(jaccard_join, "SIDE", 7)
    monkeypatch.setattr(jaccard_join, "PART_BYTES", 5000)
    r = random.Random(21)
    base, other = prose(r, 200).split(), prose(r, 60)
    table = []
    for k in range(90):
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(200)] = f"w{r.randrange(4)}"
        table.append((k, " ".join(w[: r.choice([200, 198, 160, 130])])))
    table += [(200 + k, f"{prose(r, 30)} {other} {prose(r, r.randrange(1, 40))}") for k in range(40)] + [(300, other), (None, None), (301, " ")]
    assert linked(spark.createDataFrame(table, "doc_id long, text string").repartition(4)) == want_linked(table)


def test_trie_of_a_block():
    r = np.random.default_rng(0)
    pool = np.sort(r.integers(0, 1 << 60, 60).astype(np.uint64))
    side = [np.sort(r.choice(pool, r.integers(1, 60), replace=False)) for _ in range(40)] + [pool, pool[:-1]]
    got = {(i, j) for j, found in block_links(side, side) for i in found.tolist()}
    want = set()
    for i, j in itertools.product(range(len(side)), repeat=2):
        n = len(np.intersect1d(side[i], side[j]))
        if 7 * n >= 3 * (len(side[i]) + len(side[j])):
            want.add((i, j))
    assert got == want
    assert trie([np.array([1, 2]), np.array([1, 3])], np.array([2, 2])).segment.tolist() == [1]


def test_components(spark):
    edges = [(k, k + 1) for k in range(40, 90)] + [(1, 2), (2, 2), (7, 3)]
    got = {r["id"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(40, 91), 40), 1: 1, 2: 1, 3: 3, 7: 3}


def test_jaccard_join_of_a_third_of_all(spark):
    """A line that a third of all texts begin with, and copies; rows of one text are dealt out to all parts."""
    r = random.Random(33)
    line = prose(r, 40)
    table = [(k, f"{line} {prose(r, r.randrange(1, 60))}") for k in range(80)] + [(100 + k, line) for k in range(60)] + [(200 + k, prose(r, 50)) for k in range(60)] + [(None, ""), (300, None)]
    assert linked(spark.createDataFrame(table, "doc_id long, text string").repartition(5)) == want_linked(table)
    batch = pa.RecordBatch.from_pydict({"doc_id": [k for k, _ in table], "text": [line] * len(table), "h": [1] * len(table)})
    many = Counter(x["part"] for b in jaccard_join._prefixes(16, iter([batch])) for x in b.to_pylist() if x["pack"] is None)
    assert len(many) == 16 and max(many.values()) - min(many.values()) <= 1


# -- 6


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET", "http://x.example.net/en/1", "https://example.net/fr", "http://notexample.net/en/", "http://m.example.com/de/x?y=/en/", "http://example.com/en/#top", "http://w.org/fr/1", "http://w.org?x", "ftp://cheapcasino.example.com/en/1", "http://casino-win.example.com/en/2", "http://h/p://q/", "http://hat.example.com/en/3"]
    df = spark.createDataFrame([(k, u, f"<title>the hat on {k}</title>", "v") for k, u in enumerate(urls * 3)], "page_id long, url string, html string, verdict string")
    got = judge_urls(df).collect()
    assert len(got) == len(urls) * 3
    for r in got:
        url = urls[r["page_id"] % len(urls)] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.lower()
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert r["verdict"] == max(fits)[2] if fits else r["verdict"] in ("allow", "block")
    assert {r["verdict"] for r in got if "casino-win" in r["host"]} == {"block"}
    assert {r["verdict"] for r in got if r["host"] == "hat.example.com"} == {"allow"}
    assert judge_urls(df.limit(0)).count() == 0


def test_url_models_are_whole(spark, monkeypatch):
    """Splits and scores are those of models of all words, and seeds grow with the titles; small limits would show a cut of either model."""
    monkeypatch.setattr(url_filter, "VOCABULARY", 5, raising=False)
    monkeypatch.setattr(url_filter, "SEED_COUNT", 1)
    monkeypatch.setattr(url_filter, "SEED_PART", 40, raising=False)
    monkeypatch.setattr(url_filter, "HOT", 20, raising=False)
    r = random.Random(6)
    pool = ["".join(r.choice("abcdeht") for _ in range(r.randrange(2, 7))) for _ in range(40)]
    page = lambda: "".join(r.choices(pool, k=r.randrange(1, 4)))
    urls = [None, "http://", "x", "http://win.org/", *(f"http://{r.choice(['', 'win.', 'casino'])}{page()}.info/{page()}/{page()}?{page()}" for _ in range(120))]
    table = [(k % 50, u, f"<title>{' '.join(r.choices(pool, k=6))}</title>") for k, u in enumerate(urls * 2)]
    titles = Counter(w for _, _, h in table for w in re.findall("[a-z]+", h[7:-8]))
    least = max(1, titles.total() // 40)
    s = Splitter(titles | Counter({w: max(least, titles[w]) for w in url_filter.SEEDS}))
    rows = []
    for k, u, _ in table:
        host, _, path = u.partition("://")[2].partition("?")[0].partition("/") if u and "://" in u else ("", "", "")
        own = s.words(host.rpartition(".")[0])
        rows.append((k, host, bool(set(own) & set(url_filter.SEEDS)), Counter([f"h:{w}" for w in own] + [f"p:{w}" for w in s.words(path)])))
    counts = {x: sum((f for *_, unwanted, f in rows if unwanted == x), Counter()) for x in (True, False)}
    v = len(counts[True] | counts[False])
    weight = {w: np.log((counts[True][w] + 1) / (counts[True].total() + v)) - np.log((counts[False][w] + 1) / (counts[False].total() + v)) for w in counts[True] | counts[False]}
    blocked = sum(x for *_, x, _ in rows)
    assert blocked and v > 50
    want = sorted((k, host, round(float(np.log((blocked + 1) / (len(rows) - blocked + 1)) + sum(weight[w] * n for w, n in f.items())), 6)) for k, host, _, f in rows)
    df = spark.createDataFrame(table, "page_id long, url string, html string").repartition(3)
    assert sorted((x["page_id"], x["host"], round(x["score"], 6)) for x in judge_urls(df, ()).collect()) == want


def test_viterbi_is_the_most_probable_split():
    s = Splitter({"cheap": 50, "pills": 40, "che": 3, "ap": 5, "a": 90, "pill": 20, "s": 10})
    for text in ("cheappills", "apillscheap", "xyzcheap", "a"):
        ways = [[text[i:j] for i, j in itertools.pairwise([0, *cut, len(text)])] for n in range(len(text)) for cut in itertools.combinations(range(1, len(text)), n)]
        cost = lambda w: sum(s.cost.get(x, s.base + s.letter * len(x)) for x in w)
        assert cost(s.words(text)) == pytest.approx(min(map(cost, ways)))
    assert s.words("cheap-pills.x1a") == ["cheap", "pills", "x", "a"]


# -- 7


def test_pairwise_sum_identity():
    x = fm_classifier.features(["one two three", "", None, "a " * 50 + "|||"], [13, 0, None, 103])
    r = np.random.default_rng(1)
    m = fm_classifier.Model(0.3, r.normal(size=fm_classifier.FEATURES).astype(np.float32), r.normal(size=(fm_classifier.FEATURES, 3)).astype(np.float32))
    for k, got in enumerate(m.odds(x)):
        i, v = x.index[x.begin[k] : x.begin[k + 1]], x.value[x.begin[k] : x.begin[k + 1]].astype(float)
        want = 0.3 + (m.linear[i] * v).sum() + sum(m.factors[i[p]].astype(float) @ m.factors[i[q]] * v[p] * v[q] for p in range(len(i)) for q in range(p))
        assert got == pytest.approx(want, rel=1e-4)


def test_fit_is_plain_gradient_descent(monkeypatch):
    """The fitted model against a loop over rows, features and pairs of features, in double precision."""
    monkeypatch.setattr(fm_classifier, "PASSES", 2)
    monkeypatch.setattr(fm_classifier, "STEPS", 6)
    monkeypatch.setattr(fm_classifier, "ROWS", 4)
    r = random.Random(12)
    texts = [" ".join(r.choices(["red", "blue", "green", "one", "two"], k=r.randrange(2, 8))) for _ in range(11)]
    labels = np.array([k % 3 == 0 for k in range(11)], dtype=np.float32)
    x = fm_classifier.features(texts, [len(t) for t in texts])
    got = fm_classifier.fit(x, labels, seed=5)
    draw = np.random.default_rng(5)
    v = draw.normal(0, 0.05, (fm_classifier.FEATURES, fm_classifier.RANK))
    rate = (labels.sum() + 1) / (len(labels) + 2)
    bias, past_bias, linear, past, past_v = float(np.log(rate / (1 - rate))), 1e-6, defaultdict(float), defaultdict(lambda: 1e-6), defaultdict(lambda: np.full(fm_classifier.RANK, 1e-6))
    rows = [list(zip(x.index[a:b].tolist(), x.value[a:b].astype(float).tolist(), strict=True)) for a, b in itertools.pairwise(x.begin)]

    def odds(row: list[tuple[int, float]]) -> float:
        return bias + sum(linear[i] * a for i, a in row) + sum(v[i] @ v[j] * a * b for (i, a), (j, b) in itertools.combinations(row, 2))

    for _ in range(max(2, -(-6 * 4 // 11))):
        order = draw.permutation(11)
        for at in range(0, 11, 4):
            own = order[at : at + 4]
            off = {k: (1 / (1 + np.exp(-odds(rows[k]))) - labels[k]) / len(own) for k in own}
            used = {i for k in own for i, _ in rows[k]}
            slope = {i: fm_classifier.SHRINK * linear[i] for i in used}
            slope_v = {i: fm_classifier.SHRINK * v[i] for i in used}
            for k in own:
                for i, a in rows[k]:
                    slope[i] += off[k] * a
                    slope_v[i] = slope_v[i] + off[k] * a * sum((v[j] * b for j, b in rows[k] if j != i), np.zeros(fm_classifier.RANK))
            for i in used:
                past[i] += slope[i] ** 2
                linear[i] -= fm_classifier.STEP * slope[i] / past[i] ** 0.5
                past_v[i] = past_v[i] + slope_v[i] ** 2
                v[i] = v[i] - fm_classifier.STEP * slope_v[i] / np.sqrt(past_v[i])
            past_bias += sum(off.values()) ** 2
            bias -= fm_classifier.STEP * sum(off.values()) / past_bias**0.5
    assert got.bias == pytest.approx(bias, abs=1e-4)
    assert got.odds(x) == pytest.approx([odds(row) for row in rows], abs=2e-3)
    assert max(abs(got.linear[i] - linear[i]) for i in linear) < 1e-3


def test_quality_classifier(spark, docs, none, sf_dir):
    got = QUERIES["op7_quality_classifier"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.93
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in fm_classifier.score_quality(docs, labels).collect()} == {0.5}
    assert fm_classifier.score_quality(none, labels).count() == 0


# -- 8


def test_quality_counts(docs, none):
    got = judge(docs).collect()
    assert len(got) == len(rows())
    texts = {r[0]: r[1] or "" for r in rows()}
    for r in got:
        text = texts[r["doc_id"]]
        w = words(text)
        count = Counter(zip(w, w[1:], w[2:], strict=False))
        twice = {j for i in range(len(w) - 2) if count[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(twice) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert judge(none).count() == 0


def test_quality_outliers(spark, sf_dir):
    got = QUERIES["op8_quality_rules"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    good, bad = [r for r in got if r["quality"] == 1], [r for r in got if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.9 * len(bad)


def mcd(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reweighted minimum covariance determinant of the rows of x, with numpy."""
    p, floor = x.shape[1], np.diag(np.square(list(quality_rules.SPREADS.values())))
    median = lambda v: (np.sort(np.floor(v * quality_rules.CELLS), axis=0)[-(-len(v) // 2) - 1] + 0.5) / quality_rules.CELLS
    middle = median(x)
    unit = np.sqrt(np.diag(floor))
    signs = (x - middle) / unit
    signs = signs / np.maximum(np.linalg.norm(signs, axis=1, keepdims=True), 1e-9)
    starts = [(middle, np.diag((1.4826 * median(abs(x - middle))) ** 2)), (x.mean(0), np.cov(x.T, bias=True)), (middle, signs.T @ signs / len(x) * np.outer(unit, unit))]

    def far(m: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.einsum("ri,ij,rj->r", x - m, np.linalg.inv(c + floor), x - m)

    def step(m: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = np.floor(np.log2(far(m, c) + 1e-6) * quality_rules.NEAR_CELLS)
        before = np.searchsorted(np.sort(cell), cell) / len(cell)
        own = x[before < quality_rules.SHARE]
        return own.mean(0), quality_rules.CONSISTENT * np.cov(own.T, bias=True).reshape(p, p)

    size = lambda e: np.linalg.slogdet(e[1] + floor)[1]
    for _ in range(quality_rules.FIRST_STEPS):
        starts = [step(*e) for e in starts]
    best = min(starts, key=size)
    for _ in range(quality_rules.STEPS):
        after = step(*best)
        fell = size(best) - size(after) > quality_rules.FALL
        best = after
        if not fell:
            break
    own = x[far(*best) <= quality_rules.WITHIN]
    return (own.mean(0), quality_rules.CONSISTENT_WITHIN * np.cov(own.T, bias=True).reshape(p, p)) if len(own) else best


def test_quality_distances(spark):
    """Distances against numpy, and a group of which over a third is junk of one kind."""
    r, table = random.Random(31), []
    for lang, source, many, junk in [("en", "a", 150, 80), ("en", "b", 40, 2), ("en", None, 3, 0), ("fr", "a", 25, 1), (None, "c", 1, 0)]:
        for k in range(many + junk):
            text = "\n".join(prose(r, r.randrange(5, 30)) for _ in range(r.randrange(4, 30))) + " #" * r.randrange(3)
            table.append((len(table), text if k < many else " ".join(w + r.choice(["$$", "|%", "#"]) for w in text.split()), lang, source))
    got = sorted(judge(spark.createDataFrame(table, "doc_id long, text string, lang string, source string"), ["lang", "source"]).collect(), key=lambda x: x["doc_id"])
    fit = [x for x in got if not x["base_failed"]]
    n, chars = (np.array([max(1, x[c]) for x in fit], float) for c in ("n_words", "word_chars"))
    stats = np.column_stack([np.log(n), np.log(chars / n), *(np.log1p([a * x[c] / b for x, b in zip(fit, d, strict=True)]) for a, c, d in ((200, "n_symbols", chars), (100, "n_dup_lines", n), (20, "n_repeat_words", n)))])
    lean = lambda own, on, k: tuple((k * a + quality_rules.PRIOR * b) / (k + quality_rules.PRIOR) for a, b in zip(own, on, strict=True))
    of = lambda *key: np.array([[x["lang"], x["source"]][: len(key)] == list(key) for x in fit])
    everyone = mcd(stats)
    for lang, source in {(x["lang"], x["source"]) for x in fit}:
        lang_rows, rows_ = of(lang), of(lang, source)
        m, c = lean(mcd(stats[rows_]), lean(mcd(stats[lang_rows]), everyone, lang_rows.sum()), rows_.sum())
        y = stats[rows_] - m
        want = np.einsum("ri,ij,rj->r", y, np.linalg.inv(c + np.diag(np.square(list(quality_rules.SPREADS.values())))), y)
        assert [x["distance"] for x, own in zip(fit, rows_, strict=True) if own] == pytest.approx(want.tolist(), rel=1e-6)
    assert all(x["kept"] == (x["distance"] <= quality_rules.CUT) for x in fit)
    marked = {k for k, t, *_ in table if re.search(r"\w(\$\$|\|%|#)", t)}
    assert len(marked) > 80 and {x["doc_id"] for x in got if not x["kept"] and not x["base_failed"]} == {x["doc_id"] for x in fit} & marked


def test_quality_of_many_groups(spark, monkeypatch):
    """With more groups than are broadcast: the same distances, and the rows of a group with a third of all come from all tasks, not one."""
    r, table = random.Random(33), []
    for k in range(240):
        lang, source = ("en", "hot") if k % 3 == 0 else (["en", "fr", None][k % 7 % 3], f"s{k % 25}")
        table.append((k, " ".join(prose(r, r.randrange(30, 120)).split()) + " #" * (k % 4), lang, source))
    table += [(1000 + k, "too short", "xx", "rejected") for k in range(120)] + [(None, None, None, None)]
    docs = spark.createDataFrame(table, DOCUMENTS.split(", lang")[0] + ", lang string, source string").repartition(4)
    plain = lambda rows: sorted((str(x["doc_id"]), x["kept"], None if x["distance"] is None else round(x["distance"], 6)) for x in rows)
    want = plain(judge(docs).collect())
    monkeypatch.setattr(quality_rules, "BROADCAST", 0)
    monkeypatch.setattr(quality_rules, "HOT", 20)
    assert plain(judge(docs).collect()) == want
    # rows of the hot group stay where they are; a join on the group's name would have them in one partition
    rows = docs.select(F.col("doc_id").alias("_x0"), F.when(F.col("source").isin("hot", "rejected"), F.xxhash64("source")).otherwise(F.xxhash64("lang", "source")).alias("_group"))
    one = quality_rules._beside(rows, rows.select("_group").distinct().withColumn("_m0", F.lit(0.0)).filter(F.col("_group") != F.xxhash64(F.lit("rejected"))), quality_rules._uses(rows), "left")
    at = one.groupBy("_group", F.spark_partition_id().alias("p")).count().collect()
    for name in ("hot", "rejected"):
        group = spark.sql(f"SELECT xxhash64('{name}') AS g").first()["g"]
        spread = [x["count"] for x in at if x["_group"] == group]
        assert len(spread) == 4 and max(spread) < 0.5 * sum(spread)
    assert one.count() == len(table)


def test_repeated_words_of_long_texts(spark, monkeypatch):
    r = random.Random(32)
    w = [r.choice("abcdefgh") * r.randrange(1, 5) for _ in range(6000)] + [f"x{k}" for k in range(2000)]
    count = Counter(zip(w, w[1:], w[2:], strict=False))
    want = len({j for i in range(len(w) - 2) if count[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)})
    df = spark.createDataFrame([(" ".join(w),)], "text string").repartition(2)
    for limit in (1 << 17, 1 << 10):
        monkeypatch.setattr(quality_rules, "MANY_WORDS", limit)
        assert df.select(quality_rules.let(quality_rules.words(F.col("text")), quality_rules.repeated_words).alias("n")).first()["n"] == want


# -- 9


def test_warc(spark):
    big, wide = "x" * 1000, "é" * 500
    html = [None, "", big, big, wide, "small", "small", big + "\r\n\r\nWARC/1.1\r\n", wide, big]
    df = spark.createDataFrame([(k, ["http://b.org/x", "http://a.b.org/?q\r\n", None, "http://B.org/x"][k % 4], h, "d", 1) for k, h in enumerate(html)], "page_id long, url string, html string, digest string, size int").repartition(3)
    got = {r["page_id"]: r for r in warc.archive_pages(df).collect()}
    assert len(got) == len(html)
    for k, h in enumerate(html):
        raw = (h or "").encode()
        last = max(j for j, x in enumerate(html) if (x or "") == (h or ""))
        revisit = len(raw) >= 1000 and k < last
        assert (got[k]["payload_bytes"], got[k]["payload_digest"], got[k]["record_type"], got[k]["refers_to"]) == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last if revisit else None)
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_warc_decides_by_row(spark):
    a, b, c = "a" * 1000, "b" * 1000, "c" * 1000
    table = [(5, a), (5, a), (5, b), (9, a), (7, "small"), (7, "small"), (8, "small"), (5, "small"), (None, c), (None, c), (3, c), (4, c), (4, c), (4, b)]
    df = spark.createDataFrame([(k, "http://b.org/x", h) for k, h in table], "page_id long, url string, html string")
    want = Counter()
    for k, h in table:
        last = max(j for j, x in table if x == h and j is not None)
        revisit = len(h) >= 1000 and k is not None and k < last
        want[k, hashlib.sha1(h.encode()).hexdigest(), "revisit" if revisit else "response", last if revisit else None] += 1
    got = warc.archive_pages(df).collect()
    assert Counter((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert {r["payload_digest"] for r in got if r["record_type"] == "response"} == {hashlib.sha1(h.encode()).hexdigest() for _, h in table}


def test_warc_histories_over_ranges_and_passes(spark, monkeypatch):
    """Small limits: many archives, several merge passes, a URL over many ranges; ids of any size; every record can be read at its offset."""
    from factorlab.llm.common import Scratch, shared_dir, store_of

    for k, v in {"ARCHIVE_BYTES": 700, "FAN_IN": 3, "BATCH": 4, "RANGE": 9}.items():
        monkeypatch.setattr(warc, k, v)
    r = random.Random(51)
    table = [(k * (10**16 if k % 5 == 0 else 1) * (-1) ** k, f"http://h{min(k % 9, 3)}.org/x", prose(r, r.randrange(0, 60))) for k in range(1, 140)] + [(None, "http://h3.org/x", None)] * 3
    df = spark.createDataFrame(table, "page_id long, url string, html string").repartition(5)
    got = warc.archive_pages(df).collect()
    order = lambda x: (x["url_key"], x["timestamp"], x["page_id"] is not None, x["page_id"] or 0)
    placed = sorted(got, key=lambda x: (x["range"], x["place"]))
    assert [order(x) for x in placed] == sorted(map(order, got)) and len(got) == len(table)
    assert len({x["range"] for x in got}) > 5 and len({x["archive"] for x in got}) > 27
    seen = Counter()
    for x in placed:
        seen[x["url_key"]] += 1
        assert x["capture"] == seen[x["url_key"]]
    with Scratch(spark) as scratch:
        path = f"{shared_dir(spark)}/warc-test-{r.random()}"
        archives = warc.write_archives(df, path, scratch).collect()
        store, folder = store_of(path)
        raw = store.open_input_file(f"{folder}/{archives[0]['archive']}").read()
        places = [at for at, _ in warc.members(__import__("io").BytesIO(raw), 50)]
        assert len(places) > 1 and all(zlib.decompressobj(31).decompress(raw[at:]).startswith(b"WARC/1.1") for at in places)


def test_loser_tree():
    r = random.Random(5)
    for _ in range(200):
        runs = [sorted((r.randrange(40), None) for _ in range(r.randrange(7))) for _ in range(r.randrange(10))]
        assert [x[0] for x in warc.LoserTree([iter(x) for x in runs])] == sorted(x[0] for x in itertools.chain(*runs))


def test_url_key():
    assert warc.url_key("https://www.Example.com:81/A?b=C#d") == "com,example,www:81)/a?b=c"
    assert warc.url_key(None) == warc.url_key("x") == ""


# -- 10


def test_media(docs, none):
    got = media_ts.load(media_ts.store(docs)).collect()
    assert len(got) == len(rows())
    texts = {r[0]: (r[1] or "").encode() for r in rows()}
    seen = defaultdict(set)
    for r in got:
        raw = texts[r["doc_id"]]
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["continuity_errors"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), 0)
        assert r["media_bytes"] % 188 == 0
        seen[raw].add((r["media_sha256"], r["feature"]))
    assert all(len(x) == 1 for x in seen.values())
    assert media_ts.load(media_ts.store(none)).count() == 0


def test_transport_stream():
    for n in [*range(0, 600), *range(4000, 4300, 3), 40_000]:
        x = media_ts.demux(media_ts.mux(bytes(n)))
        assert (x.payload, x.continuity_errors) == (bytes(n), 0)
        assert x.random_access == list(range(0, len(x.pts), media_ts.GROUP)) and x.pts == [90000 + 3003 * k for k in range(len(x.pts))]
    media = bytearray(media_ts.mux(bytes(9000)))
    media[188 * 5 + 3] ^= 1  # a wrong counter
    assert media_ts.demux(bytes(media)).continuity_errors == 2
    with pytest.raises(ValueError, match="sync"):
        media_ts.demux(b"\0" * 188)
    damaged = bytearray(media_ts.mux(b"x"))
    damaged[12] ^= 1
    with pytest.raises(ValueError, match="table"):
        media_ts.demux(bytes(damaged))
    with pytest.raises(ValueError, match="no private stream"):
        media_ts.demux(media_ts.mux(b"x")[188 * 2 :])
    whole = media_ts.mux(bytes(400))
    with pytest.raises(ValueError, match="begin"):
        media_ts.demux(whole[: 188 * 2] + whole[188 * 3 :])


# -- the pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = given
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, sf_dir).cache()
        if name == "quality_rules":
            kept = {r["doc_id"] for r in judge(before).filter("kept").collect()}
            assert {r["doc_id"] for r in docs.collect()} == kept
        elif name == "ngram_jaccard_join":
            found = brute_links([(r["doc_id"], r["text"]) for r in before.collect()])
            assert {r["doc_id"] for r in docs.collect()} == {c for _, c, _ in found}
        elif name == "suffix_array_dedup":
            old, new = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (before, docs))
            texts = [t.encode() for t in old.values()]
            for k, t, mask in zip(old, texts, covered(texts, corpus_pipeline.PASSAGE), strict=True):
                assert new[k] == bytes(np.frombuffer(t, np.uint8)[~mask]).decode(errors="ignore")
        elif name == "mix_sources":
            taken = {r["doc_id"]: r["taken"] for r in mix_sources(before).collect() if r["taken"]}
            got = Counter()
            for r in docs.collect():
                got[r["doc_id"]] += len(words(r["text"]))
            assert dict(got) == taken
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
            want = Counter((r["doc_id"], tuple(library.encode(r["text"]))) for r in before.collect())
            assert Counter((r["doc_id"], tuple(r["ids"])) for r in docs.collect()) == want
        if name != "sentencepiece":
            assert docs.columns == given.columns
    assert docs.count() > 0


def test_stages_of_odd_rows(spark):
    """Rows without ids, texts that share an id, equal rows, and tables without rows: each stage decides by row."""
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)
    r = random.Random(41)
    long = lambda: "\n".join(prose(r, 20) for _ in range(8))
    a, b, c, d = long(), long(), long(), long()
    bad = "same words again " * 60
    table = [(None, a), (None, b), (None, bad), (7, c), (7, bad), (7, c), (8, c + " more"), (3, d), (4, d), (None, d), (9, None), (9, None), (5, " \n"), (5, "one two"), (None, "one two")]
    full = lambda rows_: spark.createDataFrame([(k, t, "en", "s" if k else None, len(t or "")) for k, t in rows_], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    rows_of = lambda df: Counter((x["doc_id"], x["text"]) for x in df.collect())
    assert rows_of(stage["quality_rules"](spark, full(table), "")) == Counter(x for x in table if len(words(x[1])) >= 50 and x[1] != bad)
    want = [(None, a), (None, b), (None, bad), (7, c), (3, d), (9, None), (9, None), (5, " \n"), (5, "one two")]
    assert rows_of(stage["ngram_jaccard_join"](spark, full([x for x in table if x != (7, bad)]), "")) == Counter(want)
    mixed = rows_of(stage["mix_sources"](spark, full(table), ""))
    taken = sum(x["taken"] for x in mix_sources(full(table)).collect())
    assert sum(len(words(t)) * n for (_, t), n in mixed.items()) == taken > 0
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, full([]), "").count() == 0, name


def test_registration():
    assert {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 14))


def test_columns_with_the_names_of_helpers(spark):
    """A caller's columns may have any name; they come back as they were."""
    names = ["_h", "_spans", "_row", "_d", "_hash", "h", "a", "b", "lang", "source", "distance", "_x0", "_d2", "_group", "_stay", "words"]
    r = random.Random(9)
    passage = prose(r, 120)
    table = [(k, f"{prose(r, 70)} {passage}" if k % 2 else prose(r, 90), 3, *[f"{c}{k}" for c in names]) for k in range(8)]
    df = spark.createDataFrame(table, "doc_id long, text string, n_chars int, " + ", ".join(f"{c} string" for c in names))
    cut = {r["doc_id"]: r for r in remove_repeats(df).collect()}
    assert remove_repeats(df).columns == df.columns and cut[1]["n_chars"] == len(cut[1]["text"]) < len(table[1][1]) and cut[0]["text"] == table[0][1]
    assert all(cut[row[0]][c] == f"{c}{row[0]}" for row in table for c in names)
    assert remove_repeats(df.select("text", "doc_id")).columns == ["text", "doc_id"]
    stay = [c for c in names if c != "distance"]
    judged = judge(df, names).collect()
    assert all(x[c] == f"{c}{x['doc_id']}" for x in judged for c in stay) and all(x["distance"] is None or x["distance"] >= 0 for x in judged)


def test_labels_of_repeated_ids_bring_one_text_each(spark, monkeypatch):
    """Rows that share a labelled doc_id don't add to what comes to the driver, and which one counts doesn't depend on their order."""
    ids = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5][:8]
    table = [(k, f"text {j} of {k}", 5) for k in ids for j in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in ids], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(fm_classifier, "fit", lambda x, y, fit=fm_classifier.fit: (seen.append((len(y), x.index.tobytes(), x.value.tobytes())), fit(x, y))[1])
    for parts in (1, 5):
        fm_classifier.train(spark.createDataFrame(table, "doc_id long, text string, n_chars long").repartition(parts), labels)
    assert seen[0][0] == len(ids) and seen[0] == seen[1]
