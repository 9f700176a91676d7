"""URL filters: rules by host and path first; else words of the host and path, scored by naive Bayes.

Host labels and path parts are often several words written as one. They are split by a unigram model: of all ways to split, a
Viterbi search takes the most probable. The words then score by multinomial naive Bayes, trained on the URLs whose host holds a seed
word as one of its words (block) against all others (allow).

Both models are tables of all their words and are joined, never gathered: runs of letters with the words of the model that they hold,
rows with the runs, features with their counts. Keys of more than 1/HOT of a join's rows are broadcast, which are fewer than HOT.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, matched, written

#: (verdict, host, path): fits the host and all its subdomains where the URL's path starts with the path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words that mark training hosts as unwanted: gambling, pills, loans, adult pages, advertisement trackers.
SEEDS = ("ads", "adult", "bets", "casino", "cheap", "gambling", "loans", "pills", "poker", "porn", "replica", "track", "viagra", "win", "xxx")
#: Characters in a word that Viterbi tries, and that a word of the unigram model has at most.
LONGEST = 24
#: Occurrences that a seed word has in the unigram model at least: one in SEED_PART of all, or SEED_COUNT where titles are few.
SEED_PART, SEED_COUNT = 5000, 50
#: A key with more than one in HOT of a join's rows is broadcast.
HOT = 1000
PARTS = re.compile(r"[a-z]+")


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, in lower case; empty for null or no ://."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.when(F.locate("://", F.coalesce(url, F.lit(""))) > 0, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.when(F.locate("://", F.coalesce(url, F.lit(""))) > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def fitting(rules: tuple[tuple[str, str, str], ...], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one string, and its verdict; null where none does."""
    rule, verdict = F, F
    for kind, own, start in sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, verdict = rule.when(fits, own + start), verdict.when(fits, kind)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


class Splitter:
    """Splits a run of letters into words by the unigram model: the most probable way, by Viterbi.

    Counts can be those of the words that the runs hold, with the total and the longest word of the whole model given.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None, longest: int | None = None) -> None:
        total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items()}
        # an unknown word is less probable than any known one, and ever less with each letter
        self.base, self.letter = math.log(total) + 1, math.log(26)
        self.longest = max([1, *map(len, self.cost)]) if longest is None else longest
        self.split = lru_cache(1 << 16)(self._split)

    def _split(self, run: str) -> tuple[str, ...]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for stop in range(1, len(run) + 1):
            ways = []
            for start in range(max(0, stop - self.longest, stop - LONGEST), stop):
                word = run[start:stop]
                cost = self.cost.get(word)
                ways.append((best[start][0] + (self.base + self.letter * len(word) if cost is None else cost), start))
            best.append(min(ways))
        out, stop = [], len(run)
        while stop:
            out.append(run[best[stop][1] : stop])
            stop = best[stop][1]
        return tuple(reversed(out))

    def words(self, text: str) -> list[str]:
        return [w for run in PARTS.findall(text) for w in self.split(run)]


def unigrams(pages: DataFrame) -> DataFrame:
    """word, n: counts of all words of page titles and of the seed words."""
    title = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))
    words = pages.select(F.explode(F.regexp_extract_all(title, F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    words = words.filter(F.col("word").rlike(f"^[a-z]{{2,{LONGEST}}}$"))
    counts = checkpointed(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    seeds = counts.sparkSession.createDataFrame([(w, max(SEED_COUNT, total // SEED_PART)) for w in SEEDS], "word string, n long")
    return checkpointed(counts.union(seeds).groupBy("word").agg(F.max("n").alias("n")))


def splits(runs: DataFrame, model: DataFrame) -> DataFrame:
    """run, words, uses from the distinct runs of letters (run, uses): each run's own part of the model is joined to it."""
    windows = runs.select("run", F.explode(F.transform(F.sequence(F.lit(1), F.length("run")), lambda i: F.substring(F.col("run"), i, F.lit(LONGEST)))).alias("_w")).filter(F.length("_w") > 1)
    held = windows.select("run", F.explode(F.transform(F.sequence(F.lit(2), F.length("_w")), lambda n: F.substring(F.col("_w"), F.lit(1), n))).alias("word"))
    uses = held.groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    known = matched(held, checkpointed(uses.join(model, "word", "left")), "word", HOT).filter("n is not null")
    known = known.groupBy("run").agg(F.collect_set(F.struct("word", "n")).alias("known"))
    whole = model.agg(F.sum("n").alias("total"), F.max(F.length("word")).alias("longest")).first()
    total, longest = whole["total"], whole["longest"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = zip(batch.column("run").to_pylist(), batch.column("known").to_pylist(), strict=True)
            words = [Splitter({x["word"]: x["n"] for x in known or []}, total, longest)._split(run) for run, known in parts]
            yield pa.RecordBatch.from_arrays([batch.column("run"), pa.array(words, pa.list_(pa.string())), batch.column("uses")], ["run", "words", "uses"])

    return runs.join(known, "run", "left").mapInArrow(each, "run string, words array<string>, uses long")


def featured(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Adds features (the words of host, but for its last label, and path, each with where it stands) and unwanted (whether a seed word is in the host) to rows of _row, host and path."""

    def runs(kind: str, text: Column) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(PARTS.pattern), F.lit(0)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("run")))

    held = written(rows.select("_row", F.inline(F.concat(runs("h:", F.regexp_extract("host", r"(?s)^(.*)\.", 1)), runs("p:", F.lower("path"))))))
    own = matched(held, checkpointed(splits(checkpointed(held.groupBy("run").agg(F.count(F.lit(1)).alias("uses"))), model)), "run", HOT)
    unwanted = F.max((F.col("kind") == "h:") & F.arrays_overlap("words", F.array(*[F.lit(w) for w in SEEDS])))
    own = own.groupBy("_row").agg(F.flatten(F.collect_list(F.transform("words", lambda w: F.concat("kind", w)))).alias("_features"), unwanted.alias("_unwanted"))
    out = rows.join(own, "_row", "left").withColumn("features", F.coalesce("_features", F.array().cast("array<string>")))
    return out.withColumn("unwanted", F.coalesce("_unwanted", F.lit(False))).drop("_features", "_unwanted")


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (log odds of block; null where a rule decides), one row for each row of pages.

    A URL that is null or without :// has no host, path or rule and is scored without words. With no seed word in any host nothing is
    known of unwanted URLs, and all that no rule decides are allowed. An empty table gives no rows.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = fitting(rules, F.col("host"), F.col("path"))
    # rows are named where they are kept, so that equal ids and URLs stay apart
    rows = written(rows.withColumns({"rule": rule, "given": verdict, "_row": F.monotonically_increasing_id()}))
    table = written(featured(rows, unigrams(pages)))
    words = table.select("_row", "unwanted", F.explode("features").alias("word"))
    counts = words.groupBy("word").agg(F.count_if("unwanted").alias("block"), F.count_if(~F.col("unwanted")).alias("allow"), F.count(F.lit(1)).alias("uses"))
    counts = checkpointed(counts)
    sums = counts.agg(F.coalesce(F.sum("block"), F.lit(0)).alias("b"), F.coalesce(F.sum("allow"), F.lit(0)).alias("a"), F.count(F.lit(1)).alias("v")).first()
    seen = table.agg(F.count_if("unwanted").alias("b"), F.count_if(~F.col("unwanted")).alias("a")).first()
    own = matched(words.drop("unwanted"), counts, "word", HOT).groupBy("_row").agg(F.collect_list(F.struct("word", "block", "allow")).alias("found"))
    return scored(table.join(own, "_row", "left"), (sums["b"], sums["a"], sums["v"]), math.log((seen["b"] + 1) / (seen["a"] + 1)), seen["b"] == 0)


def scored(table: DataFrame, sums: tuple[int, int, int], prior: float, none: bool) -> DataFrame:
    """Log odds from the counts of the rows' words (`found`, one for each time that a word occurs), and verdicts; sums are all occurrences, blocked and allowed, and the number of words."""
    b, a, v = sums

    def odds(found: list[dict] | None) -> float:
        times = Counter((x["word"], x["block"], x["allow"]) for x in found or [])
        return prior + sum((math.log((block + 1) / (b + v)) - math.log((allow + 1) / (a + v))) * n for (_, block, allow), n in sorted(times.items()))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.array([odds(x) for x in batch.column("found").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule", "given")), got], ["page_id", "host", "path", "rule", "given", "odds"])

    out = table.mapInArrow(each, "page_id long, host string, path string, rule string, given string, odds double")
    method = F.when(F.lit(none) | (F.col("odds") <= 0), "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", method).alias("verdict"), F.when(F.col("given").isNull(), F.col("odds")).alias("score"))
