"""The corpus pipeline: quality rules, near duplicates, repeated passages, the mix of sources, and token ids, one stage after another.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; what it returns is written as Parquet and read
again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlab.llm.common import WORD, Scratch, read
from factorlab.llm.jaccard_join import link_components
from factorlab.llm.mixing import mix_sources
from factorlab.llm.quality_rules import judge
from factorlab.llm.sentencepiece_codec import encode_decode
from factorlab.llm.suffix_dedup import remove_repeats

#: Bytes of a repeated string that is cut, and of the strings whose hashes deal them out: 50 words of prose, white space included, have
#: 240 bytes or more but for one passage in a hundred or so.
PASSAGE, GRAM = 240, 120
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equal in all keys, nulls being equal."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def _first_of(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with equal keys the one with the least lang, source, n_chars and text (nulls first), so that reruns agree."""
    others = [c for c in ("lang", "source", "n_chars", "text", "doc_id") if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_row")).select(*keys, "_row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the robust outlier test reject go. Rows are judged one by one, whatever their doc_id: a row
    without one, or with that of a rejected text, stays if it is kept itself."""
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("_h"))
    keys = ["doc_id", "_h", "lang", "source"]
    kept = judge(keyed, ["_h", "lang", "source"]).filter("kept").select(*keys).distinct()
    return keyed.join(kept, _same(keyed, kept, keys), "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents one stays: that of the smallest doc_id (rows without one come last), of several texts of it
    that of the smallest hash, of equal rows one. Documents without words are linked with nothing and all stay."""
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("_h"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("_words"))
    some = keyed.filter("_words")
    keys = ["doc_id", "_h"]
    first = link_components(docs).filter("stays and n_shingles > 0").select("doc_id", F.col("h").alias("_h")).distinct()
    one = _first_of(some.join(first, _same(some, first, keys), "left_semi"), keys)
    return one.select(*COLUMNS).union(keyed.filter("not _words").select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of repeated strings of PASSAGE bytes are cut from the texts; a document of which nothing is left stays with an empty text."""
    return remove_repeats(docs.select(*COLUMNS), PASSAGE, GRAM)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row that the mix takes of a text: one row for each time that it is taken whole, and one with the words of its chosen blocks."""
    word = regex.compile(WORD)
    for batch in batches:
        out: dict[str, list] = {c: [] for c in COLUMNS}
        for row in batch.to_pylist():
            text = row["text"] or ""
            places = [m.span() for m in word.finditer(text)] if any(x["spans"] for x in row["_takes"]) else []
            texts = []
            for take in row["_takes"]:
                texts += [text] * take["passes"]
                # neighbouring blocks are one run of text
                runs: list[list[int]] = []
                for x in sorted(take["spans"] or [], key=lambda s: s["a"]):
                    if runs and runs[-1][1] == x["a"]:
                        runs[-1][1] = x["b"]
                    else:
                        runs.append([x["a"], x["b"]])
                if runs:
                    texts.append(text if runs == [[0, len(places)]] else "\n".join(text[places[a][0] : places[b - 1][1]] for a, b in runs))
            for t in texts:
                for c in COLUMNS:
                    out[c].append({"text": t, "n_chars": len(t)}.get(c, row[c]))
        yield pa.RecordBatch.from_arrays([pa.array(out[c], pa.string() if c in ("text", "lang", "source") else pa.int64()) for c in COLUMNS], COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and as much as the mix takes of them. Rows of equal doc_id, source and text are one document taken more often."""
    keys = ["doc_id", "source", "_h"]
    takes = mix_sources(docs).filter("taken > 0").groupBy("doc_id", "source", F.col("h").alias("_h")).agg(F.collect_list(F.struct("passes", "spans")).alias("_takes"))
    takes = takes.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    once = _first_of(docs.select(*COLUMNS, F.xxhash64("text").alias("_h")), keys)
    match = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return once.join(takes, match).select(*COLUMNS, "_takes").mapInArrow(_cut, "doc_id long, text string, lang string, source string, n_chars long")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row, with the digests of ids and decoded text."""
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True).drop("decoded")


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("suffix_array_dedup", repeated_passages), ("mix_sources", mixed), ("sentencepiece", encoded)]
#: Robust estimates, seeded selection and piece merges are outside SQL; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each stage but the last returns is written to the shared folder, and deleted when the
    next one's is there. The last of these tables stays, as the result reads it."""
    docs = read(spark, sf_dir, "documents")
    tables = Scratch(spark)
    for _, stage in STAGES[:-1]:
        before, docs = docs, tables.written(stage(spark, docs, sf_dir))
        tables.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
