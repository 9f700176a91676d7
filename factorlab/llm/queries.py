"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import read, written
from .dialog_repair import repair_conversations
from .fm_classifier import score_quality
from .jaccard_join import link_components
from .media_ts import load, store
from .mixing import mix_sources
from .oracle_sql import codes_sql, repair_sql
from .quality_rules import judge
from .sentencepiece_codec import encode_decode
from .suffix_dedup import removal_digest
from .token_counts import count_tokens
from .url_filter import judge_urls
from .vector_codes import compress_vectors
from .warc import archive_pages
from .word_bpe import encode_words

QUERIES = {}
#: SQL over whole tables where SQL can say all columns; tests/llm holds the other methods against brute force instead.
ORACLES: dict[str, str] = {
    # every window of 400 bytes, by its hash; runs of windows that start twice; what is left between the runs
    "op3_suffix_dedup": """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
parts AS MATERIALIZED (SELECT doc_id, n, p, substr(x, 512 * p + 1, 1310) AS y FROM (SELECT doc_id, n, x, unnest(range(0, (n - 144) // 256)) AS p FROM t WHERE n >= 400)),
windows AS MATERIALIZED (SELECT doc_id, 256 * p + j AS i, md5_number(substr(y, 2 * j + 1, 800)) AS w FROM (SELECT doc_id, p, y, unnest(range(0, least(256, n - 399 - 256 * p))) AS j FROM parts)),
again AS (SELECT doc_id, i FROM windows JOIN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1) USING (w)),
marked AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM again),
placed AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM marked),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM placed GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM runs),
cut AS (SELECT g.doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept FROM gaps g JOIN t USING (doc_id) GROUP BY g.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN removed IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM t LEFT JOIN cut USING (doc_id)""",
    # every pair of documents that share a shingle, and all that can be reached from a document
    "op5_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
pairs AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least_id, doc_id)) AS component_id, coalesce(links, 0) AS n_links
FROM s LEFT JOIN (SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY a) USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS links FROM pairs GROUP BY a) USING (doc_id)""",
    # the place of a capture in its URL's history is what the merge of all runs gives
    "op9_warc": r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
kept AS (SELECT d, max(page_id) AS of FROM p WHERE n >= 1000 GROUP BY d),
u AS (SELECT page_id, strpos(url, '://') > 0 AS whole, substr(url, strpos(url, '://') + 3) AS rest, strftime(TIMESTAMP '2000-01-01' + to_seconds(((page_id % 3155760000) + 3155760000) % 3155760000), '%Y-%m-%dT%H:%M:%SZ') AS timestamp FROM p),
k AS (SELECT page_id, timestamp, CASE WHEN whole THEN lower(array_to_string(list_reverse(string_split(regexp_extract(rest, '^([^/?#:]*)', 1), '.')), ',') || regexp_extract(rest, '^[^/?#:]*(:[0-9]+)?', 1) || ')'
  || regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) || regexp_extract(rest, '^[^?#]*([?][^#]+)', 1)) ELSE '' END AS url_key FROM u)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id < of THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < of THEN of END AS refers_to,
  url_key, timestamp, row_number() OVER (PARTITION BY url_key ORDER BY timestamp, page_id) AS capture
FROM p LEFT JOIN kept USING (d) JOIN k USING (page_id)""",
    "op11_dialog_repair": repair_sql(),
    "op13_vector_codes": codes_sql(),
}


def registered(f):
    QUERIES[f.__name__] = f
    return f


@registered
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "passes", "source_quota")


@registered
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@registered
def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the streams are a table in the shared folder, and what is computed comes from what is read back of it
    return load(written(store(read(spark, sf_dir, "documents"))))


@registered
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@registered
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


@registered
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digest(read(spark, sf_dir, "documents"))


@registered
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp", "capture")


@registered
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"))


@registered
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@registered
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)


@registered
def op11_dialog_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(read(spark, sf_dir, "conversations"))


@registered
def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_words(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@registered
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_vectors(read(spark, sf_dir, "embeddings"))
