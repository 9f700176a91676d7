"""The queries of training-data operators that SQL can say, against DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import Row

from factorlab.llm.queries import ORACLES, QUERIES

WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"


def shares() -> str:
    """Targets by sharing the excess again and again until no source is above its cap; each round can only add capped sources."""
    steps = [
        f"d AS (SELECT doc_id, source, CAST(len({WORDS.format('text')}) AS BIGINT) AS size FROM documents)",
        "s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source)",
        "l0 AS (SELECT sum(n) / sum(w) AS l FROM s)",
    ]
    for k in range(12):
        steps.append(f"l{k + 1} AS (SELECT (sum(n) - coalesce(sum(CASE WHEN 3 * n < w * l THEN 3 * n END), 0)) / sum(CASE WHEN 3 * n < w * l THEN 0 ELSE w END) AS l FROM s, l{k} GROUP BY l)")
    return "WITH " + ", ".join(steps) + " SELECT doc_id, size, n AS source_size, round(least(3 * n, w * l), 4) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, l12"


#: What SQL can say of operators whose method it can't: some of their columns, for all rows.
COLUMNS = {
    "op1_mix_sources": shares(),
    "op6_url_filter": r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) t(kind, h, start))
SELECT page_id, host, path, arg_max(h || start, length(h || start)) AS rule FROM p LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start) GROUP BY page_id, host, path""",
    "op8_quality_rules": rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS.format('text')} AS w FROM documents),
three AS (SELECT doc_id, i, w[i : i + 2] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT doc_id, list(i) AS starts FROM three GROUP BY doc_id, x HAVING count(*) > 1),
places AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, unnest(starts) AS i FROM again), range(3) r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS l FROM w)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
FROM w JOIN lines USING (doc_id) LEFT JOIN places USING (doc_id)""",
}


@pytest.fixture(scope="module")
def db(sf_dir):
    tables = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        tables.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return tables


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf_dir, db, name):
    found = db.execute(COLUMNS[name])
    names = [x[0] for x in found.description]
    plain = lambda rows: sorted(str([round(v, 4) if isinstance(v, float) else v for v in x]) for x in rows)
    assert plain(QUERIES[name](spark, sf_dir).select(*names).collect()) == plain(found.fetchall())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, db, name):
    found = db.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    df = QUERIES[name](spark, sf_dir)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, df.select(*names).collect())) == sorted(str(Row(*names)(*x)) for x in found.fetchall())
