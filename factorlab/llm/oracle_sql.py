"""SQL of operators whose statements are built step by step."""

from __future__ import annotations


def codes_sql() -> str:
    """SQL of vector codes: entries and parts by component, five assignments and four moves one after another."""
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)",
        "parts AS MATERIALIZED (SELECT r, i // w AS p, i % w AS j, v[i + 1] AS x FROM (SELECT r, v, unnest(range(len(v))) AS i, len(v) // 4 AS w FROM kept))",
        "c0 AS MATERIALIZED (SELECT p, k, j, x AS y FROM parts JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS k FROM kept ORDER BY vec_id, v LIMIT 256) USING (r))",
    ]
    for t in range(5):
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, p, min({{'d': d, 'k': k}}) AS a FROM (SELECT r, x.p AS p, k, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM parts x JOIN c{t} c ON x.p = c.p AND x.j = c.j GROUP BY r, x.p, k) GROUP BY r, p)")
        if t < 4:
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT c.p AS p, c.k AS k, c.j AS j, coalesce(m, y) AS y FROM c{t} c LEFT JOIN (SELECT x.p AS p, (a).k AS k, j, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM parts x JOIN a{t} a ON x.r = a.r AND x.p = a.p GROUP BY x.p, (a).k, j) n ON c.p = n.p AND c.k = n.k AND c.j = n.j)")
    steps.append("coded AS MATERIALIZED (SELECT r, string_agg(printf('%02x', (a).k), '' ORDER BY p) AS code, CAST(sum((a).d) AS BIGINT) AS error FROM a4 GROUP BY r)")
    steps.append("digest AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY p, k, j)) AS codebooks_sha256 FROM c4)")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), digest"


def repair_sql() -> str:
    """SQL of repairs: the automaton's four states (start, system, user, assistant) row by row, each with its least (cost, letters)."""
    add = lambda a, cost, put: f"{{'c': {a}.c + {cost}, 'l': {a}.l || '{put}'}}"
    more = lambda a, cost, put: f"{{'c': {a}.c + {cost}, 'l': {a}.l || {put}}}"
    none = "{'c': CAST(1000000000000 AS BIGINT), 'l': ''}"
    least = lambda *x: f"list_min([{', '.join(x)}])"
    # insertions first, then the row
    put = f"SELECT t.conv_id, t.i, t.s0, t.s1, {least('t.s2', add('t.s0', 3, 'I'), add('t.s1', 3, 'I'), add('t.s3', 3, 'I'))} AS s2, {least('t.s3', add('t.s2', 3, 'I'), add('t.s0', 6, 'II'), add('t.s1', 6, 'II'))} AS s3 FROM turns t"
    to = lambda a, own: f"CASE WHEN r.gone THEN {none} WHEN r.own = '{own}' THEN {more(a, 'r.cut', chr(39) + 'K' + chr(39))} ELSE {more(a, 'r.cut + 3', chr(39) + 'R' + chr(39))} END"
    return f"""WITH RECURSIVE kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, crc % 20 AS d FROM (SELECT *, CAST({_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} AS BIGINT) AS crc FROM conversations)),
hurt AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE d <> 0),
placed AS (SELECT *, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS own, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM hurt),
judged AS MATERIALIZED (SELECT *, shown = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(own) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
rows_ AS MATERIALIZED (SELECT *, blank OR again AS gone, CASE WHEN right(shown, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS cut FROM judged),
turns AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'l': ''}} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM rows_
  UNION ALL SELECT t.conv_id, r.i, {add('t.s0', 4, 'D')}, {least(add('t.s1', 4, 'D'), f"CASE WHEN r.gone OR r.own <> 's' THEN {none} ELSE {more('t.s0', 'r.cut', chr(39) + 'K' + chr(39))} END")},
    {least(add('t.s2', 4, 'D'), to('t.s0', 'u'), to('t.s1', 'u'), to('t.s3', 'u'))}, {least(add('t.s3', 4, 'D'), to('t.s2', 'a'))}
  FROM ({put}) t JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.i = t.i + 1),
ends AS (SELECT conv_id, max(i) AS n, arg_max({least('s0', add('s0', 6, 'II'), add('s1', 6, 'II'), add('s2', 3, 'I'), 's3')}, i) AS best FROM turns GROUP BY conv_id),
-- the letters one by one, the row that each is of, and what has been put out before it
spelt AS (SELECT conv_id, j, (best.l)[j] AS e FROM (SELECT conv_id, best, unnest(range(1, len(best.l) + 1)) AS j FROM ends)),
rowed AS (SELECT *, count(CASE WHEN e <> 'I' THEN 1 END) OVER w AS i, count(CASE WHEN e <> 'D' THEN 1 END) OVER w AS m, count(CASE WHEN e <> 'D' THEN 1 END) OVER (PARTITION BY conv_id) AS all_m FROM spelt WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
put_out AS (SELECT o.conv_id, j, CASE WHEN e = 'K' THEN r.role ELSE CASE WHEN (all_m - m) % 2 = 0 THEN 'assistant' ELSE 'user' END END || ':' || CASE WHEN e = 'I' THEN '' ELSE r.text END AS line FROM rowed o LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM o.conv_id AND r.i = o.i WHERE e <> 'D'),
text_of AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY j)) AS h FROM put_out GROUP BY conv_id),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(CASE WHEN blank THEN 1 END) AS blank, count(CASE WHEN NOT blank AND again THEN 1 END) AS duplicate, count(CASE WHEN NOT gone AND cut > 0 THEN 1 END) AS truncated,
  count(CASE WHEN before IS NOT NULL AND before || own NOT IN ('su', 'ua', 'au') THEN 1 END) AS illegal FROM rows_ GROUP BY conv_id)
SELECT c.conv_id, {', '.join(f'CAST(coalesce(k.{x}, 0) AS BIGINT) AS {x}' for x in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))}, CAST(coalesce(e.best.c, 0) AS BIGINT) AS cost, coalesce(e.best.l, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counted k ON k.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN text_of t ON t.conv_id IS NOT DISTINCT FROM c.conv_id"""


def _crc32(text: str) -> str:
    """CRC-32 of a short ASCII text, byte by byte and bit by bit."""
    bit = lambda x: f"CASE WHEN {x} & 1 = 1 THEN xor({x} >> 1, 3988292384) ELSE {x} >> 1 END"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(y) AS BIGINT) FOR y IN string_split({text}, '')]), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, k: {bit('c')})), 4294967295)"
