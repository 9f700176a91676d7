"""SQL building blocks for the oracles: bars, windows, and smoothing by recursion, another route than the library's closed forms."""

from __future__ import annotations

P = "PARTITION BY symbol, session"
W = f"{P} ORDER BY ts"

_EDGE = "l_orderkey, l_linenumber, l_extendedprice"


def _daily(symbol: str, source: str) -> str:
    return f"""bars AS MATERIALIZED (
  SELECT *, row_number() OVER ({W}) - 1 AS i FROM (
    SELECT {symbol} AS symbol, CAST(year(l_shipdate) AS INTEGER) AS session, l_shipdate AS ts, first(l_extendedprice ORDER BY {_EDGE}) AS open,
      max(l_extendedprice) AS high, min(l_extendedprice) AS low, last(l_extendedprice ORDER BY {_EDGE}) AS close, sum(l_quantity) AS volume
    FROM {source} GROUP BY 1, 2, 3))"""


DAILY = _daily("'ALL'", "lineitem")
SYMBOL = _daily("p_brand", "lineitem JOIN part ON l_partkey = p_partkey")
INTRADAY = f"""bars AS MATERIALIZED (
  SELECT *, row_number() OVER ({W}) - 1 AS i FROM (
    SELECT 'ALL' AS symbol, CAST(time_bucket(INTERVAL '15 minutes', ts) AS DATE) AS session, time_bucket(INTERVAL '15 minutes', ts) AS ts, first(value + 100 ORDER BY events.ts, value) AS open,
      max(value + 100) AS high, min(value + 100) AS low, last(value + 100 ORDER BY events.ts, value) AS close, CAST(count(*) AS DOUBLE) AS volume
    FROM events GROUP BY 1, 2, time_bucket(INTERVAL '15 minutes', ts)))"""
BARS = {"D": DAILY, "I": INTRADAY, "S": SYMBOL}

KEYS = "symbol, CAST(session AS VARCHAR) AS session, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"


def rounded(columns: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"round({e}, {digits}) + 0.0 AS {n}" for n, e in columns.items())


def lag(c: str, n: int = 1) -> str:
    return f"lag({c}, {n}) OVER ({W})"


def lead(c: str, n: int) -> str:
    return f"lead({c}, {n}) OVER ({W})"


def roll(f: str, c: str, n: int) -> str:
    return f"{f}({c}) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(f: str, c: str, n: int) -> str:
    return f"(CASE WHEN {roll('count', c, n)} >= {n} THEN {roll(f, c, n)} END)"


def zscore(c: str) -> str:
    return f"(({c} - avg({c}) OVER ({P})) / nullif(stddev_samp({c}) OVER ({P}), 0))"


def pearson(x: str, y: str) -> str:
    a, b = (f"(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {c} END)" for c in (x, y))
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


def with_(bars: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([BARS[bars], *parts])


def recursive(name: str, base: str, columns: dict[str, tuple[str, str]], start: int = 0) -> str:
    """{name}: rows of base from i = start on; column -> (first value, next value with p.<column> for the row before)."""
    first = ", ".join(f"{a} AS {n}" for n, (a, _) in columns.items())
    then = ", ".join(b for _, b in columns.values())
    return f"""{name} AS (
  SELECT b.symbol, b.session, b.ts, b.i, {first} FROM {base} b WHERE b.i = {start}
  UNION ALL SELECT b.symbol, b.session, b.ts, b.i, {then} FROM {base} b JOIN {name} p ON b.symbol = p.symbol AND b.session = p.session AND b.i = p.i + 1)"""


def ema(x: str, name: str, alpha: str) -> tuple[str, str]:
    return f"b.{x}", f"CASE WHEN b.{x} IS NULL THEN p.{name} ELSE {alpha} * b.{x} + (1 - {alpha}) * p.{name} END"


# -- indicator families on the column x of a table `src`: (further CTEs, name of the table that has the columns, {column: expression})

Family = tuple[list[str], str, dict[str, str]]


def source(x: str) -> str:
    return f"src AS MATERIALIZED (SELECT *, {x} AS x FROM bars)"


def rsi(windows: tuple[int, ...]) -> Family:
    step = f"(x - {lag('x')})"
    moves = f"moves AS MATERIALIZED (SELECT *, CASE WHEN {step} > 0 THEN {step} ELSE 0.0 END AS up, CASE WHEN {step} < 0 THEN -{step} ELSE 0.0 END AS down FROM src)"
    columns = {f"{k}{n}": ema(c, f"{k}{n}", f"(1.0 / {n})") for n in windows for k, c in (("u", "up"), ("d", "down"))}
    return [moves, recursive("wilder", "moves", columns)], "wilder", {f"rsi_{n}": f"CASE WHEN i >= {n - 1} THEN CASE WHEN d{n} = 0 THEN 100.0 ELSE 100 - 100 / (1 + u{n} / nullif(d{n}, 0)) END END" for n in windows}


def macd() -> Family:
    two = recursive("two", "src", {"f": ema("x", "f", "(2.0 / 13)"), "s": ema("x", "s", "(2.0 / 27)")})
    line = "line AS MATERIALIZED (SELECT symbol, session, ts, i, f - s AS m FROM two)"
    signal = recursive("signal", "line", {"m": ("b.m", "b.m"), "g": ema("m", "g", "(2.0 / 10)")}, 25)
    table = "macd_t AS (SELECT symbol, session, ts, CASE WHEN src.i >= 33 THEN m - g END AS h FROM src LEFT JOIN signal USING (symbol, session, ts))"
    return [two, line, signal, table], "macd_t", {"macd": "h"}


def macd_of_gaps(gapped: str, table: str) -> str:
    """macd of a close that can be missing, row by row: w is the weight that the last mean has at this row."""

    def mean(x: str, n: str, alpha: str) -> dict[str, tuple[str, str]]:
        then = f"CASE WHEN b.{x} IS NULL THEN p.{n} WHEN p.{n} IS NULL THEN b.{x} ELSE ({alpha} * b.{x} + p.w{n} * p.{n}) / ({alpha} + p.w{n}) END"
        return {n: (f"b.{x}", then), f"w{n}": (f"1 - {alpha}", f"CASE WHEN b.{x} IS NULL THEN p.w{n} * (1 - {alpha}) ELSE 1 - {alpha} END")}

    two = recursive("two", "src", mean("x", "f", "(2.0 / 13)") | mean("x", "s", "(2.0 / 27)"))
    so_far = f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    line = f"line AS MATERIALIZED (SELECT symbol, session, ts, src.i, CASE WHEN count(x) {so_far} >= 26 THEN f - s END AS m FROM src JOIN two USING (symbol, session, ts))"
    signal = recursive("signal", "line", mean("m", "g", "(2.0 / 10)"))
    value = f"CASE WHEN count(m) {so_far} >= 9 THEN m - g END"
    return f"{with_('D', gapped, f'src AS MATERIALIZED (SELECT *, close AS x FROM {table})', two, line, signal)}\nSELECT {KEYS}, {rounded({'macd': value}, 4)} FROM line JOIN signal USING (symbol, session, ts)"


def price_ema(spans: tuple[int, ...]) -> Family:
    columns = {}
    for n in spans:
        r = f"(1 - 2.0 / {n + 1})"
        columns[f"n{n}"] = "coalesce(b.x, 0)::DOUBLE", f"coalesce(b.x, 0) + {r} * p.n{n}"
        columns[f"d{n}"] = "CASE WHEN b.x IS NULL THEN 0::DOUBLE ELSE 1::DOUBLE END", f"CASE WHEN b.x IS NULL THEN 0 ELSE 1 END + {r} * p.d{n}"
    columns["x"] = "b.x", "b.x"
    return [recursive("weighted", "src", columns)], "weighted", {f"price_ema{n}": f"x / nullif(n{n} / nullif(d{n}, 0), 0) - 1" for n in spans}


def atr() -> Family:
    ranges = f"ranges AS MATERIALIZED (SELECT *, greatest(high - low, coalesce(abs(high - {lag('x')}), high - low), coalesce(abs(low - {lag('x')}), high - low)) AS tr FROM src)"
    seeded = f"seeded AS MATERIALIZED (SELECT *, avg(CASE WHEN i < 14 THEN tr END) OVER ({P}) AS seed FROM ranges)"
    smooth = recursive("smooth", "seeded", {"a": ("b.seed", "(p.a * 13 + b.tr) / 14")}, 13)
    table = "atr_t AS (SELECT symbol, session, ts, x, CASE WHEN src.i < 13 THEN 0.0 ELSE a END AS a FROM src LEFT JOIN smooth USING (symbol, session, ts))"
    return [ranges, seeded, smooth, table], "atr_t", {"atr": "a", "atr_norm": "a / nullif(x, 0)"}


def momentum(windows: tuple[int, ...]) -> Family:
    return [], "src", {f"momentum_{n}": f"x / nullif({lag('x', n)}, 0) - 1" for n in windows}


def roc(windows: tuple[int, ...]) -> Family:
    return [], "src", {f"roc_{n}": f"100 * (x - {lag('x', n)}) / nullif({lag('x', n)}, 0)" for n in windows}


def volume_ratio(windows: tuple[int, ...]) -> Family:
    return [], "src", {f"volume_ratio_{n}": f"volume / nullif({full('avg', 'volume', n)}, 0)" for n in windows}


def stochastic(windows: tuple[int, ...]) -> Family:
    return [], "src", {f"stoch_k_{n}": f"100 * (x - {full('min', 'low', n)}) / nullif({full('max', 'high', n)} - {full('min', 'low', n)}, 0)" for n in windows}


def bollinger(windows: tuple[int, ...], deviations: tuple[float, ...]) -> Family:
    return [], "src", {f"bb_percent_{n}_{round(10 * k)}": f"0.5 + (x - {full('avg', 'x', n)}) / nullif(2 * {k} * {full('stddev_pop', 'x', n)}, 0)" for k in deviations for n in windows}


def indicator_sql(bars: str, x: str, family: Family, digits: int = 6) -> str:
    parts, table, columns = family
    return f"{with_(bars, source(x), *parts)}\nSELECT {KEYS}, {rounded(columns, digits)} FROM {table}"


def joined(bars: str, x: str, families: list[Family], digits: int = 6) -> tuple[str, list[str]]:
    """CTEs up to `all_t`, which has the columns of several families beside those of the bars, and the columns."""
    parts, names, tables = [source(x)], [], []
    for k, (own, table, columns) in enumerate(families):
        parts += own + [f"fam{k} AS MATERIALIZED (SELECT symbol, session, ts, {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {table})"]
        tables.append(f"fam{k}")
        names += list(columns)
    parts.append(f"all_t AS MATERIALIZED (SELECT * FROM src {' '.join(f'JOIN {t} USING (symbol, session, ts)' for t in tables)})")
    return with_(bars, *parts), names
