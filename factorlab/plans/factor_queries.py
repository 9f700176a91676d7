"""The registered queries of the factor library, each with its SQL where SQL can say the same."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlab.functions.lineage import kept
from factorlab.functions.windows import Session
from factorlab.operators import evaluate, factors, history, indicators, select, series, sessions, signals, targets
from factorlab.sources.bars import bars_daily, bars_intraday, bars_symbol
from factorlab.sources.features import FeatureTable

from . import bar_sql as sql
from .bar_sql import KEYS, P, W, full, lag, lead, pearson, roll, rounded, with_, zscore
from .registry import ORACLES, query

READ = {"D": bars_daily, "I": bars_intraday, "S": bars_symbol}
H = (5, 15, 30)
OHLCV = ["open", "high", "low", "close", "volume"]


def out(df: DataFrame, columns: list[str], digits: int = 6, keys: tuple[str, ...] = ("symbol", "session", "ts")) -> DataFrame:
    """Keys as text, doubles rounded, so that results can be held against another engine's."""
    text = {"session": F.col("session").cast("string"), "ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss")}
    return df.select(*[text.get(k, F.col(k)).alias(k) for k in keys], *[(F.round(c, digits) + 0.0).alias(c) for c in columns])


def simple(name: str, bars: str, make, columns: list[str], statement: str | None, digits: int = 6) -> None:
    """A query that adds columns to bars."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return out(make(READ[bars](spark, sf_dir)), columns, digits)

    run.__name__ = name
    query(name, statement)(run)


for _name, _bars in (("bars_daily", "D"), ("bars_intraday", "I"), ("bars_symbol", "S")):
    simple(_name, _bars, lambda b: b, OHLCV, f"{with_(_bars)}\nSELECT {KEYS}, {rounded({c: c for c in OHLCV}, 4)} FROM bars", 4)


def _targets(n: int, over: str = W) -> str:
    return f"ln(lead(close, {n}) OVER ({over})) - ln(close)"


simple("targets_log", "D", targets.add_targets, [f"target_return_{n}" for n in H], f"{with_('D')}\nSELECT {KEYS}, {rounded({f'target_return_{n}': _targets(n) for n in H})} FROM bars")
simple("target_simple", "D", targets.add_simple_target, ["target_simple_5"], f"{with_('D')}\nSELECT {KEYS}, {rounded({'target_simple_5': lead('close', 5) + ' / nullif(close, 0) - 1'})} FROM bars")
simple(
    "targets_series_scope",
    "S",
    lambda b: series.series_targets(b, chunk=1000),
    [f"target_return_{n}" for n in H],
    f"{with_('S')}\nSELECT {KEYS}, {rounded({f'target_return_{n}': _targets(n, 'PARTITION BY symbol ORDER BY ts') for n in H})} FROM bars",
)
_SERIES = "PARTITION BY symbol ORDER BY ts"
_LAST = {n: f"OVER ({_SERIES} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in H}
simple(
    "series_momentum",
    "S",
    lambda b: series.series_momentum(b, chunk=1000),
    [f"{c}_{n}" for n in H for c in ("momentum", "zscore", "vol_ratio")],
    f"{with_('S')}\nSELECT {KEYS}, "
    + rounded(
        {
            f"{c}_{n}": e
            for n in H
            for c, e in (
                ("momentum", f"ln(close) - ln(lag(close, {n}) OVER ({_SERIES}))"),
                ("zscore", f"CASE WHEN count(*) {_LAST[n]} >= {n} THEN (close - avg(close) {_LAST[n]}) / nullif(stddev_samp(close) {_LAST[n]}, 0) END"),
                ("vol_ratio", f"CASE WHEN count(*) {_LAST[n]} >= {n} THEN volume / nullif(avg(volume) {_LAST[n]}, 0) END"),
            )
        }
    )
    + " FROM bars",
)

# -- indicators

_FAMILIES = {
    "ind_rsi_wilder": (indicators.rsi, sql.rsi((14, 7, 5, 3))),
    "ind_momentum_pct": (indicators.momentum, sql.momentum((10, 5, 3))),
    "ind_volume_ratio": (indicators.volume_ratio, sql.volume_ratio((15, 20, 30))),
    "ind_macd": (indicators.macd, sql.macd()),
    "ind_price_ema": (indicators.price_ema, sql.price_ema((15, 20, 30))),
    "ind_stoch_k": (indicators.stochastic, sql.stochastic((14, 20, 30))),
    "ind_bollinger_pband": (indicators.bollinger, sql.bollinger((15, 20, 30), (1.5, 2.0, 2.5))),
    "ind_atr_norm": (indicators.atr, sql.atr()),
    "ind_roc": (indicators.roc, sql.roc((5, 10, 20))),
}
for _name, (_make, _family) in _FAMILIES.items():
    _digits = 4 if _name in ("ind_atr_norm", "ind_macd") else 6
    simple(_name, "D", lambda b, f=_make: f(b)[0], list(_family[2]), sql.indicator_sql("D", "close", _family, _digits), _digits)

for _name, _make, _family in (("ind_rsi_wilder_symbols", indicators.rsi, sql.rsi((14, 7, 5, 3))), ("ind_bollinger_symbols", indicators.bollinger, sql.bollinger((15, 20, 30), (1.5, 2.0, 2.5)))):
    simple(_name, "S", lambda b, f=_make: f(b)[0], list(_family[2]), sql.indicator_sql("S", "close", _family))

_GAPPED = f"gapped AS (SELECT * EXCLUDE (close), CASE WHEN i % 11 NOT IN (4, 5) THEN close END AS close FROM bars)"


def _gapped(b: DataFrame) -> DataFrame:
    """Bars of which two closes in eleven are missing."""
    return b.withColumn("close", F.when(~F.pmod(Session().ordinal(), F.lit(11)).isin(4, 5), F.col("close")))


simple("ind_macd_gaps", "D", lambda b: indicators.macd(_gapped(b))[0], ["macd"], sql.macd_of_gaps(_GAPPED, "gapped"), 4)
_PADDED = f"{with_('D', _GAPPED, f'padded AS (SELECT *, last_value(close IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x FROM gapped)')}"
simple("ind_momentum_padded", "D", lambda b: indicators.momentum(_gapped(b), windows=(5,), pad=True)[0], ["momentum_5"], f"{_PADDED}\nSELECT {KEYS}, {rounded({'momentum_5': lag('x', 5).join(['x / nullif(', ', 0) - 1'])})} FROM padded")
simple("bars_slice", "D", lambda b: series.rows_between(b, 25, 59), ["close"], f"{with_('D')}\nSELECT {KEYS}, {rounded({'close': 'close'}, 4)} FROM bars WHERE i BETWEEN 25 AND 59", 4)

_UP = f"greatest(close - {lag('close')}, 0.0)"
_DOWN = f"greatest({lag('close')} - close, 0.0)"
_SMA = {}
for _n in (5, 15, 30):
    _u, _d = full("avg", "up", _n), full("avg", "down", _n)
    _SMA[f"rsi_sma_{_n}"] = f"CASE WHEN {_d} = 0 AND {_u} > 0 THEN 100.0 ELSE 100 - 100 / (1 + {_u} / nullif({_d}, 0)) END"
    _SMA[f"rsi_alpha_{_n}"] = f"{_SMA[f'rsi_sma_{_n}']} - 80"
simple(
    "ind_rsi_sma",
    "D",
    lambda b: indicators.rsi_simple(b)[0],
    list(_SMA),
    f"{with_('D', f'moves AS (SELECT *, CASE WHEN i > 0 THEN {_UP} END AS up, CASE WHEN i > 0 THEN {_DOWN} END AS down FROM bars)')}\nSELECT {KEYS}, {rounded(_SMA)} FROM moves",
)
simple(
    "ind_candle",
    "D",
    lambda b: indicators.candle(b)[0],
    ["body_size", "candle_range", "body_ratio"],
    f"{with_('D')}\nSELECT {KEYS}, {rounded({'body_size': 'abs(close - open)', 'candle_range': 'high - low', 'body_ratio': 'abs(close - open) / nullif(high - low, 0)'})} FROM bars",
)


def _all(x: str) -> list[sql.Family]:
    return [sql.rsi((14, 7, 5, 3)), sql.momentum((10, 5, 3)), sql.macd(), sql.price_ema((15, 20, 30)), sql.stochastic((14, 20, 30)), sql.bollinger((15, 20, 30), (1.5, 2.0, 2.5)), sql.atr(), sql.roc((5, 10, 20)), sql.volume_ratio((15, 20, 30))]


_BUNDLE, _BUNDLE_NAMES = sql.joined("D", "close", _all("close"))
simple("ind_bundle", "D", lambda b: indicators.bundle(b)[0], _BUNDLE_NAMES, f"{_BUNDLE}\nSELECT {KEYS}, {rounded({c: c for c in _BUNDLE_NAMES}, 4)} FROM all_t", 4)
_TARGET_SRC = f"({_targets(30)})"
_BEST = [sql.rsi((14, 7)), sql.macd(), sql.bollinger((20, 30), (2.0,)), sql.atr()]
_ON_TARGET, _ = sql.joined("D", _TARGET_SRC, _BEST)
_BEST_NAMES = ["rsi_14", "rsi_7", "macd", "bb_percent_20_20", "bb_percent_30_20"]
simple("ind_bundle_on_target", "D", lambda b: indicators.best(targets.add_targets(b, (30,)), "target_return_30")[0], _BEST_NAMES, f"{_ON_TARGET}\nSELECT {KEYS}, {rounded({c: c for c in _BEST_NAMES}, 5)} FROM all_t", 5)

# -- factors


def _mom(n: int) -> str:
    return f"ln(close) - ln({lag('close', n)})"


def two_steps(bars: str, first: dict[str, str], then: dict[str, str], digits: int = 6) -> str:
    """Window columns in a first table, and what is computed from them."""
    step = ", ".join(f"{e} AS {n}" for n, e in first.items())
    return f"{with_(bars, f'one AS (SELECT *, {step} FROM bars)')}\nSELECT {KEYS}, {rounded(then, digits)} FROM one"


_M = {f"m{n}": _mom(n) for n in H}
simple("f_momentum_z", "D", factors.momentum_z, [f"{c}_{n}" for n in H for c in ("momentum", "momentum_z")], two_steps("D", _M, {f"momentum_{n}": f"m{n}" for n in H} | {f"momentum_z_{n}": zscore(f"m{n}") for n in H}))
simple("f_rev_momentum_z", "D", factors.rev_momentum_z, [f"rev_momentum_z_{n}" for n in H], two_steps("D", _M, {f"rev_momentum_z_{n}": f"-{zscore(f'm{n}')}" for n in H}))
simple("f_inv_momentum", "D", factors.inv_momentum, [f"inv_momentum_{n}" for n in H], two_steps("D", _M, {f"inv_momentum_{n}": f"-m{n}" for n in H}))
simple(
    "f_momentum_factors",
    "S",
    lambda b: factors.reversal_momentum_factor(factors.momentum_factor(b)),
    ["momentum_factor", "reversal_momentum_factor"],
    two_steps("S", {"m30": _mom(30)}, {"momentum_factor": zscore("m30"), "reversal_momentum_factor": f"-{zscore('m30')}"}),
)
_Z = {f"z{n}": f"(close - {roll('avg', 'close', n)}) / nullif({roll('stddev_samp', 'close', n)}, 0)" for n in H}
simple("f_rolling_z", "D", factors.rolling_z, [f"{c}_{n}" for n in H for c in ("sma", "std", "zscore")], two_steps("D", _Z, {f"sma_{n}": roll("avg", "close", n) for n in H} | {f"std_{n}": roll("stddev_samp", "close", n) for n in H} | {f"zscore_{n}": f"z{n}" for n in H}, 4), 4)
simple("f_reversal_score", "D", factors.reversal_score, [f"reversal_score_{n}" for n in H], two_steps("D", _Z, {f"reversal_score_{n}": zscore(f"z{n}") for n in H}))
simple("f_reversal_media", "S", factors.reversal_media_factor, ["reversal_media_factor"], two_steps("S", _Z, {"reversal_media_factor": zscore("z30")}))
simple("f_mean_reversion", "D", factors.mean_reversion_factor, ["mean_reversion_factor"], two_steps("D", {"q": "1"}, {"mean_reversion_factor": f"(close - {full('avg', 'close', 5)}) / nullif({full('stddev_samp', 'close', 5)}, 0)"}))
_V = {f"v{n}": f"volume / nullif({roll('avg', 'volume', n)}, 0)" for n in H} | {f"mv{n}": f"({_mom(n)}) * volume / nullif({roll('avg', 'volume', n)}, 0)" for n in H}
simple(
    "f_mom_vol_z",
    "D",
    factors.mom_vol_z,
    [f"{c}_{n}" for n in H for c in ("vol_avg", "vol_ratio", "mom_vol", "mom_vol_z")],
    two_steps("D", _V, {k: v for n in H for k, v in ((f"vol_avg_{n}", roll("avg", "volume", n)), (f"vol_ratio_{n}", f"v{n}"), (f"mom_vol_{n}", f"mv{n}"), (f"mom_vol_z_{n}", zscore(f"mv{n}")))}),
)
simple("f_rev_mom_vol_z", "D", factors.rev_mom_vol_z, [f"rev_mom_vol_z_{n}" for n in H], two_steps("D", _V, {f"rev_mom_vol_z_{n}": f"-{zscore(f'mv{n}')}" for n in H}))
simple(
    "f_mom_vol_factor",
    "S",
    factors.mom_vol_factor,
    ["momentum_30", "vol_avg_30", "vol_ratio_30", "mom_vol_30", "mom_vol_z_30"],
    two_steps("S", _M | _V, {"momentum_30": "m30", "vol_avg_30": roll("avg", "volume", 30), "vol_ratio_30": "v30", "mom_vol_30": "-mv30", "mom_vol_z_30": f"-{zscore('mv30')}"}),
)
simple("f_reversion_vol_momentum", "S", factors.reversion_vol_momentum_factor, ["reversion_vol_momentum_factor"], two_steps("S", _V, {"reversion_vol_momentum_factor": f"-{zscore('mv30')}"}))

_OPEN = "strftime(ts, '%H:%M:%S') BETWEEN '08:00:00' AND '09:30:00'"
_RANGE = {"hi": f"max(CASE WHEN {_OPEN} THEN high END) OVER ({P})", "lo": f"min(CASE WHEN {_OPEN} THEN low END) OVER ({P})"}
simple("f_opening_range", "I", factors.opening_range, ["opening_high", "opening_low", "opening_range", "opening_midpoint"], two_steps("I", _RANGE, {"opening_high": "hi", "opening_low": "lo", "opening_range": "hi - lo", "opening_midpoint": "(hi + lo) / 2"}))
_RAW = "raw AS (SELECT *, CASE WHEN strftime(ts, '%H:%M:%S') >= '09:30:00' THEN (close - (hi + lo) / 2) / nullif(hi - lo, 0) END AS r FROM one)"
_ONE = "one AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _RANGE.items()) + " FROM bars)"
simple("f_opening_exhaustion", "I", factors.opening_exhaustion, ["factor30"], f"{with_('I', _ONE, _RAW)}\nSELECT {KEYS}, {rounded({'factor30': zscore('r')})} FROM raw")
simple("f_opening_factor_z", "I", factors.opening_factor_z, [f"factor{n}" for n in H], f"{with_('I', _ONE, _RAW)}\nSELECT {KEYS}, {rounded({f'factor{n}': zscore('r') for n in H})} FROM raw")


@query("opening_ranges", f"{with_('I')}\nSELECT symbol, CAST(session AS VARCHAR) AS session, {rounded({'opening_high': 'max(high)', 'opening_low': 'min(low)', 'opening_range': 'max(high) - min(low)', 'opening_midpoint': '(max(high) + min(low)) / 2'})} FROM bars WHERE {_OPEN} GROUP BY symbol, session")
def opening_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(factors.opening_ranges(bars_intraday(spark, sf_dir)), ["opening_high", "opening_low", "opening_range", "opening_midpoint"], keys=("symbol", "session"))


def _direction(over: str) -> list[str]:
    return [f"signs AS (SELECT *, nullif(sign(close - lag(close, 1) OVER ({over})), 0) AS s FROM bars)", f"dirs AS (SELECT *, last_value(s IGNORE NULLS) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS d FROM signs)"]


simple("f_tick_direction", "D", factors.tick_direction, ["direction"], f"{with_('D', *_direction(W))}\nSELECT {KEYS}, {rounded({'direction': 'CAST(d AS DOUBLE)'})} FROM dirs")
simple("series_direction", "S", lambda b: series.series_direction(b, chunk=1000), ["direction"], f"{with_('S', *_direction(_SERIES))}\nSELECT {KEYS}, {rounded({'direction': 'CAST(d AS DOUBLE)'})} FROM dirs")
_BUY = "(CASE WHEN d > 0 THEN volume ELSE 0.0 END)"
_SELL = "(CASE WHEN d < 0 THEN volume ELSE 0.0 END)"
simple(
    "f_buy_sell_volume",
    "D",
    lambda b: factors.buy_sell_volume(factors.tick_direction(b)),
    ["buy_volume", "sell_volume", "buy_ratio", "sell_ratio"],
    f"{with_('D', *_direction(W))}\nSELECT {KEYS}, {rounded({'buy_volume': _BUY, 'sell_volume': _SELL, 'buy_ratio': f'{_BUY} / nullif(volume, 0)', 'sell_ratio': f'{_SELL} / nullif(volume, 0)'})} FROM dirs",
)
_PRESS = f"press AS (SELECT *, ({_mom(30)}) * {_BUY} / nullif(volume, 0) AS pb, ({_mom(30)}) * {_SELL} / nullif(volume, 0) AS ps FROM dirs)"
simple(
    "f_buy_sell_momentum_rev",
    "D",
    lambda b: factors.buy_sell_momentum_rev(factors.buy_sell_volume(factors.tick_direction(b))),
    ["alpha_factor_buy_momentum_rev", "alpha_factor_sell_momentum_rev"],
    f"{with_('D', *_direction(W), _PRESS)}\nSELECT {KEYS}, {rounded({'alpha_factor_buy_momentum_rev': '-' + zscore('pb'), 'alpha_factor_sell_momentum_rev': '-' + zscore('ps')})} FROM press",
)

_FEATURES = ["target_return_30", *_BEST_NAMES, "atr_norm", *factors.FACTORS]
_TABLE, _ = sql.joined("I", "close", _BEST)
_FEAT1 = f"feat1 AS MATERIALIZED (SELECT *, {_targets(30)} AS target_return_30, {_mom(30)} AS m30, {_Z['z30']} AS z30, {_V['mv30']} AS mv30, {_RANGE['hi']} AS hi, {_RANGE['lo']} AS lo FROM all_t)"
_FEAT2 = "feat2 AS MATERIALIZED (SELECT *, CASE WHEN strftime(ts, '%H:%M:%S') >= '09:30:00' THEN (close - (hi + lo) / 2) / nullif(hi - lo, 0) END AS r FROM feat1)"
_FEAT3 = f"feats AS MATERIALIZED (SELECT symbol, session, ts, i, {', '.join(_FEATURES[:7])}, -{zscore('m30')} AS reversal_momentum_factor, {zscore('z30')} AS reversal_media_factor, -{zscore('mv30')} AS reversion_vol_momentum_factor, {zscore('r')} AS factor30 FROM feat2)"
FEATS = f"{_TABLE},\n{_FEAT1},\n{_FEAT2},\n{_FEAT3}"
simple("feature_table", "I", lambda b: factors.feature_table(b)[0], _FEATURES, f"{FEATS}\nSELECT {KEYS}, {rounded({c: c for c in _FEATURES}, 5)} FROM feats", 5)

# -- signals

_SIG, _ = sql.joined("D", "close", [sql.rsi((14,)), sql.stochastic((14,)), sql.bollinger((20,), (2.0,)), sql.atr()])


def _signal_bars(bars: DataFrame) -> DataFrame:
    df, _ = indicators.rsi(bars, windows=(14,))
    df, _ = indicators.stochastic(df, windows=(14,))
    df, _ = indicators.bollinger(df, windows=(20,), deviations=(2.0,))
    return indicators.atr(df)[0]


simple("sig_reversal_score", "D", lambda b: signals.reversal_signal(_signal_bars(b)), ["rsi_norm", "stoch_k_norm", "reversal_score"], f"{_SIG}\nSELECT {KEYS}, {rounded({'rsi_norm': 'rsi_14 / 100', 'stoch_k_norm': 'stoch_k_14 / 100', 'reversal_score': '1 - (rsi_14 / 100 + stoch_k_14 / 100 + bb_percent_20_20) / 3'})} FROM all_t")
_LOUD = "coalesce(atr_norm > 0.02, false)"
simple("sig_flags", "D", lambda b: signals.flags(_signal_bars(b)), ["volatility_filter", "rebound_trigger"], f"{_SIG}\nSELECT {KEYS}, {rounded({'volatility_filter': f'CAST(CAST({_LOUD} AS INTEGER) AS DOUBLE)', 'rebound_trigger': f'CAST(CAST(coalesce(rsi_14 < 30 AND bb_percent_20_20 < 0.1 AND atr_norm > 0.02, false) AS INTEGER) AS DOUBLE)'})} FROM all_t")
_CLEAN = ["rsi_14", "stoch_k_14", "bb_percent_20_20", "atr_norm"]
simple("sig_clean", "D", lambda b: signals.clean(_signal_bars(b), ["symbol", "session", "ts", *_CLEAN]), _CLEAN, f"{_SIG}\nSELECT {KEYS}, {rounded({c: c for c in _CLEAN})} FROM all_t WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _CLEAN)}")

# -- evaluation

_FZ = ["momentum_z_30", "rev_momentum_z_30", "reversal_score_30"]


def _scored(spark: SparkSession, sf_dir: str, bars: str = "D") -> DataFrame:
    b = targets.add_targets(READ[bars](spark, sf_dir))
    return factors.reversal_score(factors.rev_momentum_z(factors.momentum_z(b)).drop("momentum_5", "momentum_15", "momentum_30"))


_SCORED = [
    f"s1 AS MATERIALIZED (SELECT *, {', '.join(f'{_targets(n)} AS target_return_{n}, {_mom(n)} AS m{n}, ' + _Z[f'z{n}'] + f' AS z{n}' for n in H)} FROM bars)",
    f"s2 AS MATERIALIZED (SELECT symbol, session, ts, i, {', '.join(f'target_return_{n}, ' + zscore(f'm{n}') + f' AS momentum_z_{n}, -' + zscore(f'm{n}') + f' AS rev_momentum_z_{n}, ' + zscore(f'z{n}') + f' AS reversal_score_{n}' for n in H)} FROM s1)",
]
SCORED = with_("D", *_SCORED)


def _unpivoted(table: str, columns: list[str], target: str) -> str:
    return "long AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT symbol, session, ts, i, '{c}' AS factor, {c} AS value, {target} AS target FROM {table}" for c in columns) + ")"


_DAY = "symbol, CAST(session AS VARCHAR) AS session, factor"
_PEARSON_DAY = f"{SCORED}, {_unpivoted('s2', _FZ, 'target_return_30')}\nSELECT {_DAY}, count(CASE WHEN value IS NOT NULL AND target IS NOT NULL THEN 1 END) AS n, {rounded({'ic': pearson('value', 'target')})} FROM long GROUP BY symbol, session, factor"


def _day(df: DataFrame, *more: str) -> DataFrame:
    return df.select("symbol", F.col("session").cast("string").alias("session"), "factor", F.col("n").cast("long").alias("n"), *[(F.round(c, 6) + 0.0).alias(c) for c in ("ic", *more)])


@query("ic_daily_pearson", _PEARSON_DAY)
def ic_daily_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(evaluate.daily_pearson(_scored(spark, sf_dir), _FZ, "target_return_30"))


_COMPLETE = " AND ".join(f"{c}_{n} IS NOT NULL" for n in H for c in ("target_return", "momentum_z", "rev_momentum_z", "reversal_score"))


@query("ic_daily_pearson_dropall", f"{SCORED}, whole AS (SELECT * FROM s2 WHERE {_COMPLETE}), {_unpivoted('whole', _FZ, 'target_return_30')}\nSELECT {_DAY}, count(*) AS n, {rounded({'ic': pearson('value', 'target')})} FROM long GROUP BY symbol, session, factor")
def ic_daily_pearson_dropall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(evaluate.daily_pearson(_scored(spark, sf_dir), _FZ, "target_return_30", drop="all"))


def _horizons(prefix: str) -> str:
    return " UNION ALL ".join(f"SELECT CAST({n} AS INTEGER) AS horizon, round(avg(ic), 6) + 0.0 AS mean_ic FROM (SELECT {pearson(f'{prefix}{n}', f'target_return_{n}')} AS ic FROM s2 GROUP BY symbol, session)" for n in H)


def _mean_ic(df: DataFrame) -> DataFrame:
    return df.select("horizon", *[(F.round(c, 6) + 0.0).alias(c) for c in df.columns if c != "horizon"])


@query("ic_mean_by_horizon", f"{SCORED}\n{_horizons('momentum_z_')}")
def ic_mean_by_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mean_ic(evaluate.evaluate_factor(targets.add_targets(bars_daily(spark, sf_dir)), factors.momentum_z, "momentum_z_"))


@query("ic_mean_by_horizon_dropall", f"{with_('D', *_SCORED[:1])}, s2 AS (SELECT * FROM ({_SCORED[1].split(' AS MATERIALIZED ', 1)[1]}) WHERE {_COMPLETE})\n{_horizons('momentum_z_')}")
def ic_mean_by_horizon_dropall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mean_ic(evaluate.mean_ic_by_horizon(_scored(spark, sf_dir), {n: f"momentum_z_{n}" for n in H}, drop="all"))


_SV = [_SCORED[0].replace(" FROM bars)", ", " + ", ".join(f"{_V[f'mv{n}']} AS mv{n}" for n in H) + " FROM bars)"), f"s2 AS MATERIALIZED (SELECT symbol, session, {', '.join(f'target_return_{n}, -' + zscore(f'm{n}') + f' AS h1_{n}, -' + zscore(f'mv{n}') + f' AS h3_{n}' for n in H)} FROM s1)"]


@query("ic_compare_h1_h3", f"{with_('D', *_SV)}\nSELECT a.horizon, a.mean_ic AS h1, b.mean_ic AS h3 FROM ({_horizons('h1_')}) a JOIN ({_horizons('h3_')}) b USING (horizon)")
def ic_compare_h1_h3(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = targets.add_targets(bars_daily(spark, sf_dir))
    one = evaluate.evaluate_factor(b, factors.rev_momentum_z, "rev_momentum_z_")
    three = evaluate.evaluate_factor(b, factors.rev_mom_vol_z, "rev_mom_vol_z_")
    return _mean_ic(evaluate.compare(one, three, ("h1", "h3")))


def _spearman(least: int) -> list[str]:
    rank = lambda c: f"rank() OVER (PARTITION BY factor, symbol, session ORDER BY {c}) + (count(*) OVER (PARTITION BY factor, symbol, session, {c}) - 1) / 2.0"
    return [
        f"ranked AS (SELECT *, {rank('value')} AS rx, {rank('target')} AS ry FROM long WHERE value IS NOT NULL AND target IS NOT NULL)",
        f"daily AS MATERIALIZED (SELECT * FROM (SELECT symbol, session, factor, count(*) AS n, {pearson('rx', 'ry')} AS ic FROM ranked GROUP BY symbol, session, factor) WHERE n >= {least} AND ic IS NOT NULL)",
    ]


_IND, _IND_NAMES = sql.joined("D", "close", _all("close"))
_IND_NAMES = [c for c in _IND_NAMES if c != "atr"]
_IND_LONG = f"{_IND}, tgt AS MATERIALIZED (SELECT *, {_targets(30)} AS target_return_30 FROM all_t), {_unpivoted('tgt', _IND_NAMES, 'target_return_30')}, {', '.join(_spearman(20))}"


def _indicator_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = indicators.bundle(targets.add_targets(bars_daily(spark, sf_dir), (30,)))[0]
    return evaluate.daily_spearman(df, _IND_NAMES, "target_return_30")


@query("ic_daily_spearman", f"{_IND_LONG}\nSELECT {_DAY}, n, {rounded({'ic': 'ic'})} FROM daily")
def ic_daily_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(_indicator_days(spark, sf_dir))


_SYM_LONG = f"{with_('S', *_SCORED)}, {_unpivoted('s2', _FZ, 'target_return_30')}, {', '.join(_spearman(20))}"


@query("ic_daily_spearman_symbols", f"{_SYM_LONG}\nSELECT {_DAY}, n, {rounded({'ic': 'ic'})} FROM daily")
def ic_daily_spearman_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(evaluate.daily_spearman(_scored(spark, sf_dir, "S"), _FZ, "target_return_30"))


_SUMMARY = "SELECT factor, avg(ic) AS ic_mean, stddev_pop(ic) AS ic_std, count(*) AS n_days FROM daily GROUP BY factor"


def _summary(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("factor", *[(F.round(c, 6) + 0.0).alias(c) for c in columns], "n_days")


@query("ic_summary", f"{_IND_LONG}\nSELECT factor, {rounded({'ic_mean': 'ic_mean', 'ic_std': 'ic_std'})}, n_days FROM ({_SUMMARY})")
def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(evaluate.ic_summary(_indicator_days(spark, sf_dir)), "ic_mean", "ic_std")


@query("ic_score", f"{_IND_LONG}\nSELECT factor, {rounded({'ic_mean': 'ic_mean', 'ic_std': 'ic_std', 'ic_score': 'abs(ic_mean) / nullif(ic_std, 0)'})}, n_days FROM ({_SUMMARY})")
def ic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summary(evaluate.ic_score(evaluate.ic_summary(_indicator_days(spark, sf_dir))), "ic_mean", "ic_std", "ic_score").orderBy(F.col("ic_score").desc())


_INTRA = [f"f1 AS MATERIALIZED (SELECT *, ln({lead('close', 5)}) - ln(close) AS target_return_5, {_mom(5)} AS m5, {_Z['z5']} AS z5 FROM bars)", f"f2 AS MATERIALIZED (SELECT symbol, session, ts, i, target_return_5, -{zscore('m5')} AS rev_momentum_z_5, {zscore('z5')} AS reversal_score_5 FROM f1)"]
_F5 = ["rev_momentum_z_5", "reversal_score_5"]


def _intraday_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = targets.add_targets(bars_intraday(spark, sf_dir), (5,))
    return factors.reversal_score(factors.rev_momentum_z(b, (5,)), (5,))


_ROLL = "CASE WHEN count(ic) OVER (PARTITION BY symbol, factor ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) >= 20 THEN avg(ic) OVER (PARTITION BY symbol, factor ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END"
_DAYS = "days AS (SELECT d.symbol, d.session, d.factor, coalesce(n, 0) AS n, ic FROM (SELECT DISTINCT symbol, session, factor FROM long) d LEFT JOIN daily USING (symbol, session, factor))"


@query("ic_rolling20", f"{with_('I', *_INTRA, _unpivoted('f2', _F5, 'target_return_5'), *_spearman(30))}, {_DAYS}\nSELECT {_DAY}, CASE WHEN ic IS NULL THEN 0 ELSE n END AS n, {rounded({'ic': 'ic', 'ic_moving': _ROLL})} FROM days")
def ic_rolling20(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = evaluate.daily_spearman(_intraday_scored(spark, sf_dir), _F5, "target_return_5", least=30, keep_short=True)
    daily = daily.withColumn("n", F.when(F.col("ic").isNotNull(), F.col("n")).otherwise(0))
    return _day(evaluate.rolling_ic(daily), "ic_moving")


_MINUTE = f"{with_('I', *_INTRA, _unpivoted('f2', _F5, 'target_return_5'))}, minutes AS (SELECT factor, CAST(i AS INTEGER) AS minute_index, count(CASE WHEN value IS NOT NULL AND target IS NOT NULL THEN 1 END) AS n, {pearson('value', 'target')} AS ic FROM long GROUP BY factor, i)"


def _minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ic_by_minute(_intraday_scored(spark, sf_dir), _F5, "target_return_5")


@query("ic_by_minute", f"{_MINUTE}\nSELECT factor, minute_index, n, {rounded({'ic': 'ic'})} FROM minutes WHERE n > 0")
def ic_by_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minutes(spark, sf_dir).select("factor", "minute_index", "n", (F.round("ic", 6) + 0.0).alias("ic"))


@query("ic_minute_wide", f"{_MINUTE}\nSELECT minute_index, {rounded({f: f"max(CASE WHEN factor = '{f}' THEN ic END)" for f in _F5})} FROM minutes WHERE n > 0 GROUP BY minute_index")
def ic_minute_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = evaluate.minutes_wide(_minutes(spark, sf_dir), _F5)
    return wide.select("minute_index", *[(F.round(f, 6) + 0.0).alias(f) for f in _F5])


def _extremes_sql(mode: str) -> str:
    order = "ic ASC" if mode == "worst" else "ic DESC"
    clock = "strftime(TIMESTAMP '2000-01-01 08:00:00' + to_minutes(CAST({} AS BIGINT)), '%H:%M')"
    return f"""{_MINUTE}, ranked AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY {order}, minute_index) AS r FROM minutes WHERE ic IS NOT NULL)
SELECT factor, round(min(ic), 6) + 0.0 AS ic_min, {clock.format('first(minute_index ORDER BY ic, minute_index)')} AS time_min, round(max(ic), 6) + 0.0 AS ic_max,
  {clock.format('first(minute_index ORDER BY ic DESC, minute_index)')} AS time_max, round(avg(CASE WHEN r <= 30 THEN ic END), 6) + 0.0 AS mean_extreme FROM ranked GROUP BY factor"""


def _extremes(df: DataFrame) -> DataFrame:
    return df.select("factor", *[((F.round(c, 6) + 0.0) if c[:4] != "time" else F.col(c)).alias(c) for c in ("ic_min", "time_min", "ic_max", "time_max", "mean_extreme")])


@query("ic_extremes_worst", _extremes_sql("worst"))
def ic_extremes_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extremes(evaluate.ic_extremes(_minutes(spark, sf_dir), "worst"))


@query("ic_extremes_best", _extremes_sql("best"))
def ic_extremes_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extremes(evaluate.ic_extremes(_minutes(spark, sf_dir), "best"))


def _history(spark: SparkSession, sf_dir: str) -> history.IcHistory:
    """The sessions of a month added in three batches, the last of them twice."""
    df = kept(_intraday_scored(spark, sf_dir).select("symbol", "session", "ts", *_F5, "target_return_5"))
    found = history.IcHistory(spark, f"{spark.sparkContext.getCheckpointDir()}/history-{uuid.uuid4().hex}", _F5, "target_return_5")
    first = df.agg(F.min("session")).first()[0]
    if first is None:
        raise ValueError("there are no bars")
    tenth = F.least(F.floor(F.datediff("session", F.lit(first)) / 10), F.lit(2))
    for k in (0, 1, 2, 2):
        found.add(df.filter(tenth == k), f"batch-{k}")
    return found


@query("ic_history_moving", f"{with_('I', *_INTRA, _unpivoted('f2', _F5, 'target_return_5'), *_spearman(30))}, {_DAYS}\nSELECT {_DAY}, {rounded({'ic': 'ic', 'ic_moving': _ROLL})} FROM days")
def ic_history_moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day(_history(spark, sf_dir).moving(), "ic_moving").drop("n")


@query("ic_history_minutes", f"{_MINUTE}\nSELECT factor, minute_index, n, {rounded({'ic': 'ic'})} FROM minutes WHERE n > 0")
def ic_history_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).by_minute().select("factor", F.col("minute_index").cast("int").alias("minute_index"), "n", (F.round("ic", 6) + 0.0).alias("ic"))


# -- functions of a session, and kept features


def _drawdown(table: pa.Table) -> dict:
    """How far the close is below the session's highest so far, and the session's largest fall until now."""
    close = np.array(table.column("close"), dtype=np.float64)
    below = close / np.maximum.accumulate(close) - 1
    return {"drawdown": below, "worst": np.minimum.accumulate(below)}


_TOP_SO_FAR = f"tops AS (SELECT *, close / max(close) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS drawdown FROM bars)"
simple(
    "session_drawdown",
    "S",
    lambda b: sessions.add_by_session(b, _drawdown, "drawdown double, worst double"),
    ["drawdown", "worst"],
    f"{with_('S', _TOP_SO_FAR)}\nSELECT {KEYS}, {rounded({'drawdown': 'drawdown', 'worst': f'min(drawdown) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)'})} FROM tops",
)


def _stored(bars: DataFrame) -> DataFrame:
    """Momentum that was written to a feature table, its last session twice, and the factors that windows make of what is read back."""
    spark = bars.sparkSession
    mark = uuid.uuid4().hex
    df = kept(bars)
    table = FeatureTable(spark, f"{spark.sparkContext.getCheckpointDir()}/features-{mark}", f"features_{mark}", buckets=8)
    table.write(df)
    last = df.agg(F.max("session")).first()[0]
    table.write(df.filter(F.col("session") == F.lit(last)))
    return factors.reversal_momentum_factor(factors.momentum_factor(table.read()))


simple("feature_store_factors", "S", _stored, ["momentum_factor", "reversal_momentum_factor"], ORACLES["f_momentum_factors"])

_G = "factor, symbol, session"
_QUINTILE = f"""{SCORED}, {_unpivoted('s2', _FZ, 'target_return_30')}, both_t AS MATERIALIZED (SELECT * FROM long WHERE value IS NOT NULL AND target IS NOT NULL),
edges AS (SELECT {_G}, count(*) AS n, quantile_cont(value, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM both_t GROUP BY {_G}),
good AS (SELECT * FROM edges WHERE n >= 30 AND len(list_distinct(e)) = 6),
placed AS (SELECT both_t.*, CASE WHEN value <= e[2] THEN 0 WHEN value <= e[3] THEN 1 WHEN value <= e[4] THEN 2 WHEN value <= e[5] THEN 3 ELSE 4 END AS q FROM both_t JOIN good USING ({_G})),
bins AS (SELECT {_G}, q, avg(target) AS m FROM placed GROUP BY {_G}, q),
kept AS (SELECT *, count(*) OVER (PARTITION BY {_G}) AS b FROM bins)
SELECT factor, CAST(q AS INTEGER) AS q, round(avg(m), 6) + 0.0 AS mean_return, count(*) AS n_days FROM kept WHERE b = 5 GROUP BY factor, q"""


@query("quintile_returns", _QUINTILE)
def quintile_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.quintile_returns(_scored(spark, sf_dir), _FZ, "target_return_30").select("factor", "q", (F.round("mean_return", 6) + 0.0).alias("mean_return"), "n_days")


# -- correlation and selection


def _pairs_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS factor_1, '{b}' AS factor_2, {pearson(a, b)} AS corr FROM {table}" for k, a in enumerate(columns) for b in columns[k + 1 :])


def _pairs(df: DataFrame) -> DataFrame:
    return df.select("factor_1", "factor_2", (F.round("corr", 6) + 0.0).alias("corr"))


def _indicator_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.bundle(targets.add_targets(bars_daily(spark, sf_dir), (30,)))[0]


@query("corr_pearson_pairs", f"{_IND}\nSELECT factor_1, factor_2, {rounded({'corr': 'corr'})} FROM ({_pairs_sql('all_t', _IND_NAMES)})")
def corr_pearson_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(select.pearson_pairs(_indicator_bars(spark, sf_dir), _IND_NAMES))


_TOP = f"""{_IND_LONG}, pairs AS MATERIALIZED ({_pairs_sql('all_t', _IND_NAMES)}), ways AS (SELECT * FROM pairs UNION ALL SELECT factor_2, factor_1, corr FROM pairs),
near AS (SELECT *, row_number() OVER (PARTITION BY factor_1 ORDER BY round(abs(corr), 9) DESC, factor_2) AS k FROM ways WHERE corr IS NOT NULL)
SELECT s.factor, round(abs(ic_mean) / nullif(ic_std, 0), 6) + 0.0 AS ic_score, {', '.join(f"max(CASE WHEN k = {k} THEN factor_2 END) AS corr_ind_{k}, round(max(CASE WHEN k = {k} THEN corr END), 6) + 0.0 AS corr_value_{k}" for k in range(1, 6))}
FROM ({_SUMMARY}) s LEFT JOIN near ON near.factor_1 = s.factor GROUP BY s.factor, ic_mean, ic_std"""


@query("corr_top5", _TOP)
def corr_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = evaluate.ic_score(evaluate.ic_summary(_indicator_days(spark, sf_dir)))
    # equal correlations (bands of other widths, rates and momenta) differ in the last digit only
    pairs = select.pearson_pairs(_indicator_bars(spark, sf_dir), _IND_NAMES, both_ways=True).withColumn("corr", F.round("corr", 9))
    df = select.top_neighbours(pairs, scores)
    return df.select("factor", *[(F.col(c) if c.startswith("corr_ind") else (F.round(c, 6) + 0.0)).alias(c) for c in df.columns if c != "factor"])


_CF = ["target_return_30", *_BEST_NAMES, "atr_norm", *factors.FACTORS]


def _rank_pairs_sql(table: str, columns: list[str]) -> str:
    """Each pair is ranked over the rows that have both."""
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return " UNION ALL ".join(f"SELECT '{a}' AS factor_1, '{b}' AS factor_2, {pearson('x', 'y')} AS corr FROM (SELECT {rank(a)} AS x, {rank(b)} AS y FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)" for k, a in enumerate(columns) for b in columns[k + 1 :])


_SPEARMAN = {bars: f"{FEATS.replace(sql.INTRADAY, table)}, pairs AS MATERIALIZED ({_rank_pairs_sql('feats', _CF)})" for bars, table in (("D", sql.DAILY), ("I", sql.INTRADAY))}


def _spearman_pairs(spark: SparkSession, sf_dir: str, bars: str = "D") -> DataFrame:
    df, _ = factors.feature_table(READ[bars](spark, sf_dir))
    return select.spearman_pairs(df, _CF, ["symbol", "session", "ts"])


def _spearman_queries(bars: str, suffix: str) -> None:
    """All pairs, those with the target, and the ten strongest."""

    @query(f"corr_spearman_pairs{suffix}", f"{_SPEARMAN[bars]}\nSELECT factor_1, factor_2, {rounded({'corr': 'corr'})} FROM pairs")
    def corr_spearman_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _pairs(_spearman_pairs(spark, sf_dir, bars))

    @query(f"corr_target{suffix}", f"{_SPEARMAN[bars]}\nSELECT factor_2 AS factor, {rounded({'corr_target': 'corr'})} FROM pairs WHERE factor_1 = 'target_return_30'")
    def corr_target(spark: SparkSession, sf_dir: str) -> DataFrame:
        return select.corr_with(_spearman_pairs(spark, sf_dir, bars), "target_return_30").select("factor", (F.round("corr_target", 6) + 0.0).alias("corr_target")).orderBy(F.abs("corr_target").desc())

    @query(f"corr_top10{suffix}", f"{_SPEARMAN[bars]}\nSELECT factor_1, factor_2, {rounded({'corr': 'corr'})} FROM pairs WHERE corr IS NOT NULL ORDER BY abs(pairs.corr) DESC, factor_1, factor_2 LIMIT 10")
    def corr_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _pairs(select.strongest(_spearman_pairs(spark, sf_dir, bars)))


_spearman_queries("D", "")
_spearman_queries("I", "_intraday")


# one row for each factor, in order of score; the names selected so far are carried along
_GREEDY = f"""{_IND_LONG}, pairs AS MATERIALIZED ({_pairs_sql('all_t', _IND_NAMES)}),
ways AS (SELECT factor_1, factor_2, round(abs(corr), 9) AS c FROM pairs WHERE corr IS NOT NULL UNION ALL SELECT factor_2, factor_1, round(abs(corr), 9) FROM pairs WHERE corr IS NOT NULL),
near AS (SELECT factor_1 AS factor, list({{'f': factor_2, 'c': c}}) AS near FROM ways GROUP BY factor_1),
scored AS (SELECT factor, round(abs(ic_mean) / nullif(ic_std, 0), 9) AS ic_score FROM ({_SUMMARY})),
in_turn AS MATERIALIZED (SELECT s.factor, ic_score, near, row_number() OVER (ORDER BY ic_score DESC, s.factor) AS k FROM scored s LEFT JOIN near USING (factor) WHERE ic_score IS NOT NULL),
turns AS (SELECT CAST(0 AS BIGINT) AS k, CAST('' AS VARCHAR) AS factor, CAST(0 AS DOUBLE) AS ic_score, CAST(0 AS DOUBLE) AS max_corr, FALSE AS selected, CAST([] AS VARCHAR[]) AS chosen
  UNION ALL SELECT k, factor, ic_score, most, taken, CASE WHEN taken THEN list_append(chosen, factor) ELSE chosen END FROM (
    SELECT *, (ic_score >= 0.4 AND most < 0.925) OR (ic_score >= 0.35 AND most < 0.7) AS taken FROM (
      SELECT r.k, r.factor, r.ic_score, t.chosen, coalesce(list_max([x.c FOR x IN r.near IF list_contains(t.chosen, x.f)]), 0.0) AS most
      FROM turns t JOIN in_turn r ON r.k = t.k + 1)))
SELECT factor, round(ic_score, 6) + 0.0 AS ic_score, round(max_corr, 6) + 0.0 AS max_corr, selected FROM turns WHERE k > 0"""


@query("select_greedy", _GREEDY)
def select_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and correlations that differ in the last digits only count as equal."""
    scores = evaluate.ic_score(evaluate.ic_summary(_indicator_days(spark, sf_dir))).withColumn("ic_score", F.round("ic_score", 9))
    pairs = select.pearson_pairs(_indicator_bars(spark, sf_dir), _IND_NAMES).withColumn("corr", F.round("corr", 9))
    found = select.select_greedy(scores, pairs)
    return found.select("factor", *[(F.round(c, 6) + 0.0).alias(c) for c in ("ic_score", "max_corr")], "selected")
