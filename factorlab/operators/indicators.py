"""Technical indicators per session. Each function takes (df, source column, windows) and returns (df, names of the new columns).

The source is `close` by default. With a forward return as the source, indicators look ahead; that is possible, but only of use to repeat
such results.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlab.functions.safe import div
from factorlab.functions.scan import Compute, Scan, scanned
from factorlab.functions.windows import Session

Result = tuple[DataFrame, list[str]]


class Recursive:
    """An indicator that is a recursion along a session: what it reads, what it makes, and how. Several go over the rows together."""

    def __init__(self, sources: list[str], names: list[str], compute: Compute) -> None:
        self.sources, self.names, self.compute = sources, names, compute

    @staticmethod
    def add(df: DataFrame, keys: list[str] | None, *families: Recursive) -> Result:
        names = [n for f in families for n in f.names]

        def compute(x: dict[str, np.ndarray], scan: Scan) -> dict[str, np.ndarray]:
            out: dict[str, np.ndarray] = {}
            for f in families:
                out |= f.compute(x, scan)
            return out

        return scanned(df, Session(keys), list(dict.fromkeys(c for f in families for c in f.sources)), names, compute), names


def _rsi(src: str, windows: tuple[int, ...]) -> Recursive:
    def compute(x: dict[str, np.ndarray], scan: Scan) -> dict[str, np.ndarray]:
        step = x[src] - scan.previous(x[src])
        gain, loss = np.where(step > 0, step, 0.0), np.where(step < 0, -step, 0.0)
        out = {}
        for n in windows:
            up, down = scan.smooth(gain, 1 / n), scan.smooth(loss, 1 / n)
            value = np.where(down == 0, 100.0, 100 - 100 / (1 + up / down))
            out[f"rsi_{n}"] = np.where(x["place"] >= n - 1, value, np.nan)
        return out

    return Recursive([src], [f"rsi_{n}" for n in windows], compute)


def rsi(df: DataFrame, src: str = "close", windows: tuple[int, ...] = (14, 7, 5, 3), keys: list[str] | None = None) -> Result:
    """Relative strength by Wilder's smoothing. A missing difference counts as none; without losses it is 100; the first N - 1 rows are NULL."""
    return Recursive.add(df, keys, _rsi(src, windows))


def rsi_simple(df: DataFrame, src: str = "close", windows: tuple[int, ...] = (5, 15, 30), offset: float = 80.0, keys: list[str] | None = None) -> Result:
    """Relative strength from plain rolling means, and rsi_alpha_N, the same less `offset`. No losses and some gains: 100; neither: NULL."""
    s = Session(keys)
    step = s.difference(src)
    df = df.withColumns({"_up": F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))), "_down": F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0)))})
    names = []
    for n in windows:
        up, down = s.rolling("_up", n, F.avg), s.rolling("_down", n, F.avg)
        df = df.withColumns({"_u": up, "_d": down})
        df = df.withColumn(f"rsi_sma_{n}", F.when((F.col("_d") == 0) & (F.col("_u") > 0), F.lit(100.0)).otherwise(100 - 100 / (1 + div("_u", "_d"))))
        df = df.withColumn(f"rsi_alpha_{n}", F.col(f"rsi_sma_{n}") - offset).drop("_u", "_d")
        names += [f"rsi_sma_{n}", f"rsi_alpha_{n}"]
    return df.drop("_up", "_down"), names


def momentum(df: DataFrame, src: str = "close", windows: tuple[int, ...] = (10, 5, 3), pad: bool = False, keys: list[str] | None = None) -> Result:
    """Relative change over n rows; with pad, missing values repeat the last one before."""
    s = Session(keys)
    return df.withColumns({f"momentum_{n}": s.change(src, n, pad) for n in windows}), [f"momentum_{n}" for n in windows]


def volume_ratio(df: DataFrame, src: str = "volume", windows: tuple[int, ...] = (15, 20, 30), keys: list[str] | None = None) -> Result:
    s = Session(keys)
    return df.withColumns({f"volume_ratio_{n}": div(src, s.rolling(src, n, F.avg)) for n in windows}), [f"volume_ratio_{n}" for n in windows]


def _macd(src: str, fast: int, slow: int, signal: int) -> Recursive:
    def compute(x: dict[str, np.ndarray], scan: Scan) -> dict[str, np.ndarray]:
        quick, late = scan.smooth(x[src], 2 / (fast + 1)), scan.smooth(x[src], 2 / (slow + 1))
        line = np.where(scan.count(x[src]) >= slow, quick - late, np.nan)
        level = scan.smooth(line, 2 / (signal + 1))
        return {"macd": np.where(scan.count(line) >= signal, line - level, np.nan)}

    return Recursive([src], ["macd"], compute)


def macd(df: DataFrame, src: str = "close", fast: int = 12, slow: int = 26, signal: int = 9, keys: list[str] | None = None) -> Result:
    """Histogram: the difference of two smoothed series less its own smoothed series, which starts where the slow one has `slow` values."""
    return Recursive.add(df, keys, _macd(src, fast, slow, signal))


def _price_ema(src: str, spans: tuple[int, ...]) -> Recursive:
    return Recursive([src], [f"price_ema{n}" for n in spans], lambda x, scan: {f"price_ema{n}": x[src] / scan.adjusted(x[src], n) - 1 for n in spans})


def price_ema(df: DataFrame, src: str = "close", spans: tuple[int, ...] = (15, 20, 30), keys: list[str] | None = None) -> Result:
    return Recursive.add(df, keys, _price_ema(src, spans))


def stochastic(df: DataFrame, src: str = "close", windows: tuple[int, ...] = (14, 20, 30), high: str | None = None, low: str | None = None, keys: list[str] | None = None) -> Result:
    """%K: where the source is between the lowest low and the highest high of the last n rows."""
    s = Session(keys)
    out = {}
    for n in windows:
        bottom, top = s.rolling(low or "low", n, F.min), s.rolling(high or "high", n, F.max)
        out[f"stoch_k_{n}"] = div(100 * (F.col(src) - bottom), top - bottom)
    return df.withColumns(out), list(out)


def bollinger(df: DataFrame, src: str = "close", windows: tuple[int, ...] = (15, 20, 30), deviations: tuple[float, ...] = (1.5, 2.0, 2.5), keys: list[str] | None = None) -> Result:
    """%B: where the source is between bands of k population deviations; bb_percent_N_D with D = 10 k."""
    s = Session(keys)
    out = {}
    for k in deviations:
        for n in windows:
            mean, spread = s.rolling(src, n, F.avg), s.rolling(src, n, F.stddev_pop)
            out[f"bb_percent_{n}_{round(10 * k)}"] = div(F.col(src) - (mean - k * spread), 2 * k * spread)
    return df.withColumns(out), list(out)


def _atr(src: str, window: int) -> Recursive:
    def compute(x: dict[str, np.ndarray], scan: Scan) -> dict[str, np.ndarray]:
        place, last = x["place"], scan.previous(x[src])
        # of three ranges those that are known
        reach = np.fmax(np.fmax(x["high"] - x["low"], np.abs(x["high"] - last)), np.abs(x["low"] - last))
        early = np.where(place < window, reach, np.nan)
        seed = scan.total(early) / scan.count(early)
        # the seed stands in the place of the range of row N - 1
        mean = scan.smooth(np.where(place == window - 1, seed, reach), 1 / window, start=window - 1)
        mean = np.where(place < window - 1, 0.0, mean)
        return {"atr": mean, "atr_norm": mean / x[src]}

    return Recursive(list(dict.fromkeys([src, "high", "low"])), ["atr", "atr_norm"], compute)


def atr(df: DataFrame, src: str = "close", window: int = 14, keys: list[str] | None = None) -> Result:
    """Average true range by Wilder's smoothing, seeded by the mean of the first N ranges, 0 before; and the same over the source."""
    return Recursive.add(df, keys, _atr(src, window))


def roc(df: DataFrame, src: str = "close", windows: tuple[int, ...] = (5, 10, 20), keys: list[str] | None = None) -> Result:
    s = Session(keys)
    return df.withColumns({f"roc_{n}": 100 * div(F.col(src) - s.lag(src, n), s.lag(src, n)) for n in windows}), [f"roc_{n}" for n in windows]


def candle(df: DataFrame) -> Result:
    df = df.withColumns({"body_size": F.abs(F.col("close") - F.col("open")), "candle_range": F.col("high") - F.col("low")})
    return df.withColumn("body_ratio", div("body_size", "candle_range")), ["body_size", "candle_range", "body_ratio"]


def bundle(df: DataFrame, src: str = "close", keys: list[str] | None = None) -> Result:
    """All families on one source. One Exchange serves all windows, and one pass behind them all recursions."""
    own: dict[str, list[str]] = {}
    for family in (momentum, stochastic, bollinger, roc):
        df, own[family.__name__] = family(df, src, keys=keys)
    df, own["volume_ratio"] = volume_ratio(df, keys=keys)
    families = {"rsi": _rsi(src, (14, 7, 5, 3)), "macd": _macd(src, 12, 26, 9), "price_ema": _price_ema(src, (15, 20, 30)), "atr": _atr(src, 14)}
    df, _ = Recursive.add(df, keys, *families.values())
    own |= {k: f.names for k, f in families.items()}
    return df, [n for k in ("rsi", "momentum", "macd", "price_ema", "stochastic", "bollinger", "atr", "roc", "volume_ratio") for n in own[k]]


def best(df: DataFrame, src: str = "close", keys: list[str] | None = None) -> Result:
    """The six that an evaluation leaves: rsi_7 and 14, macd, two Bollinger %B, and the range over the price."""
    df, _ = bollinger(df, src, (20, 30), (2.0,), keys)
    df, _ = Recursive.add(df, keys, _rsi(src, (14, 7)), _macd(src, 12, 26, 9), _atr(src, 14))
    return df.drop("atr"), ["rsi_14", "rsi_7", "macd", "bb_percent_20_20", "bb_percent_30_20", "atr_norm"]
