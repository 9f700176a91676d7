"""Alpha factors of four hypotheses, and of buying and selling volume. Each function returns the DataFrame with the named columns added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorlab.functions.safe import col, div
from factorlab.functions.windows import Session

from . import indicators
from .targets import HORIZONS, add_targets, ln


def _momentum(s: Session, price: str, n: int) -> Column:
    return ln(price) - ln(s.lag(price, n))


def momentum_z(df: DataFrame, windows: tuple[int, ...] = HORIZONS, price: str = "close", keys: list[str] | None = None) -> DataFrame:
    """momentum_N, the log return of the last N rows, and momentum_z_N, its z-score in the session."""
    s = Session(keys)
    df = df.withColumns({f"momentum_{n}": _momentum(s, price, n) for n in windows})
    return df.withColumns({f"momentum_z_{n}": s.zscore(f"momentum_{n}") for n in windows})


def rev_momentum_z(df: DataFrame, windows: tuple[int, ...] = HORIZONS, price: str = "close", keys: list[str] | None = None) -> DataFrame:
    s = Session(keys)
    df = df.withColumns({f"momentum_{n}": _momentum(s, price, n) for n in windows})
    return df.withColumns({f"rev_momentum_z_{n}": -s.zscore(f"momentum_{n}") for n in windows})


def reversal_momentum_factor(df: DataFrame, window: int = 30, price: str = "close", keys: list[str] | None = None) -> DataFrame:
    s = Session(keys)
    return df.withColumn("_m", _momentum(s, price, window)).withColumn("reversal_momentum_factor", -s.zscore("_m")).drop("_m")


def momentum_factor(df: DataFrame, window: int = 30, price: str = "close", keys: list[str] | None = None) -> DataFrame:
    s = Session(keys)
    return df.withColumn("_m", _momentum(s, price, window)).withColumn("momentum_factor", s.zscore("_m")).drop("_m")


def inv_momentum(df: DataFrame, windows: tuple[int, ...] = HORIZONS, price: str = "close", keys: list[str] | None = None) -> DataFrame:
    s = Session(keys)
    return df.withColumns({f"inv_momentum_{n}": -_momentum(s, price, n) for n in windows})


def rolling_z(df: DataFrame, windows: tuple[int, ...] = HORIZONS, price: str = "close", least: int | None = 1, keys: list[str] | None = None) -> DataFrame:
    """sma_N, std_N and zscore_N of the price over the last N rows. least: rows that are enough (None: N)."""
    s = Session(keys)
    df = df.withColumns({f"sma_{n}": s.rolling(price, n, F.avg, least) for n in windows} | {f"std_{n}": s.rolling(price, n, F.stddev_samp, least) for n in windows})
    return df.withColumns({f"zscore_{n}": div(F.col(price) - F.col(f"sma_{n}"), f"std_{n}") for n in windows})


def reversal_score(df: DataFrame, windows: tuple[int, ...] = HORIZONS, price: str = "close", keys: list[str] | None = None) -> DataFrame:
    """Distance from the rolling mean, as a z-score of the session."""
    s = Session(keys)
    df = rolling_z(df, windows, price, 1, keys)
    return df.withColumns({f"reversal_score_{n}": s.zscore(f"zscore_{n}") for n in windows}).drop(*[f"{c}_{n}" for n in windows for c in ("sma", "std", "zscore")])


def reversal_media_factor(df: DataFrame, window: int = 30, price: str = "close", keys: list[str] | None = None) -> DataFrame:
    return reversal_score(df, (window,), price, keys).withColumnRenamed(f"reversal_score_{window}", "reversal_media_factor")


def mean_reversion_factor(df: DataFrame, window: int = 5, price: str = "close", keys: list[str] | None = None) -> DataFrame:
    df = rolling_z(df, (window,), price, None, keys)
    return df.withColumn("mean_reversion_factor", F.col(f"zscore_{window}")).drop(f"sma_{window}", f"std_{window}", f"zscore_{window}")


def mom_vol_z(df: DataFrame, windows: tuple[int, ...] = HORIZONS, price: str = "close", volume: str = "volume", least: int | None = 1, keys: list[str] | None = None) -> DataFrame:
    """Momentum times volume against its rolling mean: vol_avg_N, vol_ratio_N, mom_vol_N and its z-score mom_vol_z_N."""
    s = Session(keys)
    df = df.withColumns({f"vol_avg_{n}": s.rolling(volume, n, F.avg, least) for n in windows})
    df = df.withColumns({f"vol_ratio_{n}": div(volume, f"vol_avg_{n}") for n in windows})
    df = df.withColumns({f"mom_vol_{n}": _momentum(s, price, n) * F.col(f"vol_ratio_{n}") for n in windows})
    return df.withColumns({f"mom_vol_z_{n}": s.zscore(f"mom_vol_{n}") for n in windows})


def rev_mom_vol_z(df: DataFrame, windows: tuple[int, ...] = HORIZONS, price: str = "close", volume: str = "volume", keys: list[str] | None = None) -> DataFrame:
    df = mom_vol_z(df, windows, price, volume, 1, keys)
    return df.withColumns({f"rev_mom_vol_z_{n}": -F.col(f"mom_vol_z_{n}") for n in windows}).drop(*[f"{c}_{n}" for n in windows for c in ("vol_avg", "vol_ratio", "mom_vol", "mom_vol_z")])


def reversion_vol_momentum_factor(df: DataFrame, window: int = 30, price: str = "close", volume: str = "volume", keys: list[str] | None = None) -> DataFrame:
    return rev_mom_vol_z(df, (window,), price, volume, keys).withColumnRenamed(f"rev_mom_vol_z_{window}", "reversion_vol_momentum_factor")


def mom_vol_factor(df: DataFrame, window: int = 30, price: str = "close", volume: str = "volume", keys: list[str] | None = None) -> DataFrame:
    """Reversed momentum times relative volume with all that it is made of: momentum_N, vol_avg_N, vol_ratio_N, mom_vol_N and mom_vol_z_N, the last two with the sign turned."""
    n = window
    df = mom_vol_z(df, (n,), price, volume, 1, keys).withColumn(f"momentum_{n}", _momentum(Session(keys), price, n))
    return df.withColumns({c: -F.col(c) for c in (f"mom_vol_{n}", f"mom_vol_z_{n}")})


def time_of_day(c: str = "ts") -> Column:
    return F.date_format(c, "HH:mm:ss")


def opening_range(df: DataFrame, start: str = "08:00:00", end: str = "09:30:00", keys: list[str] | None = None) -> DataFrame:
    """opening_high, opening_low, opening_range and opening_midpoint of each session, from bars between the two times, both included."""
    s = Session(keys)
    inside = time_of_day().between(start, end)
    df = df.withColumns({"opening_high": F.max(F.when(inside, F.col("high"))).over(s.whole), "opening_low": F.min(F.when(inside, F.col("low"))).over(s.whole)})
    return df.withColumns({"opening_range": F.col("opening_high") - F.col("opening_low"), "opening_midpoint": (F.col("opening_high") + F.col("opening_low")) / 2})


def opening_ranges(df: DataFrame, start: str = "08:00:00", end: str = "09:30:00", keys: list[str] | None = None) -> DataFrame:
    """The same as a table with one row for each session that has opening bars."""
    by = Session(keys).by
    out = df.filter(time_of_day().between(start, end)).groupBy(*by).agg(F.max("high").alias("opening_high"), F.min("low").alias("opening_low"))
    return out.withColumns({"opening_range": F.col("opening_high") - F.col("opening_low"), "opening_midpoint": (F.col("opening_high") + F.col("opening_low")) / 2})


def opening_exhaustion(df: DataFrame, name: str = "factor30", start: str = "08:00:00", end: str = "09:30:00", keys: list[str] | None = None) -> DataFrame:
    """Distance of the close from the opening midpoint in opening ranges, from `end` on, as a z-score of the session.

    The bar at `end` belongs to both the range and what follows it.
    """
    s = Session(keys)
    df = opening_range(df, start, end, keys)
    df = df.withColumn("_raw", F.when(time_of_day() >= end, div(F.col("close") - F.col("opening_midpoint"), "opening_range")))
    return df.withColumn(name, s.zscore("_raw")).drop("_raw", "opening_high", "opening_low", "opening_range", "opening_midpoint")


def opening_factor_z(df: DataFrame, windows: tuple[int, ...] = HORIZONS, keys: list[str] | None = None, **times: str) -> DataFrame:
    """The opening factor under the name factorN for each horizon; it has no window, so all are equal."""
    df = opening_exhaustion(df, "_factor", keys=keys, **times)
    return df.withColumns({f"factor{n}": F.col("_factor") for n in windows}).drop("_factor")


def tick_direction(df: DataFrame, price: str = "close", keys: list[str] | None = None) -> DataFrame:
    """direction: the sign of the last change that wasn't zero, within the session."""
    s = Session(keys)
    sign = F.signum(s.difference(price))
    df = df.withColumn("_sign", F.when(sign != 0, sign))
    return df.withColumn("direction", s.ffill(F.col("_sign"))).drop("_sign")


def buy_sell_volume(df: DataFrame, volume: str = "volume") -> DataFrame:
    """Splits the volume by `direction`; while there is none, both are 0."""
    buy, sell = (F.when(c, col(volume)).otherwise(0.0) for c in (F.col("direction") > 0, F.col("direction") < 0))
    df = df.withColumns({"buy_volume": buy, "sell_volume": sell})
    return df.withColumns({"buy_ratio": div("buy_volume", volume), "sell_ratio": div("sell_volume", volume)})


def buy_sell_momentum_rev(df: DataFrame, window: int = 30, price: str = "close", keys: list[str] | None = None) -> DataFrame:
    s = Session(keys)
    df = df.withColumn("_m", _momentum(s, price, window)).withColumns({"_buy": F.col("_m") * F.col("buy_ratio"), "_sell": F.col("_m") * F.col("sell_ratio")})
    return df.withColumns({"alpha_factor_buy_momentum_rev": -s.zscore("_buy"), "alpha_factor_sell_momentum_rev": -s.zscore("_sell")}).drop("_m", "_buy", "_sell")


FACTORS = ["reversal_momentum_factor", "reversal_media_factor", "reversion_vol_momentum_factor", "factor30"]


def feature_table(df: DataFrame, window: int = 30, keys: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Target, the best indicators and the final factor of each hypothesis: bars and one column for each."""
    df = add_targets(df, (window,), keys=keys)
    df = reversal_momentum_factor(df, window, keys=keys)
    df = reversal_media_factor(df, window, keys=keys)
    df = reversion_vol_momentum_factor(df, window, keys=keys)
    # recursions come last: what comes behind them would be dealt out by session once more
    df, names = indicators.best(opening_exhaustion(df, keys=keys), keys=keys)
    return df, [*names, *FACTORS]
