"""Windows over a whole series, across sessions, without a task that holds the series.

Bars get a global number from the counts of the sessions before. The numbers are cut into chunks, and each chunk gets the rows around it
that a window of `reach` rows needs from its neighbours; windows then run by chunk, and only a chunk's own rows are kept. Exact for every
window of bounded reach. What has no bound, the carrying on of a last value, takes the last value of the sessions before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from factorlab.functions.safe import col, div
from factorlab.functions.windows import Session

from .targets import HORIZONS, ln

CHUNK = 100_000


def numbered(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds position, the bar's number in its series from 0 on."""
    s = Session(keys)
    counts = df.groupBy(*s.by).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*s.by[:-1]).orderBy("session").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*s.by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return df.join(starts, s.by).withColumn("position", F.col("_start") + s.ordinal()).drop("_start")


def over_series(df: DataFrame, reach: int, add: Callable[[DataFrame, WindowSpec], DataFrame], keys: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """add(df, window) with a window of the whole series in order; it may look `reach` rows back and ahead."""
    if reach > chunk:
        raise ValueError("a window can't reach over more than a chunk")
    own = Session(keys).by[:-1]
    rows = numbered(df, keys).withColumn("_home", F.floor(F.col("position") / chunk))
    place = F.col("position") - F.col("_home") * chunk
    near = F.filter(F.array(F.col("_home"), F.when(place < reach, F.col("_home") - 1), F.when(place >= chunk - reach, F.col("_home") + 1)), lambda c: c.isNotNull() & (c >= 0))
    dealt = rows.withColumn("_chunk", F.explode(near))
    window = Window.partitionBy(*own, "_chunk").orderBy("position")
    return add(dealt, window).filter("_chunk = _home").drop("_chunk", "_home")


def series_targets(df: DataFrame, horizons: tuple[int, ...] = HORIZONS, price: str = "close", keys: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """target_return_N across sessions."""
    return over_series(df, max(horizons), lambda d, w: d.withColumns({f"target_return_{n}": ln(F.lead(price, n).over(w)) - ln(price) for n in horizons}), keys, chunk)


def series_momentum(df: DataFrame, windows: tuple[int, ...] = HORIZONS, price: str = "close", keys: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """momentum_N, zscore_N of the price and vol_ratio_N over the last N rows of the series (all N are needed)."""

    def add(d: DataFrame, w: WindowSpec) -> DataFrame:
        out = {}
        for n in windows:
            last = w.rowsBetween(1 - n, 0)
            full = F.count(F.lit(1)).over(last) >= n
            out[f"momentum_{n}"] = ln(price) - ln(F.lag(price, n).over(w))
            out[f"zscore_{n}"] = F.when(full, div(col(price) - F.avg(price).over(last), F.stddev_samp(price).over(last)))
            out[f"vol_ratio_{n}"] = F.when(full, div("volume", F.avg("volume").over(last)))
        return d.withColumns(out)

    return over_series(df, max(windows), add, keys, chunk)


def series_direction(df: DataFrame, price: str = "close", keys: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """direction: the sign of the last change that wasn't zero, across sessions."""
    s = Session(keys)
    df = over_series(df, 1, lambda d, w: d.withColumn("_sign", F.signum(col(price) - F.lag(price, 1).over(w))), keys, chunk)
    df = df.withColumn("_sign", F.when(F.col("_sign") != 0, F.col("_sign")))
    last = df.groupBy(*s.by).agg(F.max(F.when(F.col("_sign").isNotNull(), F.struct("ts", "_sign")))["_sign"].alias("_last"))
    before = Window.partitionBy(*s.by[:-1]).orderBy("session").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*s.by, F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    return df.join(carried, s.by).withColumn("direction", F.coalesce(s.ffill(F.col("_sign")), "_carry")).drop("_sign", "_carry")


def rows_between(df: DataFrame, first: int, last: int, keys: list[str] | None = None) -> DataFrame:
    """Rows `first` to `last` (from 0, both included) of each session in order of time, with their number as `row`."""
    return df.withColumn("row", Session(keys).ordinal()).filter(F.col("row").between(first, last))
