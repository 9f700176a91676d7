"""Scores of factors against targets: information coefficients (IC) by day, by horizon, by minute of the session, and quintile returns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorlab.functions.safe import corr_safe, div, pair_count
from factorlab.functions.windows import Session

from .sessions import correlation, ranks, table_by_session
from .targets import HORIZONS


def average_rank(value: Column | str, by: list[str]) -> Column:
    """The mean of the ranks that equal values share."""
    v = F.col(value) if isinstance(value, str) else value
    return F.rank().over(Window.partitionBy(*by).orderBy(v)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, v)) - 1) / 2.0


def tidy(df: DataFrame, factors: list[str], target: str, also: list[str]) -> DataFrame:
    """One row for each bar and factor: `also`, target, factor, value."""
    return df.select(*also, F.col(target).alias("target"), F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("value")) for f in factors])).alias("_f")).select(*also, "target", "_f.factor", "_f.value")


def daily_pearson(df: DataFrame, factors: list[str], target: str, keys: list[str] | None = None, drop: str = "pair") -> DataFrame:
    """keys, session, factor, n, ic. drop="pair" leaves out rows that miss the factor or the target, "all" those that miss any column."""
    by = Session(keys).by
    if drop == "all":
        df = df.na.drop("any")
    # all factors in one aggregate over the windows' partitioning, then one row for each
    sums = df.groupBy(*by).agg(*[F.struct(F.lit(f).alias("factor"), pair_count(f, target).alias("n"), corr_safe(f, target).alias("ic")).alias(f"_{k}") for k, f in enumerate(factors)])
    return sums.select(*by, F.explode(F.array(*[f"_{k}" for k in range(len(factors))])).alias("_f")).select(*by, "_f.*")


def mean_ic_by_horizon(df: DataFrame, factors: dict[int, str], keys: list[str] | None = None, drop: str = "pair") -> DataFrame:
    """horizon, mean_ic: the mean over days of each horizon's factor against target_return_<horizon>."""
    if drop == "all":  # the same rows for all horizons, so one pass does
        df = df.na.drop("any")
    by = Session(keys).by
    one = df.groupBy(*by).agg(*[corr_safe(f, f"target_return_{h}").alias(f"_{h}") for h, f in factors.items()]).agg(*[F.avg(f"_{h}").alias(f"_{h}") for h in factors])
    return one.select(F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_{h}").alias("mean_ic")) for h in factors])).alias("_h")).select("_h.*")


def evaluate_factor(df: DataFrame, generator: Callable[[DataFrame, tuple[int, ...]], DataFrame], prefix: str, horizons: tuple[int, ...] = HORIZONS, keys: list[str] | None = None) -> DataFrame:
    """mean_ic_by_horizon of what the generator makes: it takes bars and horizons and adds <prefix><horizon> for each."""
    out = generator(df, horizons)
    missing = [f"{prefix}{h}" for h in horizons if f"{prefix}{h}" not in out.columns or f"{prefix}{h}" in df.columns]
    if missing:
        raise ValueError(f"the generator doesn't make {', '.join(missing)}")
    return mean_ic_by_horizon(out, {h: f"{prefix}{h}" for h in horizons}, keys)


def compare(first: DataFrame, second: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Two results of mean_ic_by_horizon side by side."""
    return first.withColumnRenamed("mean_ic", names[0]).join(second.withColumnRenamed("mean_ic", names[1]), "horizon")


def daily_spearman(df: DataFrame, factors: list[str], target: str, keys: list[str] | None = None, least: int = 20, keep_short: bool = False) -> DataFrame:
    """keys, session, factor, n, ic of days with `least` pairs or more and a defined IC; with keep_short the others stay, with a NULL.

    A session is ranked whole, all factors from the same rows: bars aren't laid out by factor, and nothing is sorted beyond a session.
    """
    by = Session(keys).by

    def session(table: pa.Table) -> dict:
        value = lambda c: np.array(table.column(c).cast(pa.float64()).fill_null(np.nan))
        y, n, ic = value(target), [], []
        for f in factors:
            x = value(f)
            both = ~(np.isnan(x) | np.isnan(y))
            n.append(int(both.sum()))
            ic.append(correlation(ranks(x[both]), ranks(y[both])) if n[-1] >= least else np.nan)
        return {"factor": factors, "n": n, "ic": np.array(ic, dtype=np.float64)}

    out = table_by_session(df.select(*by, "ts", target, *[f for f in factors if f != target]), session, "factor string, n long, ic double", keys)
    return out if keep_short else out.filter("ic is not null")


def ic_summary(daily: DataFrame) -> DataFrame:
    """factor, ic_mean, ic_std (population), n_days; factors without a valid day are absent."""
    return daily.filter("ic is not null").groupBy("factor").agg(F.avg("ic").alias("ic_mean"), F.stddev_pop("ic").alias("ic_std"), F.count(F.lit(1)).alias("n_days"))


def ic_score(summary: DataFrame) -> DataFrame:
    return summary.withColumn("ic_score", div(F.abs("ic_mean"), "ic_std"))


def rolling_ic(daily: DataFrame, days: int = 20, keys: list[str] | None = None) -> DataFrame:
    """ic_moving: the mean of the last `days` rows of each factor, where all of them have a value."""
    keys = ["symbol"] if keys is None else keys
    last = Window.partitionBy(*keys, "factor").orderBy("session").rowsBetween(1 - days, 0)
    return daily.withColumn("ic_moving", F.when(F.count("ic").over(last) >= days, F.avg("ic").over(last)))


def ic_by_minute(df: DataFrame, factors: list[str], target: str | dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """factor, minute_index, n, ic: Pearson across days of the bars with the same ordinal. target: one for all, or one for each factor."""
    s = Session(keys)
    of = target if isinstance(target, dict) else dict.fromkeys(factors, target)
    each = df.withColumn("minute_index", s.ordinal()).groupBy("minute_index").agg(*[F.struct(F.lit(f).alias("factor"), pair_count(f, of[f]).alias("n"), corr_safe(f, of[f]).alias("ic")).alias(f"_{k}") for k, f in enumerate(factors)])
    return each.select("minute_index", F.explode(F.array(*[f"_{k}" for k in range(len(factors))])).alias("_f")).select("_f.factor", "minute_index", "_f.n", "_f.ic").filter("n > 0")


def minutes_wide(minutes: DataFrame, factors: list[str]) -> DataFrame:
    """minute_index and a column for each factor, from the rows of ic_by_minute."""
    return minutes.groupBy("minute_index").pivot("factor", factors).agg(F.first("ic"))


def clock(minute: Column, market_open: str = "08:00") -> Column:
    """HH:MM of so many minutes after the open."""
    start = F.to_timestamp_ntz(F.lit(f"2000-01-01 {market_open}:00"))
    return F.date_format(start + F.make_dt_interval(F.lit(0), F.lit(0), minute.cast("int")), "HH:mm")


def ic_extremes(by_minute: DataFrame, mode: str = "worst", top_n: int = 30, market_open: str = "08:00") -> DataFrame:
    """factor, ic_min, time_min, ic_max, time_max, mean_extreme (of the top_n lowest or highest); the first minute on ties."""
    if mode not in ("worst", "best"):
        raise ValueError("mode is 'worst' or 'best'")
    valid = by_minute.filter("ic is not null")
    order = F.col("ic").asc() if mode == "worst" else F.col("ic").desc()
    ranked = valid.withColumn("_rank", F.row_number().over(Window.partitionBy("factor").orderBy(order, "minute_index")))
    low, high = F.min(F.struct("ic", "minute_index")), F.max(F.struct("ic", (-F.col("minute_index")).alias("m")))
    out = ranked.groupBy("factor").agg(low.alias("_low"), high.alias("_high"), F.avg(F.when(F.col("_rank") <= top_n, F.col("ic"))).alias("mean_extreme"))
    return out.select("factor", F.col("_low.ic").alias("ic_min"), clock(F.col("_low.minute_index"), market_open).alias("time_min"), F.col("_high.ic").alias("ic_max"), clock(-F.col("_high.m"), market_open).alias("time_max"), "mean_extreme")


def quintile_returns(df: DataFrame, factors: list[str], target: str, keys: list[str] | None = None, least: int = 30, bins: int = 5) -> DataFrame:
    """factor, q, mean_return, n_days: the mean target by bins of the factor's daily quantiles, averaged over days.

    Bins are closed on the right, the first on both sides. Days with fewer than `least` pairs, with equal edges or with an empty bin are left out.
    """
    group = ["factor", *Session(keys).by]
    both = tidy(df, factors, target, group[1:]).filter("value is not null and target is not null")
    shares = [k / bins for k in range(bins + 1)]
    edges = both.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.percentile("value", F.array(*map(F.lit, shares))).alias("_edges"))
    edges = edges.filter((F.col("_n") >= least) & (F.size(F.array_distinct("_edges")) == bins + 1))
    q = reduce(lambda c, k: c.when(F.col("value") <= F.col("_edges")[k + 1], k), range(bins), F)
    placed = both.join(edges, group).withColumn("q", q.otherwise(bins - 1))
    daily = placed.groupBy(*group, "q").agg(F.avg("target").alias("_mean"))
    full = daily.withColumn("_bins", F.count(F.lit(1)).over(Window.partitionBy(*group))).filter(F.col("_bins") == bins)
    return full.groupBy("factor", "q").agg(F.avg("_mean").alias("mean_return"), F.count(F.lit(1)).alias("n_days"))
