"""The factor library on small hand-made bars: properties, edge cases, and pandas as a second opinion."""

from __future__ import annotations

import datetime as dt
import math
import os
import random

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from factorlab.functions import moments
from factorlab.functions.safe import corr_safe, div, require_columns
from factorlab.functions.scan import Scan, affine, smoothed
from factorlab.functions.windows import Session
from factorlab.operators import evaluate, factors, history, indicators, select, series, sessions, signals, targets
from factorlab.sources.bars import SCHEMA, prepare, read_bars, write_features
from factorlab.sources.features import FeatureTable

DAY = dt.datetime(2024, 1, 2, 8)


def bars(spark, *sessions: list[float], volume: float = 10.0, minutes: int = 1):
    """Sessions of the given closes, one bar a minute."""
    out = []
    for k, closes in enumerate(sessions):
        for i, c in enumerate(closes):
            at = DAY + dt.timedelta(days=k, minutes=i * minutes)
            out.append(("ALL", at.date(), at, c, None if c is None else c + 1.0, None if c is None else c - 1.0, c, volume))
    return spark.createDataFrame(out, SCHEMA)


def column(df, name: str) -> list:
    return [r[name] for r in df.orderBy("ts").collect()]


def close_to(got: list, want) -> None:
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        if b is None or (isinstance(b, float) and math.isnan(b)):
            assert a is None
        else:
            assert a == pytest.approx(b, rel=1e-9, abs=1e-12)


def walk(n: int, seed: int = 1) -> list[float]:
    r, x, out = random.Random(seed), 100.0, []
    for _ in range(n):
        x *= math.exp(r.gauss(0, 0.01))
        out.append(round(x, 2))
    return out


def test_safe_arithmetic(spark):
    df = spark.createDataFrame([(1.0, 0.0, 5.0), (-2.0, 0.0, 5.0), (0.0, 0.0, 5.0), (3.0, 2.0, 5.0)], "a double, b double, c double")
    assert [r[0] for r in df.select(div("a", "b")).collect()] == [None, None, None, 1.5]
    assert [r[0] for r in df.select(div("a", "b", infinite=True)).collect()] == [math.inf, -math.inf, None, 1.5]
    assert df.agg(corr_safe("a", "c")).first()[0] is None
    with pytest.raises(ValueError, match="missing columns: x"):
        require_columns(df, "a", "x")


def test_prepare_turns_nan_into_null(spark):
    raw = spark.createDataFrame([("2024-01-02 08:00:00", 1.0, 2.0, 0.5, float("nan"), 3.0), ("2024-01-02 08:01:00", 1.0, 2.0, 0.5, None, 3.0)], "at string, open double, high double, low double, close double, volume double")
    out = prepare(raw, "at")
    assert out.columns[:3] == ["symbol", "session", "ts"] and dict(out.dtypes)["ts"] == "timestamp_ntz"
    assert column(out, "close") == [None, None]


def test_features_are_written_by_session(spark, tmp_path):
    write_features(bars(spark, [1.0, 2.0], [3.0]), str(tmp_path / "f"))
    assert sorted(p.name for p in (tmp_path / "f").iterdir() if p.is_dir()) == ["session=2024-01-02", "session=2024-01-03"]
    assert read_bars(spark, str(tmp_path / "f")).count() == 3


@pytest.mark.parametrize("n", [1, 3, 40, 90])
def test_indicators_against_pandas(spark, n):
    closes = walk(n)
    b = bars(spark, closes)
    c = pd.Series(closes)
    step = c.diff()
    for w in (14, 3):
        up, down = step.where(step > 0, 0.0).ewm(alpha=1 / w, adjust=False, min_periods=w).mean(), (-step.where(step < 0, 0.0)).ewm(alpha=1 / w, adjust=False, min_periods=w).mean()
        want = (100 - 100 / (1 + up / down)).where(down != 0, 100).where(up.notna())
        close_to(column(indicators.rsi(b, windows=(w,))[0], f"rsi_{w}"), want.tolist())
    fast, slow = c.ewm(span=12, adjust=False, min_periods=12).mean(), c.ewm(span=26, adjust=False, min_periods=26).mean()
    line = fast - slow
    close_to(column(indicators.macd(b)[0], "macd"), (line - line.ewm(span=9, adjust=False, min_periods=9).mean()).tolist())
    close_to(column(indicators.price_ema(b, spans=(15,))[0], "price_ema15"), (c / c.ewm(span=15).mean() - 1).tolist())
    low, high = (c - 1).rolling(14).min(), (c + 1).rolling(14).max()
    close_to(column(indicators.stochastic(b, windows=(14,))[0], "stoch_k_14"), (100 * (c - low) / (high - low)).tolist())
    mean, spread = c.rolling(15).mean(), c.rolling(15).std(ddof=0)
    close_to(column(indicators.bollinger(b, windows=(15,), deviations=(2.0,))[0], "bb_percent_15_20"), ((c - (mean - 2 * spread)) / (4 * spread)).tolist())
    close_to(column(indicators.roc(b, windows=(5,))[0], "roc_5"), (100 * (c - c.shift(5)) / c.shift(5)).tolist())
    ranges = pd.concat([pd.Series([2.0] * n), (c + 1 - c.shift()).abs(), (c - 1 - c.shift()).abs()], axis=1).max(axis=1).tolist()
    want, value = [], 0.0
    for i, x in enumerate(ranges):
        value = 0.0 if i < 13 else sum(ranges[:14]) / 14 if i == 13 else (value * 13 + x) / 14
        want.append(value)
    close_to(column(indicators.atr(b)[0], "atr"), want)
    for w in (5, 15):
        up, down = step.clip(lower=0).rolling(w).mean(), (-step.clip(upper=0)).rolling(w).mean()
        want = (100 - 100 / (1 + up / down)).where(~((down == 0) & (up > 0)), 100).where(~((down == 0) & (up == 0)))
        close_to(column(indicators.rsi_simple(b, windows=(w,))[0], f"rsi_sma_{w}"), want.tolist())


def test_smoothing_in_blocks_is_the_recursion(spark):
    closes = walk(900)
    df = bars(spark, closes)
    want = pd.Series(closes).ewm(alpha=0.9, adjust=False).mean().tolist()
    assert closes and 900 * -math.log(0.1) > 600
    close_to(column(smoothed(df, Session(), "y", "close", 0.9), "y"), want)
    late = pd.Series(closes[25:]).ewm(alpha=0.9, adjust=False).mean().tolist()
    close_to(column(smoothed(df, Session(), "y", "close", 0.9, start=25), "y"), [None] * 25 + late)


@pytest.mark.parametrize("n", [200, 3000, 100_000])
def test_smoothing_of_gaps_and_long_sessions(spark, n):
    """Missing closes age the mean, as in pandas, in sessions of any length."""
    r = np.random.default_rng(n)
    closes = [None if i in (0, 60, 61) or 300 < i < 1000 or r.random() < 0.1 else x for i, x in enumerate(walk(n))]
    b = bars(spark, closes).withColumn("session", F.lit(DAY.date()))
    c = pd.Series(closes, dtype=float)
    for alpha in (0.05, 1 / 3, 0.9):
        close_to(column(smoothed(b, Session(), "y", "close", alpha), "y"), c.ewm(alpha=alpha, adjust=False).mean().tolist())
    line = c.ewm(span=12, adjust=False, min_periods=12).mean() - c.ewm(span=26, adjust=False, min_periods=26).mean()
    close_to(column(indicators.macd(b)[0], "macd"), (line - line.ewm(span=9, adjust=False, min_periods=9).mean()).tolist())
    close_to(column(indicators.price_ema(b, spans=(3, 15))[0], "price_ema3"), (c / c.ewm(span=3).mean() - 1).tolist())
    step = c.diff()
    up, down = step.where(step > 0, 0.0).ewm(alpha=1 / 3, adjust=False, min_periods=3).mean(), (-step.where(step < 0, 0.0)).ewm(alpha=1 / 3, adjust=False, min_periods=3).mean()
    close_to(column(indicators.rsi(b, windows=(3,))[0], "rsi_3"), (100 - 100 / (1 + up / down)).where(down != 0, 100.0).where(up.notna()).tolist())


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
def test_scans_go_on_over_batches_and_stop_at_sessions(size):
    r = np.random.default_rng(size)
    place = np.concatenate([np.arange(n) for n in (1, 5, 300, 2, 90)])
    x = np.where(r.random(len(place)) < 0.2, np.nan, r.normal(size=len(place)))
    session = np.cumsum(place == 0)
    scan, found = Scan(), []
    for k in range(0, len(x), size):
        scan.begin(place[k : k + size])
        y = x[k : k + size]
        found.append([scan.smooth(y, 0.3), scan.adjusted(y, 5), scan.count(y), scan.previous(y), scan.smooth(y, 0.5, start=3), scan.total(y)])
    by = pd.Series(x).groupby(session)
    late = by.transform(lambda s: s.where(np.arange(len(s)) >= 3).ewm(alpha=0.5, adjust=False).mean())
    want = [by.transform(lambda s: s.ewm(alpha=0.3, adjust=False).mean()), by.transform(lambda s: s.ewm(span=5).mean()), by.transform(lambda s: s.notna().cumsum()), by.shift(1), late, by.transform(lambda s: s.fillna(0).cumsum())]
    for a, b in zip(map(np.concatenate, zip(*found)), want):
        np.testing.assert_allclose(a, b.to_numpy(dtype=float), rtol=1e-11, atol=1e-12)
    assert affine(np.array([0.5]), np.array([1.0]), 4.0).tolist() == [3.0]


def test_flat_session(spark):
    b = bars(spark, [5.0] * 40)
    assert set(column(indicators.rsi(b, windows=(14,))[0], "rsi_14")[13:]) == {100.0}
    assert set(column(indicators.rsi_simple(b, windows=(5,))[0], "rsi_sma_5")) == {None}
    assert set(column(factors.momentum_z(b, (5,)), "momentum_z_5")) == {None}
    scored = targets.add_targets(factors.momentum_z(b, (5,)), (5,))
    assert [r["ic"] for r in evaluate.daily_pearson(scored, ["momentum_5"], "target_return_5").collect()] == [None]


def test_short_session_and_targets(spark):
    b = bars(spark, [1.0, 2.0, 3.0], walk(40))
    rows = targets.add_targets(b).orderBy("ts").collect()
    for n in (5, 15, 30):
        got = [r[f"target_return_{n}"] for r in rows]
        assert got[:3] == [None] * 3 and got[-n:] == [None] * n and None not in got[3:-n]
    assert column(indicators.atr(b)[0], "atr")[:3] == [0.0] * 3
    assert targets.add_targets(bars(spark, [0.0, 1.0, 0.0]), (1,)).filter("target_return_1 is not null").count() == 0
    assert column(targets.add_simple_target(bars(spark, [2.0, 3.0]), 1), "target_simple_1") == [0.5, None]


def test_zero_volume_and_range(spark):
    b = factors.buy_sell_volume(factors.tick_direction(bars(spark, [1.0, 2.0, 1.0], volume=0.0)))
    assert column(b, "buy_ratio") == [None] * 3
    assert column(indicators.volume_ratio(bars(spark, [1.0] * 20, volume=0.0), windows=(15,))[0], "volume_ratio_15") == [None] * 20
    flat = bars(spark, [4.0] * 3).withColumns({"high": F.col("close"), "low": F.col("close")})
    assert column(indicators.candle(flat)[0], "body_ratio") == [None] * 3


def test_tick_direction(spark):
    b = bars(spark, [5.0, 5.0, 6.0, 6.0, 5.0, 5.0], [5.0, 5.0, 7.0])
    assert column(factors.tick_direction(b), "direction") == [None, None, 1, 1, -1, -1, None, None, 1]
    assert column(series.series_direction(b, chunk=2), "direction") == [None, None, 1, 1, -1, -1, -1, -1, 1]
    up = factors.buy_sell_volume(factors.tick_direction(bars(spark, [1.0, 2.0, 3.0])))
    assert column(up, "sell_volume") == [0.0] * 3 and column(up, "buy_volume") == [0.0, 10.0, 10.0]


def test_series_windows_equal_one_window(spark):
    sessions = [walk(n, n) for n in (3, 50, 1, 17, 40)]
    flat = pd.Series([c for s in sessions for c in s])
    b = bars(spark, *sessions)
    for chunk in (31, 1000):
        got = series.series_momentum(b, (5, 30), chunk=chunk)
        close_to(column(got, "momentum_5"), (flat.map(math.log) - flat.map(math.log).shift(5)).tolist())
        close_to(column(got, "zscore_30"), ((flat - flat.rolling(30).mean()) / flat.rolling(30).std()).tolist())
    close_to(column(series.series_targets(b, (5,), chunk=31), "target_return_5"), (flat.map(math.log).shift(-5) - flat.map(math.log)).tolist())
    with pytest.raises(ValueError, match="chunk"):
        series.series_targets(b, (50,), chunk=20)


def test_opening_range_is_closed_on_both_sides(spark):
    at = [dt.datetime(2024, 1, 2, h, m) for h, m in ((7, 59), (8, 0), (9, 29), (9, 30), (9, 31))]
    b = spark.createDataFrame([("ALL", t.date(), t, p, p, p, p, 1.0) for t, p in zip(at, (99.0, 10.0, 12.0, 14.0, 50.0), strict=True)], SCHEMA)
    assert {(r["opening_high"], r["opening_low"], r["opening_midpoint"]) for r in factors.opening_range(b).collect()} == {(14.0, 10.0, 12.0)}
    one = factors.opening_ranges(b).first()
    assert (one["opening_high"], one["opening_low"]) == (14.0, 10.0)
    got = column(factors.opening_exhaustion(b), "factor30")
    assert got[:3] == [None] * 3 and got[3] == pytest.approx(-got[4])
    assert factors.opening_range(bars(spark, [1.0]).withColumn("ts", F.col("ts") - F.expr("interval 2 hours"))).first()["opening_range"] is None


def test_factor_identities(spark):
    b = targets.add_targets(bars(spark, walk(120), walk(120, 2)), (30,))
    df = factors.reversal_score(factors.rolling_z(factors.rev_momentum_z(factors.momentum_z(b))), (30,)).select("*")
    df = factors.rolling_z(df, (30,))
    df = indicators.bollinger(df, windows=(20,))[0]
    ic = {(r["factor"], r["session"]): r["ic"] for r in evaluate.daily_pearson(df, ["momentum_z_30", "rev_momentum_z_30", "momentum_30", "zscore_30", "reversal_score_30"], "target_return_30").collect()}
    days = {s for _, s in ic}
    assert len(days) == 2
    for s in days:
        assert ic["momentum_z_30", s] == pytest.approx(-ic["rev_momentum_z_30", s]) == pytest.approx(ic["momentum_30", s])
        assert ic["zscore_30", s] == pytest.approx(ic["reversal_score_30", s])
    ranks = {(r["factor"], r["session"]): r["ic"] for r in evaluate.daily_spearman(df, ["bb_percent_20_15", "bb_percent_20_25"], "target_return_30").collect()}
    assert all(ranks["bb_percent_20_15", s] == pytest.approx(ranks["bb_percent_20_25", s]) for s in days)
    z = df.groupBy("session").agg(F.avg("momentum_z_30").alias("m"), F.stddev_samp("momentum_z_30").alias("s")).collect()
    assert all(abs(r["m"]) < 1e-9 and r["s"] == pytest.approx(1) for r in z)


def test_nothing_looks_ahead(spark):
    closes = walk(80)
    for make, names in ((indicators.rsi, ["rsi_14"]), (indicators.macd, ["macd"]), (indicators.atr, ["atr"]), (indicators.price_ema, ["price_ema15"])):
        whole, part = make(bars(spark, closes))[0], make(bars(spark, closes[:50]))[0]
        for n in names:
            close_to(column(whole, n)[:50], column(part, n))


def test_spearman_ties_and_short_days(spark):
    r = random.Random(3)
    days = {n: [(r.randrange(5), r.randrange(5)) for _ in range(n)] for n in (19, 20, 30)}
    data = [("ALL", DAY.date() + dt.timedelta(days=k), DAY + dt.timedelta(minutes=i), float(x), float(y)) for k, v in enumerate(days.values()) for i, (x, y) in enumerate(v)]
    df = spark.createDataFrame([*data, ("ALL", DAY.date(), DAY + dt.timedelta(hours=2), None, 1.0)], "symbol string, session date, ts timestamp_ntz, f double, t double")
    got = {x["n"]: x["ic"] for x in evaluate.daily_spearman(df, ["f"], "t").collect()}
    assert sorted(got) == [20, 30]
    for n, ic in got.items():
        assert ic == pytest.approx(pd.DataFrame(days[n]).rank().corr().iloc[0, 1])
    kept = evaluate.daily_spearman(df, ["f"], "t", least=30, keep_short=True).collect()
    assert len(kept) == 3 and sum(x["ic"] is not None for x in kept) == 1
    summary = evaluate.ic_score(evaluate.ic_summary(evaluate.daily_spearman(df, ["f"], "t"))).first()
    v = pd.Series(list(got.values()))
    assert summary["ic_std"] == pytest.approx(v.std(ddof=0)) and summary["ic_score"] == pytest.approx(abs(v.mean()) / v.std(ddof=0))


def test_quintiles_against_qcut(spark):
    r = random.Random(9)
    days = [[(r.random(), r.random()) for _ in range(33)], [(float(r.randrange(3)), r.random()) for _ in range(40)], [(r.random(), r.random()) for _ in range(29)], [(r.random(), r.random()) for _ in range(57)]]
    df = spark.createDataFrame([("ALL", DAY.date() + dt.timedelta(days=k), DAY + dt.timedelta(minutes=i), x, y) for k, d in enumerate(days) for i, (x, y) in enumerate(d)], "symbol string, session date, ts timestamp_ntz, f double, t double")
    want = pd.concat([f.groupby(pd.qcut(f[0], 5, labels=False))[1].mean() for f in map(pd.DataFrame, (days[0], days[3]))], axis=1).mean(axis=1)
    got = {x["q"]: (x["mean_return"], x["n_days"]) for x in evaluate.quintile_returns(df, ["f"], "t").collect()}
    assert {q: n for q, (_, n) in got.items()} == dict.fromkeys(range(5), 2)
    close_to([got[q][0] for q in range(5)], want.tolist())


def test_extremes(spark):
    df = spark.createDataFrame([("f", 0, 0.5), ("f", 1, -0.5), ("f", 2, -0.5), ("f", 75, 0.5), ("f", 3, None)], "factor string, minute_index int, ic double")
    r = evaluate.ic_extremes(df, "worst", top_n=3).first()
    assert (r["ic_min"], r["time_min"], r["ic_max"], r["time_max"]) == (-0.5, "08:01", 0.5, "08:00")
    assert r["mean_extreme"] == pytest.approx(-1 / 6)
    assert evaluate.ic_extremes(df, "best", top_n=2, market_open="09:00").first()["time_min"] == "09:01"
    with pytest.raises(ValueError, match="mode"):
        evaluate.ic_extremes(df, "other")


def test_generator_must_make_its_columns(spark):
    with pytest.raises(ValueError, match="doesn't make"):
        evaluate.evaluate_factor(targets.add_targets(bars(spark, walk(50))), factors.rev_momentum_z, "momentum_z_")


def test_correlation_matrices(spark):
    r = random.Random(6)
    data = [(k, r.choice([None, r.random()]), r.random(), float(r.randrange(4))) for k in range(300)]
    df = spark.createDataFrame(data, "k int, a double, b double, c double")
    p = pd.DataFrame(data, columns=["k", "a", "b", "c"])[["a", "b", "c"]].astype(float)
    for x in select.pearson_pairs(df, ["a", "b", "c"]).collect():
        assert x["corr"] == pytest.approx(p[x["factor_1"]].corr(p[x["factor_2"]]))
    whole = p.corr(method="spearman")
    pairs = select.spearman_pairs(df, ["a", "b", "c"], ["k"])
    for x in pairs.collect():
        assert x["corr"] == pytest.approx(whole.loc[x["factor_1"], x["factor_2"]])
    assert {x["factor"] for x in select.corr_with(pairs, "b").collect()} == {"a", "c"}
    both = select.pearson_pairs(df, ["a", "b", "c"], both_ways=True)
    near = select.top_neighbours(both, spark.createDataFrame([("a", 1.0), ("z", 0.5)], "factor string, ic_score double"), 2)
    rows = {x["factor"]: x for x in near.collect()}
    assert {rows["a"]["corr_ind_1"], rows["a"]["corr_ind_2"]} == {"b", "c"} and rows["z"]["corr_ind_1"] is None


def test_greedy_selection(spark):
    scores = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.38), ("d", 0.36), ("e", 0.1), ("n", None)], "factor string, ic_score double")
    pairs = spark.createDataFrame([("a", "b", -0.95), ("a", "c", 0.6), ("a", "d", 0.2), ("c", "d", 0.75)], "factor_1 string, factor_2 string, corr double")
    got = {r["factor"]: (r["selected"], r["max_corr"]) for r in select.select_greedy(scores, pairs).collect()}
    assert got == {"a": (True, 0.0), "b": (False, 0.95), "c": (True, 0.6), "d": (False, 0.75), "e": (False, 0.0)}
    assert sum(r["selected"] for r in select.select_greedy(scores, pairs, as_written=True).collect()) == 4


def test_signals(spark):
    df = spark.createDataFrame([(20.0, 50.0, 0.05, 0.03), (20.0, 50.0, None, 0.01), (None, None, None, None)], "rsi_14 double, stoch_k_14 double, bb_percent_20_20 double, atr_norm double")
    out = signals.flags(signals.reversal_signal(df)).collect()
    assert out[0]["reversal_score"] == pytest.approx(1 - (0.2 + 0.5 + 0.05) / 3) and out[1]["reversal_score"] is None
    assert [(r["volatility_filter"], r["rebound_trigger"]) for r in out] == [(1, 1), (0, 0), (0, 0)]
    assert signals.clean(df, ["rsi_14", "bb_percent_20_20"]).count() == 1


def test_no_bar_table_in_one_task(spark):
    """One Exchange by session serves a chain of windows, and none is to a single partition."""
    b = bars(spark, walk(40), walk(40, 2))
    plan = factors.feature_table(b)[0]._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and plan.count("Exchange hashpartitioning") == 1
    scored = targets.add_targets(factors.momentum_z(b))
    plan = evaluate.mean_ic_by_horizon(scored, {n: f"momentum_z_{n}" for n in (5, 15, 30)}, drop="all")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Scan") == 1
    plan = series.series_momentum(b, chunk=100)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("share", [1000, 4])
def test_ranks_of_values_that_most_rows_have(spark, monkeypatch, share):
    """Ranks of broadcast and of joined values, group by group."""
    monkeypatch.setattr(select, "HOT", share)
    r = random.Random(2)
    table = [(k, g, r.choice([0.0, 0.0, 0.0, r.random(), 1.5]) if g else float(r.randrange(40))) for k in range(300) for g in range(2) if k % 17 or g]
    want = pd.DataFrame(table, columns=["k", "g", "x"])
    want["rank"] = want.groupby("g")["x"].rank()
    got = select.dealt_ranks(spark.createDataFrame(table, "k long, g int, x double").repartition(3), ["k"], "g", "x")
    assert sorted(map(tuple, got.select("k", "g", "rank").collect())) == sorted((int(k), int(g), x) for k, g, x in want[["k", "g", "rank"]].itertuples(index=False))


@pytest.mark.parametrize("parts", [1, 7])
def test_correlations_over_the_rows_that_a_pair_has(spark, parts):
    """All pairs, plain and by ranks, against pandas: equal, nested and crossing patterns of missing values, a constant, a column of nothing, large means."""
    r = np.random.default_rng(4)
    x = pd.DataFrame({"k": np.arange(400), "a": r.integers(0, 30, 400) * 1.0, "b": r.normal(1e6, 1, 400), "c": r.normal(0, 1, 400), "d": 7.3, "e": np.nan, "f": r.normal(0, 1, 400), "g": r.integers(0, 3, 400) * 1.0})
    x["f"] += x["a"]
    x.loc[:30, ["a", "b"]] = np.nan
    x.loc[:90, "f"] = np.nan
    x.loc[350:, "c"] = np.nan
    x.loc[x["k"] % 7 == 3, "g"] = np.nan
    names = list("abcdefg")
    table = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in row) for row in x.itertuples(index=False)]
    df = spark.createDataFrame(table, "k long, " + ", ".join(f"{c} double" for c in names)).repartition(parts)
    for found, want in ((select.pearson_pairs(df, names), x[names].corr()), (select.spearman_pairs(df, names, ["k"]), x[names].corr(method="spearman"))):
        got = {(p["factor_1"], p["factor_2"]): p["corr"] for p in found.collect()}
        assert set(got) == {(p, q) for i, p in enumerate(names) for q in names[i + 1 :]}
        for (p, q), value in got.items():
            assert value is None if {p, q} & {"d", "e"} else value == pytest.approx(want.loc[p, q], abs=1e-8), (p, q)
    n = select.shared_rows(df, names)
    assert n["a", "b"] == n["a", "a"] and len(set(select.rankings(n, names).values())) < 21


def test_moments_merge(spark):
    """Parts of any size, empty ones too, give what all rows at once give."""
    r = random.Random(8)
    rows = [(k % 9, k % 2, 1e6 + r.random() if r.random() < 0.8 else None, None if k % 9 == 4 else r.gauss(0, 1)) for k in range(900)] + [(20, 2, None, 1.0)]
    df = spark.createDataFrame(rows, "part int, g int, x double, y double")
    parts = df.groupBy("part", "g").agg(moments.pair_moments("x", "y").alias("m")).select("part", "g", "m.*")
    got = {m["g"]: (m["n"], m["corr"]) for m in moments.merge(parts, ["g"]).select("g", "n", moments.correlation().alias("corr")).collect()}
    for g in (0, 1):
        both = pd.DataFrame([x[2:] for x in rows if x[1] == g], columns=["x", "y"]).dropna()
        assert got[g] == (len(both), pytest.approx(both["x"].corr(both["y"]), abs=1e-9))
    assert got[2] == (0, None)


def test_feature_table_is_rewritten_by_session(spark, tmp_path):
    """A rerun replaces its sessions and leaves the others; windows over what is read need no Exchange, and other folders aren't read."""
    b = bars(spark, walk(30), walk(30, 2), walk(30, 3))
    days = sorted({r["session"] for r in b.select("session").collect()})
    table = FeatureTable(spark, str(tmp_path / "t"), f"features_{os.getpid()}", buckets=3, rows_per_file=20).write(b)
    again = b.filter(F.col("session") == F.lit(days[1])).withColumn("close", F.lit(7.0))
    for _ in range(2):
        table.write(again)
    got = table.read()
    assert got.count() == 90 and got.filter("close = 7.0").select("session").distinct().collect()[0][0] == days[1]
    assert all(len(pq.read_table(p)) <= 20 for p in (tmp_path / "t").rglob("*.parquet"))
    scored = factors.momentum_z(table.read(), (5,))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    want = factors.momentum_z(b.filter(F.col("session") != F.lit(days[1])), (5,)).select("ts", "momentum_z_5").collect()
    assert sorted(map(tuple, scored.filter(F.col("session") != F.lit(days[1])).select("ts", "momentum_z_5").collect()), key=str) == sorted(map(tuple, want), key=str)
    part = table.read(days[1], days[1])
    assert part.count() == 30 and "PartitionFilters: [isnotnull(day" in part._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="other columns"):
        table.write(b.withColumn("more", F.lit(1)))
    # another table of the same path finds what is there
    other = FeatureTable(spark, str(tmp_path / "t"), f"again_{os.getpid()}", buckets=3).write(again)
    assert other.read().count() == 90
    assert table.remove([days[0]]).read().count() == 60
    with pytest.raises(ValueError, match="written"):
        FeatureTable(spark, str(tmp_path / "none"), "nothing").read()


def test_functions_of_a_session(spark):
    b = bars(spark, walk(25), walk(40, 2)).repartition(5)
    got = sessions.add_by_session(b, lambda t: {"place": np.arange(t.num_rows), "close": [float(x or 0) for x in t.column("close").to_pylist()]}, "place long, close double")
    want = b.withColumn("place", Session().ordinal().cast("long"))
    assert sorted(map(str, got.select("ts", "place", "close").collect())) == sorted(map(str, want.select("ts", "place", "close").collect()))
    counts = sessions.table_by_session(b, lambda t: {"k": [1, 2], "n": [t.num_rows] * 2}, "k int, n long")
    assert sorted((r["k"], r["n"]) for r in counts.collect()) == [(1, 25), (1, 40), (2, 25), (2, 40)]
    assert sessions.add_by_session(b.filter("false"), lambda t: {"x": []}, "x double").count() == 0
    for bad, match in ((lambda t: {"y": [1.0]}, "returns y"), (lambda t: {"x": [1.0]}, "rows"), (lambda t: {"x": ["a"] * t.num_rows}, "x is not")):
        with pytest.raises(Exception, match=match):
            sessions.add_by_session(b, bad, "x double").collect()
    with pytest.raises(ValueError, match="ts"):
        sessions.add_by_session(b.drop("ts"), lambda t: {}, "x double")


def test_ranks_share_ties():
    r = np.random.default_rng(1)
    for x in (np.zeros(0), np.ones(5), r.integers(0, 6, 200) * 1.0, r.normal(size=50)):
        assert sessions.ranks(x).tolist() == pd.Series(x).rank().tolist()


def test_history_reads_what_is_added_only(spark, tmp_path):
    """Batches added one by one give what all sessions at once give; a batch added again changes nothing."""
    r = random.Random(3)
    days = [DAY.date() + dt.timedelta(days=k) for k in range(8)]
    rows = [("ALL", d, dt.datetime.combine(d, dt.time(8)) + dt.timedelta(minutes=m), r.choice([None, 1.0, 2.0, r.random()]), 1e6 + r.random(), None if m > 35 else r.gauss(0, 1)) for d in days for m in range(40)]
    df = spark.createDataFrame(rows, "symbol string, session date, ts timestamp_ntz, a double, b double, y double")
    whole = history.IcHistory(spark, str(tmp_path / "whole"), ["a", "b"], "y", least=5).add(df, "all")
    found = history.IcHistory(spark, str(tmp_path / "parts"), ["a", "b"], "y", least=5)
    for name, part in (("b0", days[:5]), ("b1", days[5:6]), ("b2", days[6:]), ("b1", days[5:6])):
        seen = df.filter(F.col("session").isin(part)).withColumn("a", F.when(F.assert_true(F.col("session").isin(part)).isNull(), F.col("a")))
        found.add(seen, name)
    close = lambda x: [tuple(round(v, 6) if isinstance(v, float) else v for v in row) for row in sorted(map(tuple, x.collect()), key=str)]
    for of in ("daily", "by_minute", "moving"):
        assert close(getattr(found, of)()) == close(getattr(whole, of)())
    assert close(found.by_minute()) == close(evaluate.ic_by_minute(df, ["a", "b"], "y").select("factor", "minute_index", "n", "ic"))
    assert close(found.daily().select("symbol", "session", "factor", "n", "ic")) == close(evaluate.daily_pearson(df, ["a", "b"], "y"))
    assert [x for x in close(found.moving(3)) if x[-1] is not None]
