"""Correlation of factors and selection of those that say something new."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorlab.functions.lineage import kept
from factorlab.functions.moments import all_pairs, columns_of, correlation

#: A value that more than one in HOT of a group's rows have is broadcast with its rank.
HOT = 1000


def pearson_pairs(df: DataFrame, columns: list[str], both_ways: bool = False) -> DataFrame:
    """factor_1, factor_2, corr of all pairs, from the rows that have both: products of the matrices of values and of what is missing, added up by task."""
    pairs = {(columns[i], columns[j]): (i, j) for i, j in combinations(range(len(columns)), 2)}
    values = df.select(*[F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(columns)])
    out = all_pairs(values, len(columns), columns_of, pairs).select("factor_1", "factor_2", correlation().alias("corr"))
    return out.union(out.select("factor_2", "factor_1", "corr")) if both_ways else out


def top_neighbours(pairs: DataFrame, scores: DataFrame, n: int = 5) -> DataFrame:
    """factor, ic_score, corr_ind_1.., corr_value_1..: the n most correlated factors by absolute value, the sign kept.

    pairs has both directions. A factor without neighbours has NULLs.
    """
    best = Window.partitionBy("factor_1").orderBy(F.abs("corr").desc(), "factor_2")
    ranked = pairs.filter("corr is not null").withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= n)
    at = lambda c, k: F.max(F.when(F.col("_k") == k, F.col(c)))
    wide = ranked.groupBy(F.col("factor_1").alias("factor")).agg(*[at("factor_2", k).alias(f"corr_ind_{k}") for k in range(1, n + 1)], *[at("corr", k).alias(f"corr_value_{k}") for k in range(1, n + 1)])
    return scores.select("factor", "ic_score").join(wide, "factor", "left")


def dealt_ranks(long: DataFrame, row: list[str], group: str, value: str) -> DataFrame:
    """row, group, rank: the average rank of each row's value among all rows of its group.

    No task holds a group: values are counted, dealt out by ranges of (group, value), and a range's ranks begin where the counts of the
    ranges before it end. A value that a large share of a group's rows have isn't joined in one task.
    """
    long = long.select(*row, F.col(group).alias("column"), F.col(value).alias("value"))
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("column", "value").withColumn("range", F.spark_partition_id())
    counts = kept(counts)  # sampled range bounds need not repeat
    sizes = counts.groupBy("column", "range").agg(F.sum("n").alias("_size"))
    before = Window.partitionBy("column").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("column", "range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("column", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranks = counts.join(starts, ["column", "range"]).select("column", "value", "n", (F.col("_start") + F.sum("n").over(within) - (F.col("n") - 1) / 2.0).alias("rank"))
    # values that many rows have are fewer than HOT a group and are broadcast; their rows are spread over the join that finds the rest
    rows = sizes.groupBy("column").agg(F.sum("_size").alias("_rows"))
    hot = ranks.join(F.broadcast(rows), "column").filter(F.col("n") * HOT > F.col("_rows")).select("column", "value", F.col("rank").alias("_hot_rank"))
    spread = F.when(F.col("_hot_rank").isNotNull(), 1 + F.pmod(F.xxhash64(*row), F.lit(HOT))).otherwise(F.lit(0).cast("long"))
    placed = long.join(F.broadcast(hot), ["column", "value"], "left").withColumn("_spread", spread)
    placed = placed.join(ranks.withColumn("_spread", F.lit(0).cast("long")), ["column", "value", "_spread"], "left").withColumn("rank", F.coalesce("_hot_rank", "rank"))
    return placed.select(*row, F.col("column").alias(group), "rank")


def shared_rows(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], int]:
    """How many rows have both columns, for each two of them and for each alone."""
    both = list(combinations_with_replacement(columns, 2))
    counts = df.agg(*[F.expr(f"count_if(`{a}` IS NOT NULL AND `{b}` IS NOT NULL)").alias(f"_{k}") for k, (a, b) in enumerate(both)]).first()
    return {x: counts[k] for k, p in enumerate(both) for x in (p, p[::-1])}


def rankings(n: dict[tuple[str, str], int], columns: list[str]) -> dict[tuple[str, str], tuple[str, ...]]:
    """For each pair, the columns whose presence picks its rows: one, where every row that has it has the other too. Of columns that are there
    in the same rows the first stands for all, so pairs that are ranked over the same rows share one ranking of a column."""
    like = {c: next(d for d in columns if n[c, d] == n[c, c] == n[d, d]) for c in columns}
    out = {}
    for a, b in combinations(columns, 2):
        x, y = like[a], like[b]
        out[a, b] = (x,) if n[x, y] == n[x, x] else (y,) if n[x, y] == n[y, y] else tuple(sorted((x, y)))
    return out


def spearman_pairs(df: DataFrame, columns: list[str], row: list[str]) -> DataFrame:
    """factor_1, factor_2, corr of ranks, each pair ranked over the rows that have both; row names a row.

    A column is ranked once for all pairs that leave it the same rows, and again only where what is missing differs. A row's ranks come
    together as one list, and correlations are those lists' matrix products.
    """
    df = kept(df.select(*row, *[F.col(c).cast("double").alias(c) for c in columns]))
    picks = rankings(shared_rows(df, columns), columns)
    number: dict[tuple, int] = {}
    pairs = {(a, b): tuple(number.setdefault((pick, c), len(number)) for c in (a, b)) for (a, b), pick in picks.items()}
    there = lambda pick, c: " AND ".join(f"`{p}` IS NOT NULL" for p in sorted({*pick, c}))
    each = ", ".join(f"CASE WHEN {there(pick, c)} THEN struct({k} AS ranking, `{c}` AS value) END" for (pick, c), k in number.items())
    long = df.select(*row, F.expr(f"explode(filter(array({each}), x -> x IS NOT NULL))").alias("_v")).select(*row, "_v.*")
    ranked = dealt_ranks(long, row, "ranking", "value").groupBy(*row).agg(F.collect_list(F.struct("ranking", "rank")).alias("ranks"))
    width = len(number)

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        lists = batch.column(0)
        out = np.full((len(lists), width), np.nan)
        flat = lists.flatten()
        out[np.repeat(np.arange(len(lists)), np.array(lists.value_lengths())), np.array(flat.field("ranking"))] = np.array(flat.field("rank"))
        return out

    return all_pairs(ranked.select("ranks"), width, matrix, pairs).select("factor_1", "factor_2", correlation().alias("corr"))


def corr_with(pairs: DataFrame, target: str) -> DataFrame:
    """factor, corr_target: the pairs that hold the target."""
    other = F.when(F.col("factor_1") == target, F.col("factor_2")).otherwise(F.col("factor_1"))
    return pairs.filter((F.col("factor_1") == target) | (F.col("factor_2") == target)).select(other.alias("factor"), F.col("corr").alias("corr_target"))


def strongest(pairs: DataFrame, n: int = 10) -> DataFrame:
    return pairs.filter("corr is not null").orderBy(F.abs("corr").desc(), "factor_1", "factor_2").limit(n)


def select_greedy(scores: DataFrame, pairs: DataFrame, first: tuple[float, float] = (0.4, 0.925), second: tuple[float, float] = (0.35, 0.7), neighbours: int | None = None, as_written: bool = False) -> DataFrame:
    """factor, ic_score, max_corr, selected. Factors come by score; one is selected if score and greatest absolute correlation with those
    selected already pass either rule (score at least, correlation below).

    A decision over one row for each factor: those rows and their pairs come to the driver, bars don't. neighbours: look at so many of the most
    correlated factors only. as_written: skip the correlation test.
    """
    spark: SparkSession = scores.sparkSession
    rows = sorted((r for r in scores.select("factor", "ic_score").collect() if r["ic_score"] is not None), key=lambda r: (-r["ic_score"], r["factor"]))
    near: dict[str, list[tuple[float, str]]] = {}
    for r in pairs.filter("corr is not null").collect():
        near.setdefault(r["factor_1"], []).append((abs(r["corr"]), r["factor_2"]))
        near.setdefault(r["factor_2"], []).append((abs(r["corr"]), r["factor_1"]))
    chosen: set[str] = set()
    out = []
    for r in rows:
        close = sorted(set(near.get(r["factor"], [])), key=lambda x: (-x[0], x[1]))[:neighbours]
        most = max((c for c, f in close if f in chosen), default=0.0)
        taken = any(r["ic_score"] >= score and (as_written or most < limit) for score, limit in (first, second))
        if taken:
            chosen.add(r["factor"])
        out.append((r["factor"], float(r["ic_score"]), float(most), taken))
    return spark.createDataFrame(out, "factor string, ic_score double, max_corr double, selected boolean")
