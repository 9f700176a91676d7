"""Moments of pairs of values that can be merged: counts, means, squared deviations, co-deviations, least and greatest values.

Parts are made by an aggregate (by keys), or for all pairs of many columns by products of matrices, one part a task. They are merged by
their means' distances from the common mean, so nothing is lost to large means, and a constant stays one however its rows are split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import kept
from .safe import col

FIELDS = ["n", "mean_x", "mean_y", "dev_x", "dev_y", "co", "low_x", "high_x", "low_y", "high_y"]
SCHEMA = "n long, " + ", ".join(f"{c} double" for c in FIELDS[1:])


def pair_moments(x: Column | str, y: Column | str) -> Column:
    """An aggregate: the moments, as one struct, of the rows that have both values."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x).cast("double"), F.when(both, y).cast("double")
    n = F.count(x)
    return F.struct(n.alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), (F.var_pop(x) * n).alias("dev_x"), (F.var_pop(y) * n).alias("dev_y"), (F.covar_pop(x, y) * n).alias("co"), F.min(x).alias("low_x"), F.max(x).alias("high_x"), F.min(y).alias("low_y"), F.max(y).alias("high_y"))


def merge(parts: DataFrame, by: list[str]) -> DataFrame:
    """One row of moments for each `by` from rows of parts. Parts are kept in two sums, the second about the means that the first finds."""
    some = parts.filter("n > 0")
    means = some.groupBy(*by).agg(*[(F.sum(F.col(f"mean_{v}") * F.col("n")) / F.sum("n")).alias(f"_{v}") for v in "xy"])
    names = [f"_by{k}" for k in range(len(by))]
    means = means.select(*[F.col(b).alias(k) for b, k in zip(by, names)], "_x", "_y")
    on = [F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, names)]
    away = {v: F.col(f"mean_{v}") - F.col(f"_{v}") for v in "xy"}
    near = some.join(means, on)
    sums = [F.sum("n").alias("n"), F.first("_x").alias("mean_x"), F.first("_y").alias("mean_y")]
    sums += [F.sum(F.col(f"dev_{v}") + F.col("n") * away[v] * away[v]).alias(f"dev_{v}") for v in "xy"]
    sums += [F.sum(F.col("co") + F.col("n") * away["x"] * away["y"]).alias("co")]
    sums += [f(c).alias(c) for v in "xy" for f, c in ((F.min, f"low_{v}"), (F.max, f"high_{v}"))]
    merged = near.groupBy(*by).agg(*sums)
    # what has no rows in any part stays, with a count of 0
    none = parts.groupBy(*by).agg(F.sum("n").alias("n")).filter("n = 0")
    return merged.unionByName(none, allowMissingColumns=True)


def correlation(of: str | None = None) -> Column:
    """Pearson correlation from moments (columns, or the fields of the struct `of`); NULL where one of the two is constant."""
    c = lambda name: F.col(f"{of}.{name}" if of else name)
    varies = (c("low_x") < c("high_x")) & (c("low_y") < c("high_y"))
    return F.when(varies, F.try_divide(c("co"), F.nullif(F.sqrt(c("dev_x")) * F.sqrt(c("dev_y")), F.lit(0.0))))


def _masked(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Moments of all pairs of columns (missing values are NaN): entry i, j is of column i over the rows that have i and j."""
    there = ~np.isnan(x)
    mask = there.astype(np.float64)
    n = mask.T @ mask
    own = np.where(there, x, 0.0).sum(axis=0) / np.maximum(mask.sum(axis=0), 1)
    z = np.where(there, x - own, 0.0)
    s, q, g = z.T @ mask, (z * z).T @ mask, z.T @ z
    m = np.maximum(n, 1)
    low, high = np.full(n.shape, np.inf), np.full(n.shape, -np.inf)
    for j in range(x.shape[1]):
        rows = x[there[:, j]]
        low[:, j] = np.fmin.reduce(rows, axis=0, initial=np.inf)
        high[:, j] = np.fmax.reduce(rows, axis=0, initial=-np.inf)
    return n, own[:, None] + s / m, q - s * s / m, g - s * s.T / m, low, high


def _joined(a: tuple, b: tuple) -> tuple:
    n = a[0] + b[0]
    away = b[1] - a[1]
    share = np.divide(b[0], n, out=np.zeros_like(n), where=n > 0)
    weight = a[0] * share
    return n, a[1] + away * share, a[2] + b[2] + away * away * weight, a[3] + b[3] + away * away.T * weight, np.minimum(a[4], b[4]), np.maximum(a[5], b[5])


def all_pairs(df: DataFrame, width: int, matrix: Callable[[pa.RecordBatch], np.ndarray], pairs: dict[tuple[str, str], tuple[int, int]]) -> DataFrame:
    """factor_1, factor_2 and moments of each named pair of columns of what `matrix` makes of a batch (rows, width).

    A task adds up its batches' matrix products and gives one row for each pair, so no row is laid out by column and what is shuffled
    does not grow with the rows.
    """
    first, second = (np.array([p[k] for p in pairs.values()], dtype=np.int64) for k in (0, 1))
    names = [pa.array([p[k] for p in pairs]) for k in (0, 1)]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = _masked(matrix(batch))
                total = part if total is None else _joined(total, part)
        if total is None:
            total = (*[np.zeros((width, width)) for _ in range(4)], np.full((width, width), np.inf), np.full((width, width), -np.inf))
        n, mean, dev, co, low, high = total
        of = lambda m: (m[first, second], m[second, first])
        columns = [n[first, second].astype(np.int64), *of(mean), *[np.maximum(d, 0) for d in of(dev)], co[first, second], of(low)[0], of(high)[0], of(low)[1], of(high)[1]]
        yield pa.RecordBatch.from_arrays([*names, *map(pa.array, columns)], ["factor_1", "factor_2", *FIELDS])

    return merge(kept(df.mapInArrow(f, f"factor_1 string, factor_2 string, {SCHEMA}")), ["factor_1", "factor_2"])


def columns_of(batch: pa.RecordBatch) -> np.ndarray:
    """All columns of a batch of doubles side by side, nulls as NaN."""
    return np.stack([np.array(c.fill_null(np.nan), dtype=np.float64) for c in batch.columns], axis=1)
