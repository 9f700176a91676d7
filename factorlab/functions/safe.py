"""Arithmetic that gives NULL where it has no value; in ANSI mode Spark's own would fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a: Column | str, b: Column | str, infinite: bool = False) -> Column:
    """a / b; where b is 0, NULL, or with `infinite` the signed infinity of a nonzero a."""
    a, b = col(a), col(b)
    if not infinite:
        return F.try_divide(a, b)
    return F.when((b == 0) & (a > 0), F.lit(float("inf"))).when((b == 0) & (a < 0), F.lit(float("-inf"))).otherwise(F.try_divide(a, b))


def corr_safe(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation of the rows that have both; NULL where one of them is constant."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    # the deviation of a constant need not be 0 once parts of it have been merged
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))))


def pair_count(x: Column | str, y: Column | str) -> Column:
    return F.count(F.when(col(x).isNotNull() & col(y).isNotNull(), F.lit(1)))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is the one marker of missing values in floating columns that this library doesn't use; it becomes NULL once, on load."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0, also where it is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
