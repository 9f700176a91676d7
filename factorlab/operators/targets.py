"""Forward returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorlab.functions.safe import col, div, require_columns
from factorlab.functions.windows import Session

HORIZONS = (5, 15, 30)


def ln(c: Column | str) -> Column:
    """Natural logarithm; NULL for what has none."""
    return F.when(col(c) > 0, F.ln(col(c)))


def add_targets(df: DataFrame, horizons: tuple[int, ...] = HORIZONS, price: str = "close", keys: list[str] | None = None) -> DataFrame:
    """target_return_N = ln(price N rows on) - ln(price), within the session; NULL in its last N rows."""
    require_columns(df, price, "session", "ts")
    s = Session(keys)
    return df.withColumns({f"target_return_{n}": ln(s.lead(price, n)) - ln(price) for n in horizons})


def add_simple_target(df: DataFrame, horizon: int = 5, price: str = "close", keys: list[str] | None = None, name: str | None = None) -> DataFrame:
    s = Session(keys)
    return df.withColumn(name or f"target_simple_{horizon}", div(s.lead(price, horizon), price) - 1)
