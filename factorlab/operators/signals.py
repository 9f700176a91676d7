"""Composite signals of rsi_14, stoch_k_14, bb_percent_20_20 and atr_norm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorlab.functions.safe import flag


def reversal_signal(df: DataFrame, rsi: str = "rsi_14", stoch: str = "stoch_k_14", band: str = "bb_percent_20_20") -> DataFrame:
    """rsi_norm, stoch_k_norm and reversal_score = 1 - the mean of both and %B."""
    df = df.withColumns({"rsi_norm": F.col(rsi) / 100, "stoch_k_norm": F.col(stoch) / 100})
    return df.withColumn("reversal_score", 1 - (F.col("rsi_norm") + F.col("stoch_k_norm") + F.col(band)) / 3)


def flags(df: DataFrame, rsi: str = "rsi_14", band: str = "bb_percent_20_20", range_: str = "atr_norm", volatile: float = 0.02, oversold: float = 30, near: float = 0.1) -> DataFrame:
    """volatility_filter and rebound_trigger, 0 or 1."""
    loud = F.col(range_) > volatile
    return df.withColumns({"volatility_filter": flag(loud), "rebound_trigger": flag((F.col(rsi) < oversold) & (F.col(band) < near) & loud)})


def clean(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, without rows that miss any of them."""
    return df.select(*columns).na.drop("any")
