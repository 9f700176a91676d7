"""Information coefficients over a growing history: what a batch of sessions adds is computed from those sessions alone.

Two Parquet tables are kept at a path. `days` has the moments and the rank correlation of each (symbol, session, factor), a folder for each
session. `minutes` has the moments of each (factor, minute of the session), a folder for each batch. IC by day, moving IC and IC by
minute follow from their few rows; bars are never read again. A batch or session that is written again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlab.functions.moments import FIELDS, correlation, merge, pair_moments
from factorlab.functions.windows import Session

from . import evaluate


class IcHistory:
    """The history, at `path`, of some factors against one target."""

    def __init__(self, spark: SparkSession, path: str, factors: list[str], target: str, keys: list[str] | None = None, least: int = 30) -> None:
        self.spark, self.path, self.factors, self.target, self.keys, self.least = spark, path, factors, target, keys, least
        self.session = Session(keys)

    def _moments(self, df: DataFrame, by: list[str]) -> DataFrame:
        """by, factor and moments, all factors in one aggregate."""
        each = df.groupBy(*by).agg(*[pair_moments(f, self.target).alias(f"_{k}") for k, f in enumerate(self.factors)])
        found = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f"_{k}").alias("m")) for k, f in enumerate(self.factors)])
        return each.select(*by, F.explode(found).alias("_f")).select(*by, "_f.factor", "_f.m.*")

    def add(self, df: DataFrame, batch: str) -> IcHistory:
        """Adds the sessions of df (bars with factors and target) as a batch. Sessions must be whole; a batch of the same name, and sessions
        that are there already, are replaced, so sessions must stay in their batch."""
        by = self.session.by
        df = df.select(*by, "ts", *self.factors, self.target)
        ranked = evaluate.daily_spearman(df, self.factors, self.target, self.keys, self.least, keep_short=True).select(*by, "factor", F.col("ic").alias("rank_ic"))
        days = self._moments(df, by).join(ranked, [*by, "factor"])
        self._put(days.withColumn("day", F.col("session")), "days", "day")
        minutes = self._moments(df.withColumn("minute_index", self.session.ordinal()), ["minute_index"])
        self._put(minutes.withColumn("batch", F.lit(batch)), "minutes", "batch")
        return self

    def _put(self, df: DataFrame, table: str, folder: str) -> None:
        df.repartition(folder).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(folder).parquet(f"{self.path}/{table}")

    def _get(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}")

    def daily(self) -> DataFrame:
        """keys, session, factor, n, ic (Pearson) and rank_ic (NULL below `least` pairs)."""
        return self._get("days").select(*self.session.by, "factor", "n", correlation().alias("ic"), "rank_ic")

    def moving(self, days: int = 20) -> DataFrame:
        """keys, session, factor, n, ic (of ranks) and ic_moving, the mean of the last `days` sessions where all have a value."""
        return evaluate.rolling_ic(self.daily().select(*self.session.by, "factor", "n", F.col("rank_ic").alias("ic")), days, self.session.by[:-1])

    def by_minute(self) -> DataFrame:
        """factor, minute_index, n, ic across all sessions so far."""
        return merge(self._get("minutes").select("factor", "minute_index", *FIELDS), ["factor", "minute_index"]).select("factor", "minute_index", "n", correlation().alias("ic")).filter("n > 0")
