"""Bars (symbol, session, ts, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorlab.functions.safe import nan_to_null, require_columns

SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType(), False),
        T.StructField("session", T.DateType(), False),
        T.StructField("ts", T.TimestampNTZType(), False),
        *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")],
    ]
)
FIELDS = [f.name for f in SCHEMA]


def prepare(df: DataFrame, time: str = "ts", symbol: str | None = None) -> DataFrame:
    """Bars from any table with a time and prices: time cast, session derived and put first, NaN made NULL."""
    require_columns(df, time, "open", "high", "low", "close", "volume")
    at = F.col(time).cast("timestamp_ntz")
    rest = [c for c in df.columns if c not in (time, symbol, "ts", "session", "symbol")]
    out = df.select((F.col(symbol) if symbol else F.lit("ALL")).cast("string").alias("symbol"), F.to_date(at).alias("session"), at.alias("ts"), *rest)
    return nan_to_null(out)


def read_bars(spark: SparkSession, path: str, time: str = "ts", symbol: str | None = None) -> DataFrame:
    return prepare(spark.read.parquet(path), time, symbol)


def write_features(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A feature table in Parquet, a folder for each session, so that readers of some sessions skip the others; a folder has a file for each task that has some of its symbols."""
    df.repartition("session", "symbol").write.mode(mode).partitionBy("session").parquet(path)


def _edge(value: Column, *order: Column) -> tuple[Column, Column]:
    """The values at the smallest and the largest of `order`, ties broken by the value."""
    key = F.struct(*order, value.alias("_value"))
    return F.min(key)["_value"], F.max(key)["_value"]


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar for each shipping day, a session for each year."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return _daily(lines, F.lit("ALL"))


def bars_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bars_daily, for each brand."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    return _daily(lines.join(parts, lines["l_partkey"] == parts["p_partkey"]), F.col("p_brand"))


def _daily(lines: DataFrame, symbol: Column) -> DataFrame:
    price = F.col("l_extendedprice")
    first, last = _edge(price, F.col("l_orderkey"), F.col("l_linenumber"))
    out = lines.groupBy(symbol.alias("symbol"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts")).agg(first.alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), last.alias("close"), F.sum("l_quantity").alias("volume"))
    return nan_to_null(out.select("symbol", F.year("ts").alias("session"), *FIELDS[2:]))


def bars_intraday(spark: SparkSession, sf_dir: str, minutes: int = 15, offset: float = 100.0) -> DataFrame:
    """Bars of some minutes from events, a session for each day. The offset keeps prices positive."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    price = F.col("value") + offset
    first, last = _edge(price, F.col("ts"))
    start = F.window("ts", f"{minutes} minutes")["start"]
    out = events.groupBy(start.cast("timestamp_ntz").alias("at")).agg(first.alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), last.alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return nan_to_null(out.select(F.lit("ALL").alias("symbol"), F.to_date("at").alias("session"), F.col("at").alias("ts"), *FIELDS[3:]))
