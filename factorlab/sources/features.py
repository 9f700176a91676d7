"""Feature tables that are kept: rewritten session by session, and laid out so that windows over sessions read them without an Exchange."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlab.functions.safe import require_columns

#: The folder of a session; the session itself is a column of the files, as only those can be dealt into buckets.
FOLDER = "day"


class FeatureTable:
    """A Parquet table of bars and features at a path, a folder for each session and in it a file (or some) for each bucket of
    (symbol, session).

    Writing replaces the sessions that the rows belong to and leaves the others; so a rerun never doubles a session. (A session of which
    a rerun has no rows at all stays; remove() takes it away.) Files have at most `rows_per_file` rows. Rows of one (symbol, session) are in
    one bucket, by the hash that Spark deals rows by, so a window over them needs no Exchange; how many sessions are read doesn't matter to
    that. Another session of Spark finds the table at its path again.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int = 64, rows_per_file: int = 5_000_000) -> None:
        self.spark, self.path, self.name, self.buckets, self.rows_per_file = spark, path, name, buckets, rows_per_file

    def _made(self, df: DataFrame) -> None:
        if self.spark.catalog.tableExists(self.name):
            have = {f.name: f.dataType for f in self.spark.table(self.name).schema if f.name != FOLDER}
            if have != {f.name: f.dataType for f in df.schema}:
                raise ValueError(f"{self.name} has other columns than what is written")
            return
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        kind = df.schema["session"].dataType.simpleString()
        self.spark.sql(f"CREATE TABLE {self.name} ({columns}, {FOLDER} {kind}) USING parquet PARTITIONED BY ({FOLDER}) CLUSTERED BY (symbol, session) SORTED BY (symbol, session, ts) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        store, place = self._place(self.path)
        if store.exists(place):  # sessions that are there already
            self.spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def _place(self, path: str) -> tuple:
        """The file system of a path, and the path for it."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def write(self, df: DataFrame) -> FeatureTable:
        """Replaces the sessions of df."""
        require_columns(df, "symbol", "session", "ts")
        if FOLDER in df.columns:
            raise ValueError(f"{FOLDER} is the name of the folders' column")
        self._made(df)
        order = [c for c in self.spark.table(self.name).columns if c != FOLDER]
        # dealt out as the buckets are, so a bucket's rows of a session are written by one task
        rows = df.select(*order, F.col("session").alias(FOLDER)).repartition(self.buckets, "symbol", "session")
        # an insert into a table takes both from the session, not from the writer
        conf = self.spark.conf
        settings = {"spark.sql.sources.partitionOverwriteMode": "dynamic", "spark.sql.files.maxRecordsPerFile": str(self.rows_per_file)}
        before = {k: conf.get(k) for k in settings}
        try:
            for k, v in settings.items():
                conf.set(k, v)
            rows.write.mode("overwrite").insertInto(self.name)
        finally:
            for k, v in before.items():
                conf.set(k, v)
        return self

    def remove(self, sessions: Iterable) -> FeatureTable:
        """Takes sessions away with their files."""
        for s in sessions:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({FOLDER} = '{s}')")
            store, place = self._place(f"{self.path}/{FOLDER}={s}")
            store.delete(place, True)
        return self

    def read(self, first=None, last=None) -> DataFrame:
        """Sessions from `first` to `last`, both included; other folders aren't read."""
        if not self.spark.catalog.tableExists(self.name):
            raise ValueError(f"{self.name} has not been written")
        df = self.spark.table(self.name)
        for bound, keep in ((first, lambda b: F.col(FOLDER) >= F.lit(b)), (last, lambda b: F.col(FOLDER) <= F.lit(b))):
            df = df if bound is None else df.filter(keep(bound))
        return df.drop(FOLDER)
