"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """id and comp, the smallest id reachable, for each id in the long columns a and b of `edges`.

    Each round takes the smallest label among neighbours and then the label's own label, so that paths halve. Labels are written
    after each round, so that joins are between plain tables, of which Spark can split the hot keys; it ends when none changes. No edges give no rows.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    both = scratch.written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct())
    labels = scratch.written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("_b")).select("id", F.least("id", "_b").alias("comp")))
    while labels.limit(1).count():
        near = both.join(labels.withColumnsRenamed({"id": "b"}), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("_near"))
        closer = labels.join(near, "id").select("id", "comp", F.least("comp", "_near").alias("_new"))
        jump = labels.select(F.col("id").alias("_new"), F.col("comp").alias("_far"))
        after = scratch.written(closer.join(jump, "_new", "left").select("id", F.col("comp").alias("_old"), F.least("_new", F.coalesce("_far", "_new")).alias("comp")))
        scratch.drop(labels)
        labels = after
        if not after.filter("_old != comp").limit(1).count():
            break
    return labels.select("id", "comp")
