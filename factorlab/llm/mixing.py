"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

Every source is cut into shards, every shard into blocks of about `block` words. The mix has as many seats as the corpus has
blocks; seats go to the sources by the highest quotients target / (2k + 1). A source's seats first cover whole passes over all its
blocks; the rest goes to its shards, again by highest quotients, which gives an integer quota for each shard. In a shard the
blocks are taken in a seeded order, so the result depends on nothing but the rows and the seed.

Sources of more than SHARDS shards have them in parts: seats go to the parts, and those of a part to its shards. Only three kinds of table
are ever gathered: one row for each source, by source at most SHARDS rows of parts, and by part at most SHARDS rows of shards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed

#: Words in a block; words that a shard should have; shards that are apportioned at once, and parts of so many shards that a source may have.
BLOCK, SHARD_WORDS, SHARDS = 32, 1 << 16, 4096
#: Equal rows that are laid out at once.
CHUNK = 4096
#: Multipliers of the seeded order of blocks: primes above any number of blocks in a shard.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3) -> DataFrame:
    """source, source_size, target, from (source, source_size).

    Sources in order of code points, null last, weigh as `weights`, repeated. They share the total by weight; none gets more than
    `cap` times its size, and what is over goes to the others by weight. The water level is found in closed form: ordered by
    size / weight, the capped sources come first, and the level after k of them is what is left over the weight that is left.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(order) - 1) % len(weights)
    weight = reduce(lambda c, k: c.when(at == k, F.lit(float(weights[k]))), range(1, len(weights)), F.when(at == 0, F.lit(float(weights[0]))))
    some = sizes.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    left = F.sum("source_size").over(everyone) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rest = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    some = some.withColumn("level", left / rest)
    # the first source that its own level does not fill ends the capped ones
    some = some.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "level"))).over(everyone)["level"])
    return some.select("source", "source_size", F.least("most", F.col("level") * F.col("weight")).cast("double").alias("target"))


def apportion(parties: DataFrame, by: list[str], votes: str, seats: str, name: str, ties: list[str]) -> DataFrame:
    """Adds the integer column `name`: seats by the highest quotients votes / (2k + 1) among the rows of a group `by`.

    With V votes, N seats and S parties the last quotient that wins lies between V / (2N + S) and V / (2N - S). Quotients above
    are sure, so only about 2S quotients of a group are laid out and ordered.
    """
    group = Window.partitionBy(*by)
    total, n = F.sum(votes).over(group), F.count(F.lit(1)).over(group)
    low = total / (2 * F.col(seats) + n)
    high = F.when(2 * F.col(seats) > n, total / (2 * F.col(seats) - n))
    sure: Column = F.when(F.col(votes) > 0, F.coalesce(F.floor((F.col(votes) / F.col("_high") + 1) / 2) - 1, F.lit(0))).otherwise(0)
    some = parties.withColumns({"_low": low, "_high": high}).withColumn("_sure", F.greatest(sure, F.lit(0)).cast("long"))
    some = some.withColumn("_open", F.when(F.col(votes) > 0, F.ceil((F.col(votes) / F.col("_low") + 1) / 2) + 1).otherwise(0).cast("long"))
    laid = some.withColumn("_left", F.col(seats) - F.sum("_sure").over(group)).select(
        *by, *[c for c in ties if c not in by], votes, "_left", F.explode(F.when(F.col("_open") > F.col("_sure"), F.sequence("_sure", F.col("_open") - 1)).otherwise(F.array())).alias("_k")
    )
    best = Window.partitionBy(*by).orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), *[F.col(c).asc_nulls_last() for c in ties], "_k")
    won = laid.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= F.col("_left")).groupBy(*dict.fromkeys([*by, *ties])).agg(F.count(F.lit(1)).alias("_won"))
    keys = list(dict.fromkeys([*by, *ties]))
    won = won.select(*[F.col(c).alias(f"_w_{c}") for c in keys], "_won")
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in keys])
    out = some.join(won, match, "left").withColumn(name, F.col("_sure") + F.coalesce("_won", F.lit(0)))
    return out.drop("_low", "_high", "_sure", "_open", "_won", *[f"_w_{c}" for c in keys])


def _numbered(sizes: DataFrame) -> DataFrame:
    """The same rows; the first of equal rows keeps its hash _at, others have one of their number. A row is all that is known of it, so equal
    rows are counted and laid out again, in chunks that are dealt out."""
    keys = ["doc_id", "source", "size", "_at", "h"]
    counts = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    chunks = counts.select(*keys, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(CHUNK).cast("long"))).alias("_from"))
    dealt = chunks.repartition("_at", "_from")
    copies = dealt.select(*keys, F.explode(F.sequence("_from", F.least(F.col("_from") + CHUNK, F.col("_n")) - 1)).alias("_copy"))
    return copies.select("doc_id", "source", "size", F.when(F.col("_copy") == 0, F.col("_at")).otherwise(F.xxhash64("_at", "_copy")).alias("_at"), "h")


def plan(docs: DataFrame, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """One row for each document: size, source_size, target, passes, start and end in its shard, and what chooses the blocks.

    Null texts have no words. Documents without words have size 0 and take nothing. Repeated ids are told apart by their text. Equal rows
    are numbered and go to shards by their number, so that many of them do not make one shard.
    """
    sizes = checkpointed(_numbered(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("_at"), F.xxhash64("text").alias("h"))))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sources).withColumn("_n", F.least(F.greatest(F.ceil(F.col("source_size") / SHARD_WORDS), F.lit(1)), F.lit(SHARDS * SHARDS)))
    goals = checkpointed(goals)
    placed = sizes.join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_shard", F.pmod(F.col("_at"), F.col("_n")))
    shards = placed.groupBy("source", "_shard").agg(F.sum("size").alias("_words")).withColumn("_blocks", F.ceil(F.col("_words") / block))
    per_source = shards.groupBy("source").agg(F.sum("_blocks").alias("_all"))
    per_source = per_source.withColumnRenamed("source", "_s").join(goals, F.col("_s").eqNullSafe(F.col("source"))).drop("_s").withColumn("_seats", F.sum("_all").over(Window.partitionBy()))
    # a seat is worth total / seats words; the source's own blocks can be shorter, so its seats become that many words of them
    quota = apportion(per_source.filter("source_size > 0").withColumn("_worth", F.sum("source_size").over(Window.partitionBy()) / F.col("_seats")), [], "target", "_seats", "_quota", ["source"])
    quota = quota.withColumn("_fit", F.least(F.round(F.col("_quota") * F.col("_worth") * F.col("_all") / F.col("source_size")), 3 * F.col("_all")))
    quota = quota.select(F.col("source").alias("_s"), "_quota", F.floor(F.col("_fit") / F.col("_all")).cast("long").alias("_passes"), (F.col("_fit") % F.col("_all")).cast("long").alias("_over"))
    shards = shards.join(quota, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").filter("_blocks > 0")
    shards = shards.withColumn("_part", F.floor(F.col("_shard") / SHARDS))
    parts = shards.groupBy("source", "_part", "_over").agg(F.sum("_blocks").alias("_all"))
    parts = apportion(parts, ["source"], "_all", "_over", "_own", ["_part"]).select(F.col("source").alias("_s"), F.col("_part").alias("_p"), F.least("_own", "_all").alias("_own"))
    shards = shards.join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p"))).drop("_s", "_p")
    dealt = apportion(shards, ["source", "_part"], "_blocks", "_own", "_some", ["_shard"])
    dealt = dealt.select(F.col("source").alias("_s"), F.col("_shard").alias("_sh"), "_words", "_blocks", "_passes", "_quota", F.least("_some", "_blocks").alias("_some"))
    along = Window.partitionBy("source", "_shard").orderBy("_at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_end", F.sum("size").over(along)).withColumn("_start", F.col("_end") - F.col("size"))
    return placed.join(dealt, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_sh")), "left").drop("_s", "_sh")


def taken_spans(seed: int = 17) -> Column:
    """Of the last, partial pass: the document's [from, to) word spans in chosen blocks, as an array of structs.

    Block b of n ends at word floor((b + 1) * words / n), so that blocks differ by one word at most. Block b is chosen if its
    place in the seeded order, (a * b + c) mod n with a prime a above n, is among the first `_some`.
    """
    key = F.xxhash64(F.lit(seed), "source", "_shard")
    prime = F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (F.pmod(key, F.lit(len(PRIMES))) + 1).cast("int")).cast("long")
    n, words = F.col("_blocks"), F.col("_words")
    first = F.floor((F.col("_start") * n) / words).cast("long")
    last = F.floor(((F.col("_end") - 1) * n) / words).cast("long")
    spans = F.transform(
        F.filter(F.sequence(F.greatest(first - 1, F.lit(0)), F.least(last + 1, n - 1)), lambda b: F.pmod(b * prime + F.pmod(key, n), n) < F.col("_some")),
        lambda b: F.struct(
            (F.greatest(F.expr("_start"), F.floor(b * words / n)) - F.col("_start")).cast("long").alias("a"),
            (F.least(F.expr("_end"), F.floor((b + 1) * words / n)) - F.col("_start")).cast("long").alias("b"),
        ),
    )
    return F.when((F.col("size") > 0) & (F.col("_some") > 0), F.filter(spans, lambda s: s["b"] > s["a"])).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))


def mix_sources(docs: DataFrame, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, passes, spans, source_quota and h (xxhash64 of the text), one row for each row of docs.

    `taken` counts the words that the mix takes from the document: `passes` times all of them, and those in `spans` once more.
    An empty table gives no rows.
    """
    out = plan(docs, seed, block).withColumn("spans", taken_spans(seed))
    extra = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    passes = F.coalesce("_passes", F.lit(0)).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", (passes * F.col("size") + extra).alias("taken"), passes.alias("passes"), "spans", F.col("_quota").alias("source_quota"), "h")
