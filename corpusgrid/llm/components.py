"""Connected components of a link table, distributed.

Alternates the large-star and small-star steps of Kiveris et al. (2014): both only move links
towards smaller nodes, keep what is connected, and end in stars around each component's smallest
node after a number of rounds that grows with the logarithm of the longest chain. Nothing is
collected: the driver only compares a count and a checksum of the links. Each round is written to
the shared checkpoint folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.runtime import cut

#: Rounds before giving up; the logarithm of any chain stays far below.
ROUNDS = 100


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.distinct()


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def stars(links: DataFrame) -> DataFrame:
    """(u, v): each linked node u that is not its component's smallest, and that smallest node v.

    ``links`` has columns a and b of a numeric type; loops and repeats are fine, nulls are not.
    """
    now = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(now)
    for _ in range(ROUNDS):
        if not before[0]:
            return now
        now = cut(_small(_large(now)))
        after = mark(now)
        if after == before:
            return now
        before = after
    raise RuntimeError("components did not settle")
