"""Mixing sources to target weights (native: DataFrame functions only).

Tokens are summed for each source, each source's repetition rate follows from its target, and each
document is taken ``floor(rate)`` times plus once more if a hash of the seed, its id and its source
falls under the rate's fraction. Each document's draw is its own, so reruns agree.

Sources in code-point order (null last) weigh ``weights`` in turn and share all tokens by weight; no
target may pass ``cap`` times its source's tokens, and what is over is shared again by weight. That
fixed point is a water level: with sources by ``cap * size / weight``, the level is the largest
``(total - caps before) / (weights before taken off)``, and a target is ``min(cap * size, level * weight)``.

The window that ranks sources runs over one row per source, not per document. The rates are written
to the shared checkpoint folder, so texts are counted once for the sums, and broadcast only if there are at most ``BROADCAST_SOURCES`` of them; beyond that Spark joins by
shuffle, where adaptive execution splits a hot source.

Defined results: a null text has size 0 and is never worth words; a null source is a source of its
own; a null id hashes as the empty string; sources without words have target and rate 0; an empty
table gives an empty result; ``mix`` replaces columns named like those it
adds, ``emit`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusgrid.llm.sampling import fresh
from corpusgrid.runtime import cut

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_SOURCES = 10_000
SEED = "mix-1"
ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_rate", "mix_copies")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, source: Column, seed: str = SEED) -> Column:
    """A uniform number in [0, 1) from the first 52 bits of an MD5."""
    empty = F.lit("")
    named = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), empty), F.coalesce(source, empty))
    return F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def rates(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """One row per source: source, source_size, target, rate."""
    sums = docs.groupBy("source").agg(F.sum(words(F.col("text"))).alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double")).withColumn(
        "most", (F.col("source_size") * cap).cast("double")
    )
    whole = W.partitionBy()
    before = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0.0)
    level = (F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("most").over(before), none)) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), none)
    )
    levelled = weighed.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    target = F.least("most", F.col("level") * F.col("weight"))
    return levelled.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = SEED, names: tuple[str, ...] = ADDED) -> DataFrame:
    """``docs`` with its size, its source's size, target and rate, and its copies, under ``names``;
    columns of ``docs`` with these names are replaced."""
    docs = docs.drop(*names)
    size, source_size, target, rate, copies = names
    (source,) = fresh(docs, "source")
    table = rates(docs, weights, cap).select(
        F.col("source").alias(source), F.col("source_size").alias(source_size), F.col("target").alias(target), F.col("rate").alias(rate)
    )
    table = cut(table)  # one row per source: the sums are not made again for the join
    few = table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    sized = docs.withColumn(size, words(F.col("text")))
    joined = sized.join(F.broadcast(table) if few else table, sized["source"].eqNullSafe(table[source])).drop(source)
    whole = F.floor(rate)
    extra = (draw(F.col("doc_id"), F.col("source"), seed) < F.col(rate) - whole).cast("long")
    return joined.withColumn(copies, whole + extra)


def emit(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = SEED) -> DataFrame:
    """Each document of ``docs`` as often as the mix takes it, with its own columns."""
    names = fresh(docs, *ADDED)
    mixed = mix(docs, weights, cap, seed, names)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col(names[-1])))
    return mixed.filter(F.col(names[-1]) > 0).withColumn(names[-1], copies).select(*docs.columns)
