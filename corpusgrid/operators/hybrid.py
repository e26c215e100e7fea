"""Fusion and blending of bounded rankings (at most 100 rows a side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgrid.errors import GridError, check_top_k
from corpusgrid.functions.text import round4
from corpusgrid.operators import fuzzy, keyword, lexical

#: Fixed value: either side's share of a total.
HALF = 0.5


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def fuse_keyword_fuzzy(words: DataFrame, near: DataFrame, top_k: int = 10) -> DataFrame:
    """Total, fuzzy and keyword score descending, then id."""
    a = words.select("id", F.col("score").alias("keyword_score"), "matched_keywords")
    b = near.select("id", F.col("score").alias("fuzzy_score"), "matched_fields")
    both = a.join(b, "id", "full_outer").select(
        "id", _zero("keyword_score").alias("keyword_score"), _zero("fuzzy_score").alias("fuzzy_score"),
        round4(HALF * _zero("keyword_score") + HALF * _zero("fuzzy_score")).alias("total_score"),
        F.coalesce("matched_keywords", F.array().cast("array<string>")).alias("matched_keywords"),
        F.coalesce("matched_fields", F.array().cast("array<string>")).alias("matched_fields"),
    )
    return both.orderBy(F.desc("total_score"), F.desc("fuzzy_score"), F.desc("keyword_score"), "id").limit(check_top_k(top_k))


def fuse_lexical_fuzzy(words: DataFrame, near: DataFrame, top_k: int = 10) -> DataFrame:
    """Total, lexical and fuzzy score descending, then id."""
    a = words.select("id", F.col("score").alias("lexical_score"))
    b = near.select("id", F.col("score").alias("fuzzy_score"), "matched_fields")
    both = a.join(b, "id", "full_outer").select(
        "id", _zero("lexical_score").alias("lexical_score"), _zero("fuzzy_score").alias("fuzzy_score"),
        round4(HALF * _zero("lexical_score") + HALF * _zero("fuzzy_score")).alias("total_score"),
        F.coalesce("matched_fields", F.array().cast("array<string>")).alias("matched_fields"),
    )
    return both.orderBy(F.desc("total_score"), F.desc("lexical_score"), F.desc("fuzzy_score"), "id").limit(check_top_k(top_k))


def hybrid_keyword(concepts: DataFrame, query: str, top_k: int = 10) -> DataFrame:
    """Keyword and fuzzy rankings, each cut to ``top_k`` before fusion."""
    return fuse_keyword_fuzzy(keyword.keyword_search(concepts, query, top_k), fuzzy.top(concepts, query, top_k), top_k)


def hybrid_lexical(concepts: DataFrame, query: str, top_k: int = 10, **analysis) -> DataFrame:
    """BM25 and fuzzy rankings, each cut to ``top_k`` before fusion."""
    return fuse_lexical_fuzzy(lexical.lexical_search(concepts, query, top_k, **analysis), fuzzy.top(concepts, query, top_k), top_k)


def blend(hits: DataFrame, given: DataFrame, weight: float = 0.5, top_k: int = 10) -> DataFrame:
    """``hits`` (id, score) blended with ``given`` (id, given_score): ``(1 - weight) * score + weight *
    given``, the given score held to 0..1, missing ones 0; a weight of 0 leaves the order as it was."""
    if not 0 <= weight <= 1:
        raise GridError("INVALID_REQUEST", "weight must be between 0 and 1")
    if weight == 0:
        mixed = hits.withColumn("given_score", F.lit(0.0)).withColumn("final_score", F.col("score"))
    else:
        held = F.least(F.greatest(_zero("given_score"), F.lit(0.0)), F.lit(1.0))
        mixed = hits.join(given.select("id", "given_score"), "id", "left").withColumn("given_score", held).withColumn(
            "final_score", round4((1 - weight) * F.col("score") + weight * F.col("given_score"))
        )
    return mixed.orderBy(F.desc("final_score"), "id").limit(check_top_k(top_k))
