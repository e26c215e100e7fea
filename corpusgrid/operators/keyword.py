"""Keyword search: every query token must equal or begin a token of some keyword."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.errors import check_top_k
from corpusgrid.functions.text import round4
from corpusgrid.plans.postings import keyword_tokens
from corpusgrid.plans.query_text import required_tokens

#: Scores of an equal token and of one that the query token begins.
EXACT, PREFIX = 1.0, 0.75


def query_frame(spark, asked: list[str]) -> DataFrame:
    """pos, query: the query's tokens, a handful of rows."""
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(q).alias("query")) for i, q in enumerate(asked)])
    return spark.range(1).select(F.inline(rows))


def _best(tokens: DataFrame, asked: list[str]) -> DataFrame:
    # a query token is a literal, so the scan filters before anything is shuffled
    hit = F.array(*[
        F.struct(F.lit(i).alias("pos"), F.when(F.col("token") == q, F.lit(EXACT)).when(F.startswith("token", F.lit(q)), F.lit(PREFIX)).alias("score"))
        for i, q in enumerate(asked)
    ])
    found = tokens.select("id", "seq", "keyword", F.explode(F.filter(hit, lambda h: h["score"].isNotNull())).alias("hit"))
    best = F.max_by(F.struct("keyword"), F.struct("hit.score", -F.col("seq")))
    return found.groupBy("id", F.col("hit.pos").alias("pos")).agg(F.max("hit.score").alias("score"), best.alias("b")).select("id", "pos", "score", F.col("b.keyword").alias("keyword"))


def best_matches(concepts: DataFrame, asked: list[str]) -> DataFrame:
    """id, pos, score, keyword: the best keyword of each query token; ties go to the first declared."""
    return _best(keyword_tokens(concepts), asked)


def ranked(tokens: DataFrame, asked: list[str]) -> DataFrame:
    """id, score, matched_keywords of all documents whose keyword tokens match every query token."""
    matched = _best(tokens, asked).groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"), F.array_sort(F.collect_set("keyword")).alias("matched_keywords")
    )
    return matched.filter(F.col("n") == len(asked)).select("id", round4(F.col("total") / len(asked)).alias("score"), "matched_keywords")


def scores(concepts: DataFrame, query: str) -> DataFrame:
    """``ranked`` over the keywords of ``concepts``."""
    return ranked(keyword_tokens(concepts), required_tokens(query))


def keyword_search(concepts: DataFrame, query: str, top_k: int = 10) -> DataFrame:
    """The ``top_k`` best: score descending, then id."""
    return scores(concepts, query).orderBy(F.desc("score"), "id").limit(check_top_k(top_k))
