"""Score decomposition: what each query token and field adds, for one document or all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusgrid.errors import GridError, check_top_k
from corpusgrid.functions.text import round4
from corpusgrid.operators import fuzzy, hybrid, keyword, lexical
from corpusgrid.plans.postings import FUZZY_WEIGHTS, postings
from corpusgrid.plans.query_text import parse_terms, required_tokens
from corpusgrid.runtime import cut


def explain_keyword(concepts: DataFrame, query: str, target) -> DataFrame:
    """pos, query_token, matched_keyword and score for each query token; a miss scores 0."""
    asked = required_tokens(query)
    tokens = keyword.query_frame(concepts.sparkSession, asked)
    found = keyword.best_matches(concepts.filter(F.col("id") == target), asked)
    return tokens.join(found, "pos", "left").select(
        "pos", F.col("query").alias("query_token"), F.col("keyword").alias("matched_keyword"), F.coalesce("score", F.lit(0.0)).alias("score")
    )


def explain_fuzzy(concepts: DataFrame, query: str, target) -> DataFrame:
    """pos, field, token, similarity and contribution (similarity by weight over tokens and weights)."""
    asked = required_tokens(query)
    best = fuzzy.field_scores(postings(concepts.filter(F.col("id") == target)), asked)
    weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(w)) for f, w in FUZZY_WEIGHTS.items()])
    return best.select("pos", "field", "token", F.col("score").alias("similarity"), (F.col("score") * weight / len(asked) / fuzzy.WEIGHTS).alias("contribution"))


def explain_lexical(concepts: DataFrame, query: str, target) -> DataFrame:
    """pos, query_token, matched, contribution and fields of each positive term, even outside the top."""
    terms = parse_terms(query)
    if not terms.positive:
        raise GridError("EMPTY_QUERY", "the query has no positive term")
    one = F.col("id") == target
    made = lexical.contributions(lexical.frequencies(concepts, terms), terms, one).filter(one)
    rows = F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(" ".join(p)).alias("query_token"), (F.col(f"c_{i}") > 0).alias("matched"), F.col(f"c_{i}").alias("contribution"),
                 F.filter(F.col(f"in_{i}"), lambda f: f.isNotNull()).alias("fields"))
        for i, p in enumerate(terms.positive)
    ])
    return made.select(F.inline(rows))


def explain_hybrid(concepts: DataFrame, query: str, target, top_k: int = 10) -> DataFrame:
    """lexical_score and fuzzy_score of one document (0 outside the top), weights and total."""
    words, near = lexical.lexical_search(concepts, query, top_k), fuzzy.top(concepts, query, top_k)
    one = concepts.filter(F.col("id") == target).select("id")
    a = words.select("id", F.col("score").alias("lexical_score"))
    b = near.select("id", F.col("score").alias("fuzzy_score"))
    both = one.join(a, "id", "left").join(b, "id", "left").fillna(0.0, ["lexical_score", "fuzzy_score"])
    return both.select("id", "lexical_score", "fuzzy_score", F.lit(0.5).alias("lexical_weight"), F.lit(0.5).alias("fuzzy_weight"),
                       round4(0.5 * F.col("lexical_score") + 0.5 * F.col("fuzzy_score")).alias("total_score"))


def explain_lexical_total(concepts: DataFrame, query: str, target, top_k: int = 10) -> DataFrame:
    """One row: raw_score of the document even outside the top, its rank there (0 outside), its score
    against the best, and the fields that hold a term; an excluded document scores 0."""
    terms = parse_terms(query)
    if not terms.positive:
        raise GridError("EMPTY_QUERY", "the query has no positive term")
    one = F.col("id") == target
    made = cut(lexical.contributions(lexical.frequencies(concepts, terms), terms, one))
    total = sum((F.col(f"c_{i}") for i in range(len(terms.positive))), F.lit(0.0))
    scored = made.withColumn("raw_score", F.when(F.col("excluded"), F.lit(0.0)).otherwise(total))
    top = scored.filter("raw_score > 0").orderBy(F.desc("raw_score"), "id").limit(check_top_k(top_k))
    ranked = top.select("id", F.row_number().over(W.orderBy(F.desc("raw_score"), "id")).alias("rank"))  # at most 100 rows
    best = top.agg(F.max("raw_score").alias("best"))
    fields = F.array_sort(F.array_distinct(F.filter(F.concat(*[F.col(f"in_{i}") for i in range(len(terms.positive))]), lambda f: f.isNotNull())))
    return scored.filter(one).join(F.broadcast(ranked), "id", "left").crossJoin(F.broadcast(best)).select(
        "id", "raw_score", F.coalesce("rank", F.lit(0)).alias("rank"), F.coalesce(round4(F.col("raw_score") / F.col("best")), F.lit(0.0)).alias("score"),
        F.when(F.col("excluded"), F.array().cast("array<string>")).otherwise(fields).alias("fields"),
    )


def explain_hybrid_keyword(concepts: DataFrame, query: str, target, top_k: int = 10) -> DataFrame:
    """keyword_score and fuzzy_score of one document (0 outside the top), weights and total."""
    words, near = keyword.keyword_search(concepts, query, top_k), fuzzy.top(concepts, query, top_k)
    one = concepts.filter(F.col("id") == target).select("id")
    both = one.join(words.select("id", F.col("score").alias("keyword_score")), "id", "left").join(near.select("id", F.col("score").alias("fuzzy_score")), "id", "left")
    both = both.fillna(0.0, ["keyword_score", "fuzzy_score"])
    total = round4(0.5 * F.col("keyword_score") + 0.5 * F.col("fuzzy_score"))
    return both.select("id", "keyword_score", "fuzzy_score", F.lit(0.5).alias("keyword_weight"), F.lit(0.5).alias("fuzzy_weight"), total.alias("total_score"))


def explain_blend(hits: DataFrame, given: DataFrame, target, weight: float = 0.5) -> DataFrame:
    """One row: the core score of a document in a bounded ranking, the score given to it, both weights,
    the final score, and its ranks before and after."""
    before = rank_of(hits, hits, F.desc("score"), "id").select("id", F.col("rank").alias("core_rank"))
    blended = hybrid.blend(hits, given, weight, 100)
    after = rank_of(blended, blended, F.desc("final_score"), "id").select("id", F.col("rank").alias("final_rank"))
    row = blended.filter(F.col("id") == target).join(before, "id").join(after, "id")
    return row.select("id", F.col("score").alias("core_score"), "given_score", F.lit(1 - weight).alias("core_weight"), F.lit(weight).alias("given_weight"), "final_score", "core_rank", "final_rank")


def rank_of(hits: DataFrame, ids: DataFrame, *order) -> DataFrame:
    """id and rank of each of ``ids`` in a bounded ranking; 0 where absent."""
    ranked = hits.select("id", F.row_number().over(W.orderBy(*order)).alias("rank"))
    return ids.select("id").join(ranked, "id", "left").select("id", F.coalesce("rank", F.lit(0)).alias("rank"))
