"""Fuzzy search: similar tokens by field, weighted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.errors import check_top_k
from corpusgrid.functions.similarity import LEAST, near
from corpusgrid.functions.text import round4, snippet, strip_markdown
from corpusgrid.plans.postings import FUZZY_WEIGHTS, postings, vocabulary
from corpusgrid.plans.query_text import required_tokens

#: The weights' sum, and the contribution above which a field counts as matched.
WEIGHTS, MATCHED = 1.9, 0.05
#: Similar tokens that may be sent with a scan; beyond that vocabulary and postings meet in a join.
NAMED = 5000


def similar_tokens(tokens: DataFrame, asked: list[str]) -> DataFrame:
    """``tokens`` (token, ...) similar to a query token, with pos and score. Query tokens are literals,
    so this is a projection and a filter, not a join."""
    token = F.col("token")
    scored = tokens.withColumns({f"_{i}": near(q, token) for i, q in enumerate(asked)})
    each = F.array(*[F.struct(F.lit(i).alias("pos"), F.col(f"_{i}").alias("score")) for i in range(len(asked))])
    some = F.greatest(*[F.col(f"_{i}") for i in range(len(asked))], F.lit(0.0))
    return scored.filter(some >= LEAST).select(*tokens.columns, F.inline(each)).filter(F.col("score") >= LEAST)


def field_scores(posted: DataFrame, asked: list[str], known: DataFrame | None = None) -> DataFrame:
    """id, field, pos, score, token: the most similar token (the smallest on ties).

    Postings made on the fly are scored where they are made: one scan, and only matches are shuffled.
    Stored ones are reached through their stored vocabulary ``known`` (field, token), which is far smaller;
    its similar tokens are counted, and named in the scan's filter and broadcast up to ``NAMED`` of them.
    """
    if known is not None:
        similar = similar_tokens(known.select("field", "token"), asked)
        rows = similar.limit(NAMED + 1).collect()
        if len(rows) <= NAMED:
            similar = F.broadcast(posted.sparkSession.createDataFrame(rows, similar.schema))
            posted = posted.filter(F.col("token").isin(sorted({r["token"] for r in rows})))
        found = posted.join(similar, ["field", "token"])
    else:
        found = similar_tokens(posted, asked)
    return best_tokens(found)


def best_tokens(found: DataFrame) -> DataFrame:
    """id, field, pos, score, token: of similar tokens (id, field, pos, score, token) the best of each field."""
    best = F.min(F.struct((-F.col("score")).alias("behind"), "token"))
    return found.groupBy("id", "field", "pos").agg(best.alias("best")).select("id", "field", "pos", (-F.col("best.behind")).alias("score"), "best.token")


def scores(posted: DataFrame, query: str, known: DataFrame | None = None) -> DataFrame:
    """id, score, matched_fields and the body's matched tokens of all documents."""
    asked = required_tokens(query)
    return ranked(field_scores(posted, asked, known), len(asked))


def ranked(best: DataFrame, asked: int) -> DataFrame:
    """``scores`` from the best tokens; ``asked`` is the number of query tokens."""
    means = best.groupBy("id").agg(
        *[F.coalesce(F.sum(F.when(F.col("field") == f, F.col("score"))), F.lit(0.0)).alias(f"_{f}") for f in FUZZY_WEIGHTS],
        F.array_sort(F.collect_set(F.when(F.col("field") == "body", F.col("token")))).alias("terms"),
    )
    parts = {f: F.col(f"_{f}") / asked * w for f, w in FUZZY_WEIGHTS.items()}
    total = (parts["title"] + parts["description"] + parts["body"]) / WEIGHTS
    named = F.array_sort(F.filter(F.array(*[F.when(p / WEIGHTS > MATCHED, F.lit(f)) for f, p in parts.items()]), lambda f: f.isNotNull()))
    return means.select("id", round4(total).alias("score"), named.alias("matched_fields"), "terms").filter("score > 0")


def top(concepts: DataFrame, query: str, top_k: int = 10, posted: DataFrame | None = None) -> DataFrame:
    """id, score, matched_fields, terms of the ``top_k`` best: score descending, then id."""
    found = scores(posted, query, vocabulary(posted)) if posted is not None else scores(postings(concepts), query)
    return found.orderBy(F.desc("score"), "id").limit(check_top_k(top_k))


def with_snippets(hits: DataFrame, concepts: DataFrame) -> DataFrame:
    """A bounded ranking (at most 100 rows with ``id`` and ``terms``) with title and snippet.

    The hits are fetched first, so their ids filter the scan that reads the bodies.
    """
    rows = hits.limit(100).collect()
    if not rows:
        return hits.drop("terms").withColumns({"title": F.lit(None).cast("string"), "snippet": F.lit(None).cast("string")})
    known = hits.sparkSession.createDataFrame(rows, hits.schema)
    bodies = concepts.filter(F.col("id").isin(*[r["id"] for r in rows])).select("id", "title", "body")
    shown = F.when(F.size("terms") > 0, snippet(strip_markdown(F.col("body")), F.col("terms")))
    return bodies.join(F.broadcast(known), "id").withColumn("snippet", shown).drop("body", "terms")


def fuzzy_search(concepts: DataFrame, query: str, top_k: int = 10, posted: DataFrame | None = None) -> DataFrame:
    """id, title, score, matched_fields and snippet of the ``top_k`` best."""
    found = with_snippets(top(concepts, query, top_k, posted), concepts)
    return found.select("id", "title", "score", "matched_fields", "snippet").orderBy(F.desc("score"), "id").limit(top_k)
