"""Rerankers and scorers over a bounded ranking, in requests of bounded size.

The candidates of a search (``candidate_k`` at most) are packed into requests of at most ``REQUEST`` bytes, each a
call of its own in a task of its own. A reply must score every candidate of its request once, with finite
scores, held to 0..1. If any call fails, the ranking stays as the core search gave it, and ``warning`` says why.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusgrid.errors import GridError, check_top_k
from corpusgrid.functions.text import round4
from corpusgrid.operators.enrich import registered
from corpusgrid.runtime import cut, ship

#: Bytes of a request; candidates where none are named, and at most; a scorer's weight.
REQUEST, CANDIDATES, MOST, WEIGHT = 8 << 20, 100, 100, 0.25


def candidate_count(top_k: int, candidate_k: int | None = None) -> int:
    """How many core hits to score: those asked for, else the usual number, at least ``top_k``."""
    if candidate_k is None:
        return max(check_top_k(top_k), CANDIDATES)
    if not top_k <= candidate_k <= MOST:
        raise GridError("INVALID_REQUEST", f"candidate_k must be between top_k and {MOST}")
    return candidate_k


def packed(candidates: DataFrame, most: int = REQUEST) -> DataFrame:
    """``candidates`` (id, rank, ...; MOST rows at most) with ``payload``, their JSON, and ``request``: in the order of
    their ranks they go into a request as long as it holds no more than ``most`` bytes. One that is larger
    alone is refused (request -1)."""
    shown = candidates.select("id", "rank", F.to_json(F.struct(*candidates.columns)).alias("payload"), F.lit(0).alias("_all")).limit(MOST)
    kind = dict(candidates.dtypes)["id"]

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        numbers, number, size = [], 0, 0
        for payload in frame["payload"]:
            own = len(payload.encode())
            if own > most:
                numbers.append(-1)
                continue
            if size + own > most:
                number, size = number + 1, 0
            size += own
            numbers.append(number)
        return frame.assign(request=numbers)[["id", "rank", "payload", "request"]]

    return shown.groupBy("_all").applyInPandas(pack, f"id {kind}, rank int, payload string, request int")  # a bounded ranking


def replies(requests: DataFrame, name: str, query: str, kind: str = "scorer") -> DataFrame:
    """id, given_score, warning: a call for each request, with its candidates as dictionaries."""
    call = registered(kind, name)
    ship(requests.sparkSession)
    of = dict(requests.dtypes)["id"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        ids, warning, scores = list(frame["id"]), None, {}
        try:
            if frame["request"].iloc[0] < 0:
                raise ValueError("a candidate exceeds a request's size")
            scores = call(query, [json.loads(p) for p in frame["payload"]])
            if len(scores) != len(ids) or set(scores) != set(ids):
                raise ValueError("a reply must score each candidate once")
            if not all(math.isfinite(s) for s in scores.values()):
                raise ValueError("a score is not finite")
        except Exception as error:
            warning = f"{kind} {name}: {type(error).__name__}: {error}"[:500]
        given = [None if warning else min(1.0, max(0.0, float(scores[i]))) for i in ids]
        return pd.DataFrame({"id": ids, "given_score": given, "warning": warning})

    return requests.repartition("request").groupBy("request").applyInPandas(run, f"id {of}, given_score double, warning string")


def rescored(hits: DataFrame, replied: DataFrame, weight: float, top_k: int) -> DataFrame:
    """``hits`` (id, score, rank) in the order of ``(1 - weight) * score + weight * given``; in that of their ranks where a
    reply has a warning."""
    said = replied.agg(F.min("warning").alias("warning"))  # one row
    both = hits.join(F.broadcast(replied.select("id", "given_score")), "id", "left").crossJoin(F.broadcast(said))
    blend = round4((1 - weight) * F.col("score") + weight * F.coalesce("given_score", F.lit(0.0)))
    final = both.withColumn("final_score", F.when(F.col("warning").isNull(), blend).otherwise(F.col("score")))
    place = F.when(F.col("warning").isNull(), F.lit(0)).otherwise(F.col("rank"))
    return final.orderBy(place, F.desc("final_score"), "id").limit(check_top_k(top_k))


def rerank(hits: DataFrame, concepts: DataFrame, query: str, top_k: int = 10, scorer: str | None = None, reranker: str | None = None,
           weight: float = WEIGHT, most: int = REQUEST) -> DataFrame:
    """``hits`` (id, score; a core ranking of ``candidate_count`` rows) scored by an extension: id, score, rank (its
    core rank), given_score, final_score and warning of the ``top_k`` best. A weight of 0 leaves the order."""
    if scorer and reranker:
        raise GridError("INVALID_REQUEST", "a search has a scorer or a reranker, not both")
    if not (scorer or reranker):
        raise GridError("INVALID_REQUEST", "name a scorer or a reranker")
    if not 0 <= weight <= 1:
        raise GridError("INVALID_REQUEST", "weight must be between 0 and 1")
    kind, name = ("scorer", scorer) if scorer else ("reranker", reranker)
    registered(kind, name)
    ranked = cut(hits.limit(MOST).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id"))))  # a bounded ranking
    if weight == 0:
        return ranked.select("*", F.lit(None).cast("double").alias("given_score"), F.col("score").alias("final_score"), F.lit(None).cast("string").alias("warning")).orderBy("rank").limit(check_top_k(top_k))
    shown = ranked.select("id", "rank", "score")
    if kind == "scorer":  # a scorer sees what the documents say of themselves
        seen = [c for c in ("title", "path", "type", "description", "status") if c in concepts.columns]
        shown = concepts.select("id", *seen, F.slice("keywords", 1, 64).alias("keywords")).join(F.broadcast(shown), "id")
    replied = cut(replies(packed(shown, most), name, query, kind))
    return rescored(ranked, replied, weight, top_k).select(*ranked.columns, "given_score", "final_score", "warning")
