"""BM25 over weighted fields, with phrases and exclusions.

A document's term frequency is the weighted sum over its fields; its length counts the tokens of all
fields; ``idf = ln((N - n + 0.5) / (n + 0.5))`` with a floor. Terms are known on the driver, so each
document's frequencies come from one pass over its token arrays, without exploding any posting. The
same pass observes the statistics of all documents (counts and a sum, which reach the driver as one
row) and writes a few numbers for each document that holds a term; the others are not written.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from corpusgrid.errors import check_top_k
from corpusgrid.functions.text import round4
from corpusgrid.plans.postings import LEXICAL_WEIGHTS, field_tokens
from corpusgrid.plans.query_text import Terms, parse_terms
from corpusgrid.runtime import cut

#: Fixed values of the ranking function.
K1, B, FLOOR = 1.2, 0.75, 1e-6

Analyzer = Callable[[list[str]], list[str]]


def occurrences(tokens: Column, phrase: tuple[str, ...]) -> Column:
    """How often the phrase stands in the tokens."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))
    wanted = F.array(*map(F.lit, phrase))
    last = F.size(tokens) - len(phrase) + 1
    starts = F.when(last > 0, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, lambda i: (F.get(tokens, i - 1) == phrase[0]) & (F.slice(tokens, i, F.lit(len(phrase))) == wanted)))


def _analysed(terms: Terms, analyzer: Analyzer | None) -> Terms:
    if analyzer is None:
        return terms
    return Terms(*[tuple(tuple(analyzer(list(p))) for p in group) for group in (terms.positive, terms.negative)])


def frequencies(concepts: DataFrame, terms: Terms, analyse: Callable[[Column], Column] | None = None) -> DataFrame:
    """id, tokens (the document's length), tf_i and in_i (fields that hold term i) and excluded."""
    columns = {f: field_tokens(concepts, f) for f in LEXICAL_WEIGHTS}
    if analyse is not None:
        columns = {f: analyse(c) for f, c in columns.items()}
    held = concepts.select("id", *[c.alias(f"_{f}") for f, c in columns.items()])
    def weighted(phrase):
        return sum((occurrences(F.col(f"_{f}"), phrase) * w for f, w in LEXICAL_WEIGHTS.items()), F.lit(0.0))
    shown = [weighted(p).alias(f"tf_{i}") for i, p in enumerate(terms.positive)]
    where = [
        F.array(*[F.when(occurrences(F.col(f"_{f}"), p) > 0, F.lit(f)) for f in LEXICAL_WEIGHTS]).alias(f"in_{i}") for i, p in enumerate(terms.positive)
    ]
    excluded = F.lit(False)
    for p in terms.negative:
        excluded = excluded | (weighted(p) > 0)
    length = sum((F.size(f"_{f}") for f in LEXICAL_WEIGHTS), F.lit(0))
    return held.select("id", length.cast("double").alias("tokens"), *shown, *where, excluded.alias("excluded"))


def contributions(counted: DataFrame, terms: Terms, also: Column | None = None) -> DataFrame:
    """The documents of ``counted`` that hold a positive term (and those that are ``also`` wanted) with
    c_i, what each term adds; statistics cover all documents."""
    n = len(terms.positive)
    held = [F.col(f"tf_{i}") > 0 for i in range(n)]
    seen = Observation()
    watched = counted.observe(
        seen, F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), *[F.sum(h.cast("long")).alias(f"df_{i}") for i, h in enumerate(held)]
    )
    wanted = also if also is not None else F.lit(False)
    for h in held:
        wanted = wanted | h
    kept = cut(watched.filter(wanted))
    stats = seen.get
    count, mean = float(stats["n"]), (stats["tokens"] or 0.0) / max(1, stats["n"])
    def part(i):
        df, tf = float(stats[f"df_{i}"] or 0), F.col(f"tf_{i}")
        idf = math.log((count - df + 0.5) / (df + 0.5))
        idf = FLOOR if idf <= 0 else idf
        return F.when(tf > 0, F.lit(idf) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("tokens") / (mean or 1.0)))).otherwise(F.lit(0.0))
    return kept.select(*counted.columns, *[part(i).alias(f"c_{i}") for i in range(n)])


def raw_scores(concepts: DataFrame, query: str, analyse=None, analyzer: Analyzer | None = None, aliases: tuple[str, ...] = ()) -> DataFrame:
    """id and raw score of all documents that hold a positive term (or alias) and no excluded one;
    aliases are keyed names that protected texts hold instead of their words."""
    terms = _analysed(parse_terms(query), analyzer)
    terms = Terms(terms.positive + tuple((a,) for a in aliases), terms.negative)
    if not terms.positive:
        return concepts.select("id", F.lit(0.0).alias("raw_score")).limit(0)
    made = contributions(frequencies(concepts, terms, analyse), terms)
    total = sum((F.col(f"c_{i}") for i in range(len(terms.positive))), F.lit(0.0))
    return made.filter(~F.col("excluded")).select("id", total.alias("raw_score")).filter("raw_score > 0")


def lexical_search(concepts: DataFrame, query: str, top_k: int = 10, **analysis) -> DataFrame:
    """The ``top_k`` best by raw score, then id; scores are relative to the best."""
    top = raw_scores(concepts, query, **analysis).orderBy(F.desc("raw_score"), "id").limit(check_top_k(top_k))
    best = top.agg(F.max("raw_score").alias("_best"))
    return top.crossJoin(F.broadcast(best)).select("id", "raw_score", round4(F.col("raw_score") / F.col("_best")).alias("score"))
