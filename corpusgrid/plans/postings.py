"""Inverted frames: postings, vocabulary and document statistics.

They derive from concepts by built-in expressions and can be written as Parquet, partitioned by
field, so that a query reads one field's tokens only. Postings are keyed by document id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.functions.text import strip_markdown, tokens

#: Weights of the fields in fuzzy and lexical ranking.
FUZZY_WEIGHTS = {"title": 1.0, "description": 0.6, "body": 0.3}
LEXICAL_WEIGHTS = {"title": 10.0, "keywords": 8.0, "description": 4.0, "body": 1.0}


def field_tokens(concepts: DataFrame, field: str):
    """A field's tokens in order; keyword lists are joined by spaces, bodies are read without Markdown's marks."""
    if field == "body":
        return tokens(strip_markdown(F.col(field)))
    if dict(concepts.dtypes)[field].startswith("array"):
        return tokens(F.array_join(F.col(field), " "))
    return tokens(F.col(field))


def postings(concepts: DataFrame, fields: tuple[str, ...] = tuple(FUZZY_WEIGHTS)) -> DataFrame:
    """field, token, id: each token of each field once per document, from one scan."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), field_tokens(concepts, f).alias("tokens")) for f in fields])
    return concepts.select("id", F.inline(each)).select("field", F.explode(F.array_distinct("tokens")).alias("token"), "id")


def vocabulary(posted: DataFrame) -> DataFrame:
    """field, token, documents."""
    return posted.groupBy("field", "token").agg(F.count(F.lit(1)).alias("documents"))


def keyword_tokens(concepts: DataFrame) -> DataFrame:
    """id, seq, keyword, token: tokens of each keyword in declared order."""
    each = concepts.select("id", F.posexplode("keywords").alias("seq", "keyword"))
    return each.select("id", "seq", "keyword", F.explode(F.array_distinct(tokens(F.col("keyword")))).alias("token"))
