"""Concept frames: the columns that the operators read, and the driver tables in that shape.

A concept has id, path, type, title, description, keywords, tags, status, body; operators use what
they need and let Catalyst prune the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.functions.text import tokens


def from_documents(docs: DataFrame) -> DataFrame:
    """``documents`` as concepts: the first line (60 characters) is the title, the second (120) the
    description, the title's tokens are the keywords, the language is the type, the source a tag."""
    text = F.col("text")
    title = F.substr(F.substring_index(text, "\n", 1), F.lit(1), F.lit(60))
    return docs.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".md")).alias("path"),
        F.col("lang").alias("type"), title.alias("title"),
        F.substr(F.split_part(text, F.lit("\n"), F.lit(2)), F.lit(1), F.lit(120)).alias("description"),
        tokens(title).alias("keywords"), F.array("source").alias("tags"),
        F.when(F.col("n_chars") < 500, "draft").when(F.col("n_chars") < 5000, "stable").alias("status"),
        text.alias("body"),
    )
