"""Exact nearest neighbours by cosine, and the life cycle of embedding spaces.

A search scans its space once: the query vector is a literal, so there is no join, and the best rows
come from a top-K without a full sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.errors import GridError, check_top_k
from corpusgrid.functions.text import round4
from corpusgrid.functions.vectors import dot, doubles, normalized

#: Fixed value: bytes of text that an embedder is given.
EMBEDDED = 8192


def knn(embeddings: DataFrame, query: list[float], top_k: int = 10, key: str = "id", column: str = "vector") -> DataFrame:
    """key and score: cosine of normalised vectors, rounded, the best first, then by key."""
    size = sum(x * x for x in query) ** 0.5
    if not size or size != size or size == float("inf"):
        raise GridError("INVALID_REQUEST", "the query vector must be finite and not zero")
    wanted = F.array(*[F.lit(float(x) / size) for x in query])
    fit = embeddings.filter(F.size(column) == len(query)).select(key, normalized(doubles(F.col(column))).alias("_v")).filter("_v IS NOT NULL")
    return fit.select(key, round4(dot(F.col("_v"), wanted)).alias("score")).orderBy(F.desc("score"), key).limit(check_top_k(top_k))


def spaces(embeddings: DataFrame, column: str = "vector", *by: str) -> DataFrame:
    """dim (and ``by``) with rows and valid rows."""
    sized = embeddings.select(*by, F.size(column).alias("dim"), normalized(doubles(F.col(column))).isNotNull().alias("valid"))
    return sized.groupBy(*by, "dim").agg(F.count(F.lit(1)).alias("rows"), F.count_if("valid").alias("valid_rows"))


def embedding_text(concepts: DataFrame) -> DataFrame:
    """id and the text to embed: title, description and body on lines, the first ``EMBEDDED`` bytes
    without a character cut in two."""
    whole = F.concat_ws("\n", "title", "description", "body")
    head = F.substring(F.encode(whole, "UTF-8"), 1, EMBEDDED)
    # at most three bytes of a cut character are left at the end
    tries = [F.substring(head, 1, EMBEDDED - k).cast("string") for k in range(4)]
    cut = F.when(F.octet_length(whole) <= EMBEDDED, whole).otherwise(F.coalesce(*[F.when(F.is_valid_utf8(t), t) for t in tries]))
    return concepts.select("id", cut.alias("text"))


def write_space(embeddings: DataFrame, path: str) -> None:
    """Rows (bundle_root, id, model, dim, vector, content_hash) as Parquet by model and dimension; a
    rebuilt space replaces its own partitions only."""
    embeddings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "dim").parquet(path)


def drop_space(path_rows: DataFrame, model: str, dim: int) -> DataFrame:
    """All rows but one space's."""
    return path_rows.filter(~((F.col("model") == model) & (F.col("dim") == dim)))


def to_embed(concepts: DataFrame, embedded: DataFrame) -> DataFrame:
    """Concepts without an embedding of their present content: new and changed ones."""
    return concepts.join(embedded.select("id", "content_hash"), ["id", "content_hash"], "left_anti")
