"""Incremental synchronisation by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_hash(*columns: str):
    """SHA-256 of the columns; text columns are joined by a zero byte."""
    if len(columns) == 1:
        return F.sha2(F.col(columns[0]), 256)
    return F.sha2(F.concat_ws("\0", *columns), 256)


def diff(stored: DataFrame, scanned: DataFrame, key: str = "path") -> DataFrame:
    """key, action (added, updated, removed, skipped) from key and content_hash on both sides; a
    rename is one of each. Only keys and hashes are shuffled."""
    old = stored.select(key, F.col("content_hash").alias("_old"))
    new = scanned.select(key, F.col("content_hash").alias("_new"))
    action = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "updated").otherwise("skipped")
    )
    return old.join(new, key, "full_outer").select(key, action.alias("action"))


def report(changes: DataFrame) -> DataFrame:
    """One row of counts."""
    def of(name):
        return F.count_if(F.col("action") == name).alias(name)
    return changes.agg((F.count(F.lit(1)) - F.count_if(F.col("action") == "removed")).alias("documents"), *map(of, ("added", "updated", "removed", "skipped")))


def apply(stored: DataFrame, scanned: DataFrame, changes: DataFrame, key: str = "path") -> DataFrame:
    """The table after the changes: unchanged rows from ``stored``, new and changed ones from ``scanned``."""
    fresh = changes.filter(F.col("action").isin("added", "updated")).select(key)
    gone = changes.filter(F.col("action") != "skipped").select(key)
    return stored.join(gone, key, "left_anti").select(*stored.columns).unionByName(scanned.join(fresh, key, "left_semi").select(*stored.columns))


def carried(kept: DataFrame, documents: DataFrame, key: str = "id") -> DataFrame:
    """Enrichments or embeddings of documents that still exist; changed ones keep their old hash."""
    return kept.join(documents.select(key), key, "left_semi")
