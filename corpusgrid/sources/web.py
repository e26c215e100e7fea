"""Pages as linked concepts, by built-in expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_concepts(pages: DataFrame) -> DataFrame:
    """id (the url's path without slashes at its ends), title, links, html."""
    path = F.regexp_extract("url", r"^[^:]*://[^/?#]*([^?#]*)", 1)
    target = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return pages.select(
        "page_id", F.regexp_replace(path, "^/+|/+$", "").alias("id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), target.alias("targets"), "html"
    )


def page_links(concepts: DataFrame) -> DataFrame:
    """page_id, id, seq, raw, target, resolved, resolves_in_bundle for each link of each page."""
    rows = concepts.select("page_id", "id", F.posexplode("targets").alias("seq", "target"))
    outside = F.col("target").rlike("^[a-z][a-z0-9+.-]*:") | F.startswith("target", F.lit("#"))
    inside = F.regexp_replace(F.regexp_replace("target", "[#?].*$", ""), "^/+|/+$", "")
    found = rows.withColumn("resolved", F.when(~outside & (inside != ""), inside))
    ids = concepts.select(F.col("id").alias("resolved")).distinct().withColumn("_in", F.lit(True))
    return found.join(ids, "resolved", "left").select(
        "page_id", "id", "seq", F.col("target").alias("raw"), "target", "resolved", F.coalesce("_in", F.lit(False)).alias("resolves_in_bundle")
    )
