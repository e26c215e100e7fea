"""Several sources as one: tagged unions, merged rankings, targets by source."""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusgrid.errors import GridError, check_top_k
from corpusgrid.runtime import cut

_ALIAS = re.compile(r"[a-z0-9][a-z0-9._-]*")


def parse_sources(specs: list[str]) -> dict[str, str]:
    """``alias=path`` specifications; aliases and paths are unique."""
    found: dict[str, str] = {}
    for spec in specs:
        alias, given, path = spec.partition("=")
        if not given or not path or not _ALIAS.fullmatch(alias):
            raise GridError("INVALID_REQUEST", f"a source is alias=path, not {spec!r}")
        if alias in found or path in found.values():
            raise GridError("INVALID_REQUEST", f"source {spec!r} is named twice")
        found[alias] = path
    return found


def tagged(frames: dict[str, DataFrame]) -> DataFrame:
    """All rows with their source's alias."""
    return reduce(DataFrame.unionByName, [df.withColumn("source", F.lit(alias)) for alias, df in sorted(frames.items())])


def federated_search(sources: dict[str, DataFrame], search: Callable[[DataFrame], DataFrame], top_k: int = 10) -> DataFrame:
    """Each source's own ranking, merged by score, source and id."""
    hits = tagged({alias: search(df) for alias, df in sources.items()})
    return hits.orderBy(F.desc("score"), "source", "id").limit(check_top_k(top_k))


def federated_by(hits: DataFrame, source: Column, top_k: int = 10) -> DataFrame:
    """``federated_search`` where one table holds all sources: ``hits`` (id, score, ...) are each source's
    own scores from one scan, the top of each source is taken, and these are merged."""
    own = W.partitionBy("source").orderBy(F.desc("score"), "id")
    ranked = hits.withColumn("source", F.coalesce(source, F.lit(""))).withColumn("_rank", F.row_number().over(own))
    return ranked.filter(F.col("_rank") <= check_top_k(top_k)).drop("_rank").orderBy(F.desc("score"), "source", "id").limit(top_k)


def federated_list(sources: dict[str, DataFrame], listed: Callable[[DataFrame], DataFrame], limit: int = 20) -> DataFrame:
    return tagged({alias: listed(df) for alias, df in sources.items()}).orderBy("source", "id").limit(limit)


def isolated(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], run: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame | None, DataFrame]:
    """(rows of all sources that could be read, status of each). Sources are opened and run side by side, each
    written by itself, so one that fails is ``degraded``, with what it said, and the others go on; the rows are None
    if none could be read."""
    def one(alias: str) -> tuple[str, DataFrame | None, str | None]:
        try:
            return alias, cut(run(sources[alias]())), None
        except Exception as error:
            return alias, None, f"{type(error).__name__}: {error}"[:500]

    with ThreadPoolExecutor(max(1, min(8, len(sources)))) as pool:
        done = list(pool.map(one, sorted(sources)))
    status = spark.createDataFrame([(a, "ok" if df is not None else "degraded", said) for a, df, said in done], "source string, status string, message string")
    found = {a: df for a, df, _ in done if df is not None}
    return (tagged(found) if found else None), status


def search_isolated(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], search: Callable[[DataFrame], DataFrame], top_k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(the merged ranking of the sources that could be read, status of each)."""
    hits, status = isolated(spark, sources, search)
    if hits is None:
        raise GridError("SOURCE_UNAVAILABLE", "no source could be read")
    return hits.orderBy(F.desc("score"), "source", "id").limit(check_top_k(top_k)), status


def explain_first(sources: dict[str, DataFrame], search: Callable[[DataFrame], DataFrame], explain: Callable[[DataFrame, object], DataFrame], target: str | None = None) -> DataFrame:
    """The explanation of one document, with its source: of ``alias:id``, or of the first hit of the merged ranking."""
    alias, given, rest = (target or "").partition(":")
    if given and alias in sources:
        return explain(sources[alias], rest).withColumn("source", F.lit(alias))
    first = federated_search(sources, search, 1).first()
    if first is None:
        raise GridError("CONCEPT_NOT_FOUND", "no result for the query")
    return explain(sources[first["source"]], first["id"]).withColumn("source", F.lit(first["source"]))


def degraded(registry: DataFrame, status: DataFrame) -> DataFrame:
    """The registry with the status of each source that ``isolated`` ran; sources that it does not hold are left out."""
    said = status.select(F.col("source").alias("alias"), F.col("status").alias("_now"))
    return registry.join(said, "alias", "left").withColumn("status", F.coalesce("_now", "status")).select(*registry.columns)


def find_target(sources: dict[str, DataFrame], target: str) -> tuple[str, str]:
    """(alias, id) of ``alias:id``, or of an id that exactly one source holds."""
    alias, given, rest = target.partition(":")
    if given and alias in sources:
        return alias, rest
    held = [r[0] for r in tagged({a: df.select("id") for a, df in sources.items()}).filter(F.col("id").cast("string") == target).select("source").distinct().collect()]
    if not held:
        raise GridError("CONCEPT_NOT_FOUND", f"no source holds {target!r}")
    if len(held) > 1:
        raise GridError("AMBIGUOUS_TARGET", f"{target!r} is in {', '.join(sorted(held))}")
    return held[0], target


def merged_report(reports: dict[str, DataFrame]) -> DataFrame:
    """Per-source rows and their sums (source ``*``)."""
    rows = tagged(reports)
    counts = [c for c, kind in rows.dtypes if kind in ("int", "bigint") and c != "source"]
    return rows.unionByName(rows.agg(*[F.sum(c).alias(c) for c in counts]).withColumn("source", F.lit("*")).select(*rows.columns))


#: Columns of a source registry.
REGISTRY = "alias string, path string, status string, generation bigint, last_synced bigint, content_hash string"


def upsert_sources(registry: DataFrame, news: DataFrame) -> DataFrame:
    """The registry with ``news`` in place of rows of the same alias, one generation on."""
    was = registry.select("alias", F.col("generation").alias("_was"))
    fresh = news.join(was, "alias", "left").withColumn("generation", F.coalesce(F.col("_was") + 1, F.lit(1).cast("bigint"))).select(*registry.columns)
    return registry.join(news.select("alias"), "alias", "left_anti").select(*registry.columns).unionByName(fresh)


def prune_sources(registry: DataFrame, keep: list[str]) -> DataFrame:
    return registry.filter(F.col("alias").isin(*keep)) if keep else registry.limit(0)
