"""Quality findings of a collection, one rule frame each, and their counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgrid.operators import graph

#: Finding codes, their severities and messages.
RULES = {
    "MISSING_FRONTMATTER": ("error", "file has no frontmatter"),
    "MISSING_TYPE": ("error", "concept has no type"),
    "MISSING_KEYWORDS": ("error", "concept has no keywords"),
    "ORPHAN_CONCEPT": ("warning", "concept has no incoming or outgoing edges"),
    "DANGLING_EXTERNAL": ("info", "external or non-bundle link"),
    "BROKEN_LINK": ("error", "link target does not resolve in the bundle"),
    "BROKEN_RELATED": ("error", "related target does not resolve in the bundle"),
    "MISSING_INDEX_TARGET": ("error", "index entry points to an unknown concept"),
    "UNINDEXED_CONCEPT": ("warning", "concept is absent from the root index"),
    "UNSUPPORTED_OKF_VERSION": ("warning", None),
    "EMPTY_BUNDLE": ("warning", None),
    "CODEC_MISSING": ("warning", None),
    "KEY_UNAVAILABLE": ("warning", None),
    "EMBEDDING_STALE": ("warning", None),
    "EMBEDDING_INDEX_MISMATCH": ("warning", None),
}
#: Findings that are warnings in a permissive collection.
LENIENT = ("MISSING_FRONTMATTER", "MISSING_TYPE", "MISSING_KEYWORDS")
COLUMNS = ["code", "severity", "source", "concept", "target", "message"]


def finding(rows: DataFrame, code: str, concept: Column | None = None, source: Column | None = None, target: Column | None = None,
            message: Column | None = None, permissive: bool = False) -> DataFrame:
    severity, said = RULES[code]
    if permissive and code in LENIENT:
        severity = "warning"
    empty = F.lit("")
    def text(c):
        return empty if c is None else F.coalesce(c.cast("string"), empty)
    return rows.select(
        F.lit(code).alias("code"), F.lit(severity).alias("severity"), text(source).alias("source"), text(concept).alias("concept"), text(target).alias("target"),
        (message if message is not None else F.lit(said)).alias("message"),
    )


def validation_findings(validation: DataFrame, permissive: bool = False) -> list[DataFrame]:
    """From id, has_frontmatter, has_type, has_keywords; without frontmatter nothing else is checked."""
    whole = validation.filter("has_frontmatter")
    return [
        finding(validation.filter("NOT has_frontmatter"), "MISSING_FRONTMATTER", F.col("id"), permissive=permissive),
        finding(whole.filter("NOT has_type"), "MISSING_TYPE", F.col("id"), permissive=permissive),
        finding(whole.filter("NOT has_keywords"), "MISSING_KEYWORDS", F.col("id"), permissive=permissive),
    ]


def link_findings(links: DataFrame) -> list[DataFrame]:
    """From id, target, resolved, resolves_in_bundle."""
    return [
        finding(links.filter("resolved IS NULL"), "DANGLING_EXTERNAL", source=F.col("id"), target=F.col("target")),
        finding(links.filter("resolved IS NOT NULL AND NOT resolves_in_bundle"), "BROKEN_LINK", source=F.col("id"), target=F.col("resolved")),
    ]


def index_findings(concepts: DataFrame, index: DataFrame) -> list[DataFrame]:
    """From index entries (target); a collection without an index has no unindexed concept."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace("target", "[#?].*$", "")), "^/", ""), r"\.md$", "")
    entries = index.select("target", plain.alias("id")).filter("id <> ''")
    ids = concepts.select(F.col("id").cast("string").alias("id"))
    some = index.select(F.lit(1).alias("_some")).limit(1)
    return [
        finding(entries.join(ids, "id", "left_anti"), "MISSING_INDEX_TARGET", source=F.lit("index.md"), target=F.col("target")),
        finding(ids.join(entries, "id", "left_anti").crossJoin(F.broadcast(some)), "UNINDEXED_CONCEPT", F.col("id")),
    ]


def orphan_findings(nodes: DataFrame, edges: DataFrame) -> list[DataFrame]:
    return [finding(graph.orphans(nodes, edges), "ORPHAN_CONCEPT", F.col("id"))]


def related_findings(concepts: DataFrame) -> list[DataFrame]:
    return [finding(graph.resolve_related(concepts).filter("target IS NULL"), "BROKEN_RELATED", source=F.col("id"), target=F.col("entry"))]


def version_findings(warnings: DataFrame) -> list[DataFrame]:
    """From collection warnings (warning)."""
    said = F.col("warning")
    return [
        finding(warnings.filter(said.startswith("unsupported okf_version:")), "UNSUPPORTED_OKF_VERSION", source=F.lit("index.md"), message=said),
        finding(warnings.filter(said.startswith("empty bundle:")), "EMPTY_BUNDLE", message=said),
    ]


def codec_findings(concepts: DataFrame, installed) -> list[DataFrame]:
    """From id and body_codec."""
    codec = F.trim("body_codec")
    unknown = concepts.filter(codec.isNotNull() & ~codec.isin("", "none", *installed))
    return [finding(unknown, "CODEC_MISSING", F.col("id"), target=codec, message=F.concat(F.lit("body codec "), codec, F.lit(" is not installed")))]


def key_findings(keys: DataFrame, available) -> list[DataFrame]:
    """From id, path, key_id: keys that cannot be resolved, once for each concept."""
    missing = keys.filter(~F.col("key_id").isin("", *available)).select("id", "path", "key_id").distinct()
    return [finding(missing, "KEY_UNAVAILABLE", F.col("id"), source=F.col("path"), message=F.concat(F.lit("privacy key unavailable: "), F.col("key_id")))]


def stale_embeddings(embedded: DataFrame, concepts: DataFrame) -> list[DataFrame]:
    """Embeddings (id, content_hash) made from another content than the concept has now."""
    now = concepts.select("id", F.col("content_hash").alias("_now"))
    stale = embedded.join(now, "id").filter("content_hash <> _now")
    return [finding(stale, "EMBEDDING_STALE", F.col("id"), message=F.lit("embedding is older than the document"))]


def embedding_counts(source: DataFrame, indexed: DataFrame) -> list[DataFrame]:
    """Spaces (model, dim, rows) whose index has another count, or none."""
    both = source.join(indexed.select("model", "dim", F.col("rows").alias("_indexed")), ["model", "dim"], "left")
    off = both.filter("_indexed IS NULL OR _indexed <> rows")
    name = F.concat_ws("/", "model", F.col("dim").cast("string"))
    return [finding(off, "EMBEDDING_INDEX_MISMATCH", source=name, message=F.lit("embedding index does not match its source"))]


def findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ordered(found: DataFrame) -> DataFrame:
    """By severity, code, concept or source, target, message."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return found.orderBy(rank, "code", F.when(F.col("concept") != "", F.col("concept")).otherwise(F.col("source")), "target", "message")


def summary(found: DataFrame) -> DataFrame:
    """Counts of the findings that the summary names, and of all by severity."""
    def of(code):
        return F.count_if(F.col("code") == code)
    return found.agg(
        of("ORPHAN_CONCEPT").alias("orphans"), of("BROKEN_LINK").alias("broken_links"), of("MISSING_KEYWORDS").alias("missing_keywords"),
        of("MISSING_INDEX_TARGET").alias("missing_index_targets"), of("UNINDEXED_CONCEPT").alias("unindexed_concepts"),
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if(F.col("severity") == "info").alias("infos"),
    )


def failed(found: DataFrame, fail_on: str = "error") -> bool:
    """Whether the findings reach the threshold: error (also for unknown names), warning or none."""
    if fail_on == "none":
        return False
    bad = ("error", "warning") if fail_on == "warning" else ("error",)
    return not found.filter(F.col("severity").isin(*bad)).limit(1).isEmpty()
