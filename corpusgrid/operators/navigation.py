"""Listing, showing and metadata filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.errors import GridError

#: Fixed value: rows listed where no limit is given.
LISTED = 20
#: Backlinks that stand with a concept.
SHOWN = 1000


def list_concepts(concepts: DataFrame, types=(), tags=(), status: str | None = None, limit: int = LISTED) -> DataFrame:
    """Any of ``types``, all of ``tags``, the ``status``; by id."""
    found = concepts
    if types:
        found = found.filter(F.col("type").isin(*types))
    for tag in tags:
        found = found.filter(F.array_contains("tags", tag))
    if status is not None:
        found = found.filter(F.col("status") == status)
    return found.select("id", "title", "path", "type", "status", "tags").orderBy("id").limit(limit if limit > 0 else LISTED)


def show(concepts: DataFrame, target, policy: str | None = None, edges: DataFrame | None = None) -> DataFrame:
    """One concept. The body of a protected one (column ``policy``) is withheld, and ``privacy_state`` says
    so; links keep raw, target and whether they resolve; with ``edges``, ``backlinks`` lists the concepts
    that point here, once each, by their first edge, ``SHOWN`` of them at most (``graph.backlinks`` is a frame
    of all), and ``backlink_count`` says how many there are."""
    found = concepts.filter(F.col("id") == target)
    if policy and policy in concepts.columns:
        protected = F.coalesce(F.col(policy), F.lit("none")) != "none"
        found = found.withColumn("body", F.when(protected, F.lit(None)).otherwise(F.col("body")))
        found = found.withColumn("privacy_state", F.when(protected, "withheld").otherwise("clear"))
    if "links" in concepts.columns:
        shown = F.transform("links", lambda x: F.struct(x["raw"].alias("raw"), x["target"].alias("target"), x["resolves_in_bundle"].alias("resolves_in_bundle")))
        found = found.withColumn("links", shown)
    if edges is not None:
        first = edges.filter(F.col("to") == target).groupBy("from").agg(F.min("seq").alias("seq"))
        some = first.orderBy("seq", "from").limit(SHOWN)  # of a hub no task gets all
        held = some.agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "from"))), lambda x: x["from"]).alias("backlinks"))
        whole = first.agg(F.count(F.lit(1)).alias("backlink_count"))
        found = found.crossJoin(F.broadcast(held)).crossJoin(F.broadcast(whole))  # one bounded row each
    return found


def normalize_target(target: str, root: str | None = None) -> str:
    """An id from an id, a path in the collection or an absolute path under its root."""
    target = target.strip()
    if root and target.startswith(root.rstrip("/") + "/"):
        target = target[len(root.rstrip("/")) + 1 :]
    if target.lower().endswith(".md"):
        target = target[:-3]
    while target.startswith(("./", "/")):
        target = target[2:] if target.startswith("./") else target[1:]
    return target


def require(concepts: DataFrame, target) -> None:
    if concepts.filter(F.col("id") == target).limit(1).isEmpty():
        raise GridError("CONCEPT_NOT_FOUND", f"no concept {target!r}")


def visible(concepts: DataFrame, ranking: str, policy: str = "policy") -> DataFrame:
    """Concepts that a ranking may index: keyword and in-memory ranking leave out encrypted ones,
    lexical ranking too, fuzzy ranking over stored postings every protected one."""
    if policy not in concepts.columns:
        return concepts
    kept = F.col(policy) == "none" if ranking == "fuzzy" else F.col(policy) != "encrypt"
    return concepts.filter(F.coalesce(kept, F.lit(True)))
