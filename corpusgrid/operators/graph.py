"""The graph of concepts: edges, degrees, neighbours, bounded neighbourhoods and shortest paths.

Edges have ``from``, ``to``, ``source`` (the kind), ``raw`` and ``seq``. Traversals run one frontier at
a time, each written to the shared checkpoint folder, so lineage does not grow with depth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.errors import GridError
from corpusgrid.runtime import cut

#: The kinds that a traversal follows where none are named.
DEFAULT_RELATIONS = ("link", "related", "imports", "declares", "inherits", "implements", "contains", "depends_on", "parent_of")
DEEPEST = 5


def first_edges(candidates: DataFrame) -> DataFrame:
    """One edge for each (from, to, source), the first by ``seq`` (then by its other columns)."""
    keys = ("from", "to", "source")
    rest = ["seq", *(c for c in candidates.columns if c not in (*keys, "seq"))]
    first = candidates.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col("_first")[c].alias(c) for c in candidates.columns])


def _link_rows(concepts: DataFrame) -> DataFrame:
    return concepts.select("id", F.posexplode("links").alias("seq", "link")).select("id", "seq", "link.*")


def related_rows(concepts: DataFrame) -> DataFrame:
    """id, seq, entry and its candidates: beside the concept first (for a bare name), then as written."""
    rows = concepts.select("id", F.posexplode("related").alias("seq", "entry")).filter("entry <> ''")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("entry", r"\.md$", ""), "^/+", ""), r"^\./", "")
    folder = F.regexp_extract("id", "^(.*)/[^/]*$", 1)
    beside = F.when(~F.contains(plain, F.lit("/")) & F.contains(F.col("id"), F.lit("/")), F.concat(folder, F.lit("/"), plain))
    return rows.select("id", "seq", "entry", F.filter(F.array(beside, plain), lambda c: c.isNotNull()).alias("candidates"))


def resolve_related(concepts: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """related_rows with ``target``: the first candidate that is a concept (one of ``ids``, if given), or null."""
    rows = related_rows(concepts)
    known = (concepts if ids is None else ids).select(F.col("id").alias("candidate"))
    found = rows.select("id", "seq", F.posexplode("candidates").alias("rank", "candidate")).join(known, "candidate")
    best = found.groupBy("id", "seq").agg(F.min(F.struct("rank", "candidate")).alias("best")).select("id", "seq", F.col("best.candidate").alias("target"))
    return rows.join(best, ["id", "seq"], "left")


def references(concepts: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """target, id: every id that a concept's links, entries or relations may lead to, whether it exists or not."""
    links = _link_rows(concepts).filter("resolved IS NOT NULL").select(F.regexp_replace("resolved", r"\.md$", "").alias("target"), "id")
    if "related" in concepts.columns:
        links = links.unionByName(related_rows(concepts).select(F.explode("candidates").alias("target"), "id"))
    if relations is not None:
        links = links.unionByName(relations.select(F.col("to").alias("target"), "id"))
    return links.distinct()


def build_edges(concepts: DataFrame, relations: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Edges from links, ``related`` entries and given relations (id, to, kind, raw, seq); they lead to
    ``concepts``, or to any of ``ids`` (id) where the edges of some concepts only are asked for."""
    whole = concepts if ids is None else ids
    ids = whole.select(F.col("id").alias("to"))
    links = _link_rows(concepts).filter("resolves_in_bundle AND resolved IS NOT NULL").select(
        F.col("id").alias("from"), F.regexp_replace("resolved", r"\.md$", "").alias("to"), F.lit("link").alias("source"), "raw", F.col("seq").cast("long").alias("seq")
    ).join(ids, "to", "left_semi")
    parts = [links]
    if "related" in concepts.columns:
        parts.append(resolve_related(concepts, whole).filter("target IS NOT NULL").select(
            F.col("id").alias("from"), F.col("target").alias("to"), F.lit("related").alias("source"), F.lit(None).cast("string").alias("raw"),
            (F.col("seq") + F.lit(1 << 31)).alias("seq"),
        ))
    if relations is not None:
        known = relations.filter("`to` <> '' AND kind <> ''").select(
            F.col("id").alias("from"), "to", F.col("kind").alias("source"), "raw", (F.col("seq") + F.lit(1 << 40)).alias("seq")
        )
        parts.append(known.join(ids, "to", "left_semi").join(concepts.select(F.col("id").alias("from")), "from", "left_semi"))
    columns = ["from", "to", "source", "raw", "seq"]
    return first_edges(reduce(DataFrame.unionByName, [p.select(*columns) for p in parts]))


def dangling(concepts: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Links and ``related`` entries that are not edges: id, raw, target, resolved."""
    whole = concepts if ids is None else ids
    ids = whole.select(F.col("id").alias("_id"))
    links = _link_rows(concepts)
    aimed = links.withColumn("_id", F.when(F.col("resolves_in_bundle"), F.regexp_replace("resolved", r"\.md$", "")))
    loose = aimed.join(ids, "_id", "left_anti").select("id", "raw", "target", "resolved")
    if "related" not in concepts.columns:
        return loose
    entries = resolve_related(concepts, whole).filter("target IS NULL")
    return loose.unionByName(entries.select("id", F.col("entry").alias("raw"), F.col("entry").alias("target"), F.lit(None).cast("string").alias("resolved")))


def stored_edges(concepts: DataFrame, relations: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """What a store keeps: every edge, and every link or entry that is none, marked ``dangling`` (its
    ``to`` is the path it resolves to, else what is written)."""
    made = build_edges(concepts, relations, ids).select("from", "to", "source", "raw", F.lit(False).alias("dangling"))
    loose = dangling(concepts, ids).select(
        F.col("id").alias("from"), F.coalesce("resolved", "target").alias("to"), F.lit("link").alias("source"), "raw", F.lit(True).alias("dangling")
    )
    return made.unionByName(loose.distinct())


def ordered_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes by id."""
    return nodes.orderBy("id")


def ordered_edges(edges: DataFrame) -> DataFrame:
    """Edges by from, to and kind."""
    return edges.orderBy("from", "to", "source")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, orphans, and edges by kind (a map)."""
    kinds = edges.groupBy("source").count().agg(
        F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("edges"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "count")))).alias("kinds")
    )
    whole = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    alone = orphans(nodes, edges).agg(F.count(F.lit(1)).alias("orphans"))
    return whole.crossJoin(alone).crossJoin(kinds)  # one row each


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (id, ...) with in_degree and out_degree: one shuffle for both ends."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("from").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("to").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    )).alias("e")).select("e.*")
    sums = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.join(sums, "id", "left").fillna(0, ["in_degree", "out_degree"])


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge."""
    ends = edges.select(F.explode(F.array("from", "to")).alias("id"))
    return nodes.select("id").join(ends, "id", "left_anti")


def only(edges: DataFrame, relations=()) -> DataFrame:
    """Edges of the kinds named; all if none are."""
    return edges.filter(F.col("source").isin(*relations)) if relations else edges


def _followed(edges: DataFrame, relations) -> DataFrame:
    return only(edges, relations or DEFAULT_RELATIONS)


def backlinks(edges: DataFrame, nodes: DataFrame, target) -> DataFrame:
    """Concepts with an edge of any kind to ``target``, once each: id, title, source."""
    first = edges.filter(F.col("to") == target).groupBy(F.col("from").alias("id")).agg(F.min(F.struct("seq", "source")).alias("_first"))
    return first.select("id", F.col("_first.source").alias("source")).join(nodes.select("id", "title"), "id")


def neighbors(edges: DataFrame, target, relations=()) -> DataFrame:
    """Ids next to ``target`` in either direction."""
    kept = _followed(edges, relations)
    out = kept.filter(F.col("from") == target).select(F.col("to").alias("id"))
    return out.union(kept.filter(F.col("to") == target).select("from")).distinct()


def _seed(edges: DataFrame, target) -> DataFrame:
    kind = dict(edges.dtypes)["from"]
    return edges.sparkSession.range(1).select(F.lit(target).cast(kind).alias("id"))


def relate(edges: DataFrame, root, direction: str = "both", depth: int = 1, relations=()) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, depth) within ``depth`` of ``root``, and the edges met, each with its first depth."""
    if not 0 <= depth <= DEEPEST:
        raise GridError("INVALID_DEPTH", f"depth must be between 0 and {DEEPEST}")
    if direction not in ("out", "in", "both"):
        raise GridError("INVALID_DIRECTION", "direction must be out, in or both")
    kept = _followed(edges, relations)
    steps = []
    if direction != "in":
        steps.append(kept.select(F.col("from").alias("id"), F.col("to").alias("next"), "from", "to", "source", "raw"))
    if direction != "out":
        steps.append(kept.select(F.col("to").alias("id"), F.col("from").alias("next"), "from", "to", "source", "raw"))
    step = reduce(DataFrame.unionByName, steps)
    nodes = _seed(edges, root).withColumn("depth", F.lit(0))
    frontier, met = nodes, None
    for d in range(1, depth + 1):
        taken = cut(step.join(frontier.select("id"), "id"))
        now = taken.select("from", "to", "source", "raw").withColumn("depth", F.lit(d))
        met = now if met is None else met.unionByName(now)
        frontier = cut(taken.select(F.col("next").alias("id")).distinct().join(nodes, "id", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        nodes = nodes.unionByName(frontier)
    if met is None:
        met = kept.select("from", "to", "source", "raw").withColumn("depth", F.lit(0)).limit(0)
    first = met.groupBy("from", "to", "source").agg(F.min("depth").alias("depth"), F.min_by("raw", "depth").alias("raw"))
    return nodes, first.select("from", "to", "source", "raw", "depth")


def shortest_path(edges: DataFrame, start, end, relations=()) -> list | None:
    """Ids from ``start`` to ``end`` along directed edges, or None. Among shortest paths each node
    keeps its first parent: by the parent's place in the search, then by edge ``seq``."""
    if start == end:
        return [start]
    step = _followed(edges, relations).select(F.col("from").alias("parent"), F.col("to").alias("id"), "seq")
    kind = dict(edges.dtypes)["from"]
    # a node's place is the list of (edge, node) that led to it; lists of one length compare in the
    # order in which a queue would meet them, so no layer has to be ranked in one task
    nowhere = F.array().cast(f"array<struct<seq:bigint,id:{kind}>>")
    frontier = _seed(edges, start).withColumn("place", nowhere)
    seen, layers = frontier.select("id"), []
    while True:  # each layer is new nodes only, so the search ends
        reached = frontier.withColumnRenamed("id", "parent").join(step, "parent")
        best = reached.groupBy("id").agg(F.min(F.struct("place", "seq", "parent")).alias("b")).join(seen, "id", "left_anti")
        place = F.concat("b.place", F.array(F.struct(F.col("b.seq").cast("bigint").alias("seq"), "id")))
        layer = cut(best.select("id", F.col("b.parent").alias("parent"), place.alias("place")))
        if layer.isEmpty():
            return None
        layers.append(layer)
        if not layer.filter(F.col("id") == end).isEmpty():
            break
        frontier = layer.select("id", "place")
        seen = seen.unionByName(layer.select("id"))
    path = [end]
    for layer in reversed(layers):
        path.append(layer.filter(F.col("id") == path[-1]).first()["parent"])
    return path[::-1]
