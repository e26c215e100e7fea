"""Graph, audit and synchronisation against plain Python."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from corpusgrid.errors import GridError
from corpusgrid.operators import audit, federation, graph, sync

EDGES = "`from` string, `to` string, source string, raw string, seq long"


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    made = {}
    for i in range(120):
        a, b, kind = f"n{draw.randrange(40)}", f"n{draw.randrange(40)}", draw.choice(["link", "related", "calls"])
        made.setdefault((a, b, kind), i)
    return [(a, b, k, f"raw{i}", i) for (a, b, k), i in made.items()]


def first_path(rows, start, end):
    out = {}
    for a, b, k, _, i in sorted(rows, key=lambda r: r[4]):
        if k != "calls":
            out.setdefault(a, []).append(b)
    parents, queue = {start: None}, deque([start])
    while queue:
        now = queue.popleft()
        for n in out.get(now, []):
            if n not in parents:
                parents[n] = now
                queue.append(n)
    if end not in parents:
        return None
    path = [end]
    while parents[path[-1]] is not None:
        path.append(parents[path[-1]])
    return path[::-1]


def test_paths(spark, rows):
    edges = spark.createDataFrame(rows, EDGES)
    for start, end in (("n0", "n7"), ("n3", "n31"), ("n5", "n5"), ("n12", "n2"), ("n0", "nowhere")):
        assert graph.shortest_path(edges, start, end) == (first_path(rows, start, end) if end != "nowhere" else None)


def around(rows, root, direction, depth):
    seen, met, frontier = {root: 0}, {}, [root]
    for d in range(1, depth + 1):
        following = []
        for node in frontier:
            for a, b, k, raw, _ in rows:
                if k == "calls":
                    continue
                for here, there, way in ((a, b, "out"), (b, a, "in")):
                    if here == node and direction in (way, "both"):
                        met.setdefault((a, b, k), d)
                        if there not in seen:
                            seen[there] = d
                            following.append(there)
        frontier = following
    return seen, met


@pytest.mark.parametrize("direction, depth", [("out", 1), ("in", 2), ("both", 2), ("both", 0), ("out", 5)])
def test_relate(spark, rows, direction, depth):
    nodes, met = graph.relate(spark.createDataFrame(rows, EDGES), "n1", direction, depth)
    seen, expected = around(rows, "n1", direction, depth)
    assert {r.id: r.depth for r in nodes.collect()} == seen
    assert {(r["from"], r["to"], r["source"]): r["depth"] for r in met.collect()} == expected


def test_relate_errors(spark, rows):
    edges = spark.createDataFrame(rows, EDGES)
    for bad in ({"depth": 6}, {"direction": "up"}):
        with pytest.raises(GridError):
            graph.relate(edges, "n1", **bad)


def test_degrees_and_neighbours(spark, rows):
    edges = spark.createDataFrame(rows, EDGES)
    nodes = spark.createDataFrame([(f"n{i}", f"t{i}") for i in range(45)], "id string, title string")
    found = {r.id: (r.in_degree, r.out_degree) for r in graph.degrees(nodes, edges).collect()}
    assert found == {f"n{i}": (sum(b == f"n{i}" for _, b, *_ in rows), sum(a == f"n{i}" for a, *_ in rows)) for i in range(45)}
    assert {r.id for r in graph.orphans(nodes, edges).collect()} == {i for i, d in found.items() if d == (0, 0)}
    near = {r.id for r in graph.neighbors(edges, "n1").collect()}
    assert near == {b for a, b, k, *_ in rows if a == "n1" and k != "calls"} | {a for a, b, k, *_ in rows if b == "n1" and k != "calls"}
    assert {r.id for r in graph.backlinks(edges, nodes, "n1").collect()} == {a for a, b, *_ in rows if b == "n1"}
    assert graph.only(edges, ("calls",)).count() == sum(r[2] == "calls" for r in rows) and graph.only(edges).count() == len(rows)


CONCEPTS = "id string, related array<string>, links array<struct<raw:string,target:string,resolved:string,resolves_in_bundle:boolean>>"


def test_build_edges(spark):
    rows = [
        ("a/x", ["y", "/b/z.md", "./w", "gone", ""], [("[1](y.md)", "y.md", "a/y.md", True), ("[2](y.md)", "y.md", "a/y.md", True), ("[e](http://e)", "http://e", None, False)]),
        ("a/y", None, [("[b](nope.md)", "nope.md", "a/nope.md", False)]), ("y", [], []), ("b/z", ["x"], []), ("w", None, []),
    ]
    concepts = spark.createDataFrame(rows, CONCEPTS)
    relations = spark.createDataFrame([("w", "y", "calls", None, 0), ("w", "none", "calls", None, 1), ("w", "y", "", None, 2)], "id string, to string, kind string, raw string, seq long")
    found = {(r["from"], r["to"], r["source"]): r["raw"] for r in graph.build_edges(concepts, relations).collect()}
    assert found == {("a/x", "a/y", "link"): "[1](y.md)", ("a/x", "a/y", "related"): None, ("a/x", "b/z", "related"): None, ("a/x", "w", "related"): None, ("w", "y", "calls"): None}
    assert {(r.id, r.target) for r in graph.dangling(concepts).collect()} == {("a/x", "http://e"), ("a/y", "nope.md"), ("a/x", "gone"), ("b/z", "x")}


def test_audit_rules(spark):
    validation = spark.createDataFrame([("a", False, False, False), ("b", True, False, True), ("c", True, True, False)], "id string, has_frontmatter boolean, has_type boolean, has_keywords boolean")
    concepts = spark.createDataFrame([("a", "zip", "h1"), ("b", None, "h2"), ("c", "zstd", "h3")], "id string, body_codec string, content_hash string")
    index = spark.createDataFrame([("/a.md#x",), ("gone.md",), ("",)], "target string")
    none = index.limit(0)
    said = spark.createDataFrame([("unsupported okf_version: 9",), ("empty bundle: no files",), ("other",)], "warning string")
    keys = spark.createDataFrame([("a", "a.md", "k1"), ("a", "a.md", "k1"), ("b", "b.md", "k2"), ("c", "c.md", "")], "id string, path string, key_id string")
    embedded = spark.createDataFrame([("a", "h1"), ("b", "old"), ("z", "x")], "id string, content_hash string")
    source = spark.createDataFrame([("m", 2, 5), ("m", 3, 1), ("n", 2, 2)], "model string, dim int, rows long")
    indexed = spark.createDataFrame([("m", 2, 5), ("m", 3, 9)], "model string, dim int, rows long")
    parts = (audit.validation_findings(validation) + audit.index_findings(concepts, index) + audit.version_findings(said) + audit.codec_findings(concepts, ["zstd"])
             + audit.key_findings(keys, ["k2"]) + audit.stale_embeddings(embedded, concepts) + audit.embedding_counts(source, indexed))
    found = audit.ordered(audit.findings(parts)).collect()
    assert [(r.code, r.concept or r.source, r.target) for r in found] == [
        ("MISSING_FRONTMATTER", "a", ""), ("MISSING_INDEX_TARGET", "index.md", "gone.md"), ("MISSING_KEYWORDS", "c", ""), ("MISSING_TYPE", "b", ""),
        ("CODEC_MISSING", "a", "zip"), ("EMBEDDING_INDEX_MISMATCH", "m/3", ""), ("EMBEDDING_INDEX_MISMATCH", "n/2", ""), ("EMBEDDING_STALE", "b", ""),
        ("EMPTY_BUNDLE", "", ""), ("KEY_UNAVAILABLE", "a", ""), ("UNINDEXED_CONCEPT", "b", ""), ("UNINDEXED_CONCEPT", "c", ""), ("UNSUPPORTED_OKF_VERSION", "index.md", ""),
    ]
    all_found = audit.findings(parts)
    assert audit.failed(all_found) and not audit.failed(all_found, "none") and audit.failed(all_found.filter("severity = 'warning'"), "warning")
    assert not audit.failed(all_found.filter("severity = 'warning'"), "unknown")
    assert {r.severity for r in audit.findings(audit.validation_findings(validation, True)).collect()} == {"warning"}
    assert audit.findings(audit.index_findings(concepts, none)).count() == 0
    assert audit.summary(all_found).first().unindexed_concepts == 2


def test_sync(spark):
    old = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y"), ("c", "3", "z")], "path string, content_hash string, body string")
    new = spark.createDataFrame([("a", "1", "x"), ("b", "9", "yy"), ("d", "4", "w")], "path string, content_hash string, body string")
    changes = sync.diff(old, new)
    assert dict(tuple(r) for r in changes.collect()) == {"a": "skipped", "b": "updated", "c": "removed", "d": "added"}
    assert sync.report(changes).first().asDict() == {"documents": 3, "added": 1, "updated": 1, "removed": 1, "skipped": 1}
    assert sorted(map(tuple, sync.apply(old, new, changes).collect())) == sorted(map(tuple, new.collect()))


def test_federation(spark):
    one = spark.createDataFrame([("x", 0.5), ("y", 0.9)], "id string, score double")
    two = spark.createDataFrame([("x", 0.5), ("z", 0.1)], "id string, score double")
    found = federation.federated_search({"b": one, "a": two}, lambda d: d, 3).collect()
    assert [(r.source, r.id) for r in found] == [("b", "y"), ("a", "x"), ("b", "x")]
    assert federation.parse_sources(["a=/x", "b=/y=z"]) == {"a": "/x", "b": "/y=z"}
    for bad in (["a"], ["a=/x", "a=/y"], ["a=/x", "b=/x"], ["A B=/x"]):
        with pytest.raises(GridError):
            federation.parse_sources(bad)
    sources = {"a": two, "b": one}
    assert federation.find_target(sources, "y") == ("b", "y") and federation.find_target(sources, "a:x") == ("a", "x")
    for bad in ("x", "nope"):
        with pytest.raises(GridError):
            federation.find_target(sources, bad)
    reports = {"a": spark.range(1).select(F.lit(1).alias("added"), F.lit(2).alias("edges")), "b": spark.range(1).select(F.lit(3).alias("added"), F.lit(4).alias("edges"))}
    total = {r.source: (r.added, r.edges) for r in federation.merged_report(reports).collect()}
    assert total == {"a": (1, 2), "b": (3, 4), "*": (4, 6)}


def test_a_hub_is_shown_with_a_bounded_list(spark):
    from pyspark.sql import functions as F

    from corpusgrid.operators import navigation

    concepts = spark.range(1500).select(F.col("id").cast("string").alias("id"))
    edges = spark.range(1500).select(F.col("id").cast("string").alias("from"), F.lit("0").alias("to"), F.col("id").alias("seq"))
    row = navigation.show(concepts, "0", edges=edges).first()
    assert row.backlink_count == 1500 and row.backlinks == [str(i) for i in range(navigation.SHOWN)]
