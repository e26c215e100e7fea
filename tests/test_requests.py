"""Scorers in bounded requests, project analyzers, isolated sources, exact percentiles."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusgrid.engine import Engine
from corpusgrid.errors import GridError
from corpusgrid.operators import enrich, federation, keyword, metrics, rerank
from corpusgrid.sources import projects

CONCEPT = "id string, path string, title string, description string, keywords array<string>, type string, status string, body string"


@pytest.fixture(scope="module")
def concepts(spark):
    return spark.createDataFrame([(f"n{i}", f"n{i}.md", f"Note {i}", None, [f"note{i % 3}"], "Doc", None, f"graph text {i} " * (i + 1)) for i in range(12)], CONCEPT)


def hits(spark, n=12):
    return spark.createDataFrame([(f"n{i}", round(1 - i / 20, 4)) for i in range(n)], "id string, score double")


def test_requests_hold_every_candidate_once_within_the_bound(spark):
    rows = [(f"n{i}", i + 1, "x" * (50 * (i % 7))) for i in range(60)] + [("huge", 61, "y" * 5000)]
    found = rerank.packed(spark.createDataFrame(rows, "id string, rank int, text string"), 900).collect()
    assert sorted(r.id for r in found) == sorted(r[0] for r in rows)
    sizes = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        sizes.setdefault(r.request, []).append(len(r.payload.encode()))
    assert sizes.pop(-1) and all(sum(s) <= 900 for s in sizes.values()) and len(sizes) > 5
    numbers = [r.request for r in sorted(found, key=lambda r: r["rank"]) if r.request >= 0]
    assert numbers == sorted(numbers)  # in the order of the ranks


def test_a_scorer_reorders_and_a_failure_keeps_the_core_order(spark, concepts):
    enrich.register("scorer", "last", lambda query, shown: {c["id"]: (1.5 if c["id"] == "n9" else c["rank"] / 100) for c in shown})
    found = rerank.rerank(hits(spark), concepts, "graph", 5, scorer="last", weight=0.5, most=400).collect()
    assert found[0].id == "n9" and found[0].given_score == 1.0 and found[0].final_score == round(0.5 * 0.55 + 0.5, 4) and found[0]["rank"] == 10
    assert len(found) == 5 and all(r.warning is None for r in found)
    core = [f"n{i}" for i in range(5)]
    for name, call in {
        "raises": lambda query, shown: 1 / 0, "misses": lambda query, shown: {c["id"]: 1.0 for c in shown[:-1]}, "adds": lambda query, shown: {**{c["id"]: 1.0 for c in shown}, "zz": 1.0},
        "nan": lambda query, shown: {c["id"]: math.nan for c in shown},
    }.items():
        enrich.register("scorer", name, call)
        found = rerank.rerank(hits(spark), concepts, "graph", 5, scorer=name).collect()
        assert [r.id for r in found] == core and all(name in r.warning for r in found)
    enrich.register("reranker", "some", lambda query, shown: {c["id"]: 1.0 for c in shown} if any(c["id"] == "n0" for c in shown) else {})
    assert [r.id for r in rerank.rerank(hits(spark), concepts, "graph", 5, reranker="some", most=120).collect()] == core  # one request of several fails
    assert [r.id for r in rerank.rerank(hits(spark), concepts, "graph", 5, scorer="last", weight=0.0).collect()] == core


def test_errors_of_scoring(spark, concepts):
    for bad in (dict(scorer="absent"), dict(scorer="last", reranker="some"), dict(), dict(scorer="last", weight=1.5)):
        with pytest.raises(GridError):
            rerank.rerank(hits(spark), concepts, "q", 5, **bad)
    assert rerank.candidate_count(10) == 100 and rerank.candidate_count(10, 20) == 20
    for top_k, candidate_k in ((10, 5), (10, 1000), (0, None)):
        with pytest.raises(GridError):
            rerank.candidate_count(top_k, candidate_k)


def test_engine_scores_embeds_and_exports(spark, concepts, tmp_path):
    enrich.register("scorer", "flat", lambda query, shown: {c["id"]: 0.5 for c in shown})
    engine = Engine(spark, concepts.withColumn("content_hash", F.sha2("body", 256)).withColumn("frontmatter", F.lit('{"type": "Doc"}')), "r")
    found = engine.rescored("note1", "keyword", 2, scorer="flat", candidate_k=3).collect()
    assert [(r.id, r.final_score) for r in found] == [("n1", 0.875), ("n10", 0.875)]
    enrich.register("embedder", "length", lambda text: [float(len(text)), 1.0])
    made = engine.embedded("length", "m", 2)
    assert [tuple(r) for r in made.spaces().collect()] == [("m", 2, 12, 12, 0)]
    assert made.search("graph", "semantic", 3, embedder="length").count() == 3
    old = Engine(spark, made.concepts.withColumn("content_hash", F.lit("new")), "r", embeddings=made.embeddings)
    assert old.spaces().first().stale_rows == 12 and made.without_space("m", 2).spaces().count() == 0
    with pytest.raises(GridError):
        engine.spaces()
    assert engine.export(str(tmp_path / "out")) == 12 and (tmp_path / "out/n3.md").read_text().startswith("---\n")


def analyzer(files):
    documents = [{"id": f["id"], "type": "Source", "title": f"T {f['path']}", "symbols": [{"id": f"{f['id']}#main", "type": "Symbol", "content_kind": "symbol", "title": "main"}]} for f in files if "skip" not in f["id"]]
    uses = [{"from": f["id"], "to": "lib/shared", "kind": "imports"} for f in files] + [{"from": f["id"], "to": f"lib/only-{f['id']}", "kind": "imports"} for f in files]
    own = [{"from": f["id"], "to": f"{f['id']}#main", "kind": "declares"} for f in files] + [{"from": files[0]["id"], "to": files[0]["id"], "kind": "Not Valid"}]
    outer = [{"id": "lib/shared", "type": "Library", "content_kind": "external"}] + [{"id": f"lib/only-{f['id']}", "type": "Library", "content_kind": "external"} for f in files]
    return {"documents": documents, "relations": uses + own, "external_documents": outer}


def test_projects_are_analyzed_and_upserted(spark):
    projects.register_analyzer("code", analyzer)
    rows = [("p1", "a"), ("p1", "b"), ("p1", "skip1"), ("p2", "c")]
    files = spark.createDataFrame([(p, i, f"{i}.py", "body") for p, i in rows], "project string, id string, path string, body string")
    concepts = spark.createDataFrame([(i, f"{i}.py", None, "kept", ["k"], "File", None, "body") for _, i in rows] + [("note", "note.md", "Note", None, [], "Doc", None, "")], CONCEPT)
    said = projects.analyze(files, "code")
    assert {r.project for r in said.collect()} == {"p1", "p2"}
    made, relations = projects.upsert(concepts, files, said)
    found = {r.id: r for r in made.collect()}
    assert set(found) == {"a", "b", "c", "note", "a#main", "b#main", "c#main", "lib/shared"}  # a skipped file goes; externals of one relation too
    assert (found["a"].title, found["a"].type, found["a"].description, found["a"].keywords, found["a"].path) == ("T a.py", "Source", "kept", ["k"], "a.py")
    assert found["note"].title == "Note" and found["a#main"].path == "a#main"
    assert {(r.id, r.to, r.kind) for r in relations.collect()} == {(i, "lib/shared", "imports") for i in "abc"} | {(i, f"{i}#main", "declares") for i in "abc"}
    again, same = projects.upsert(made, files, said)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, made.collect())) and sorted(map(repr, same.collect())) == sorted(map(repr, relations.collect()))


def test_later_statements_win(spark):
    projects.register_analyzer("twice", lambda files: {"documents": [{"id": files[0]["id"], "title": "first", "description": "d", "symbols": [{"id": "s", "type": "A", "title": "one", "keywords": ["x"]}, {"id": "s", "type": "B", "title": "", "keywords": []}]}]})
    files = spark.createDataFrame([("p", "a", "a.py", "")], "project string, id string, path string, body string")
    made, _ = projects.upsert(spark.createDataFrame([("a", "a.py", "old", None, [], "File", None, "")], CONCEPT), files, projects.analyze(files, "twice"))
    found = {r.id: r for r in made.collect()}
    assert (found["s"].type, found["s"].title, found["s"].keywords) == ("B", "one", ["x"]) and (found["a"].title, found["a"].type) == ("first", "File")
    for name, said in (("unknown", {"documents": [{"id": "zz"}]}), ("doubled", {"documents": [{"id": "a"}, {"id": "a"}]}), ("outside", {"artifacts": [{"path": "../x", "content": 1}]})):
        projects.register_analyzer(name, lambda files, said=said: said)
        with pytest.raises(GridError):
            projects.analyze(files, name)
    with pytest.raises(GridError):
        projects.analyze(files, "absent")


def test_sources_that_fail_do_not_stop_the_others(spark, concepts):
    good = {"b": lambda: concepts.filter("id < 'n2'"), "a": lambda: concepts}
    def lost():
        return spark.read.parquet("/nowhere")
    def search(df):
        return keyword.keyword_search(df, "note1", 3)
    found, status = federation.search_isolated(spark, good | {"c": lost, "d": lambda: concepts.select("id")}, search, 4)
    assert [(r.id, r.source) for r in found.collect()] == [("n1", "a"), ("n10", "a"), ("n4", "a"), ("n1", "b")]
    assert {r.source: r.status for r in status.collect()} == {"a": "ok", "b": "ok", "c": "degraded", "d": "degraded"}
    registry = spark.createDataFrame([("a", "/a", "degraded", 1, 1, "h"), ("c", "/c", "ok", 1, 1, "h"), ("x", "/x", "ok", 1, 1, "h")], federation.REGISTRY)
    assert {r.alias: r.status for r in federation.degraded(registry, status).collect()} == {"a": "ok", "c": "degraded", "x": "ok"}
    with pytest.raises(GridError):
        federation.search_isolated(spark, {"c": lost}, search)


def test_explanations_of_the_merged_first_hit(spark, concepts):
    from corpusgrid.operators import explain

    sources = {"a": concepts.filter("id = 'n2'"), "b": concepts}
    def told(df, target):
        return explain.explain_keyword(df, "note1", target)
    def search(df):
        return keyword.keyword_search(df, "note1", 3)
    assert [(r.source, r.matched_keyword) for r in federation.explain_first(sources, search, told).collect()] == [("b", "note1")]
    assert [(r.source, r.score) for r in federation.explain_first(sources, search, told, "a:n2").collect()] == [("a", 0.0)]
    with pytest.raises(GridError):
        federation.explain_first({"a": sources["a"]}, search, told)


@pytest.mark.parametrize("settled", [10_000, 5])
def test_percentiles_are_exact(spark, monkeypatch, settled):
    monkeypatch.setattr(metrics, "SETTLED", settled)
    monkeypatch.setattr(metrics, "BUCKETS", 16)
    draw = random.Random(2)
    lists = [[draw.gauss(0, 1) for _ in range(501)], [7.5] * 40 + [8.0], [1e-300, 1e300, -1e308, 1e308, 0.0, 5.0, 5.0], [3.0], [draw.choice((1.0, 2.0)) for _ in range(99)] + [1e9]]
    fractions = [0.0, 0.01, 0.5, 0.95, 1.0]
    for values in lists[:2] if settled == 5 else lists:
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (math.nan,)], "x double")
        ordered = sorted(values)
        expected = [ordered[max(1, math.ceil(f * len(ordered) - 1e-9)) - 1] for f in fractions]
        assert [r.value for r in metrics.nearest_ranks(df, "x", fractions).collect()] == expected
    assert [tuple(r) for r in metrics.nearest_ranks(spark.createDataFrame([], "x double"), "x", [0.5]).collect()] == [(0.5, 0, None)]


def test_an_analysis_gives_bodies_to_concepts_that_have_none(spark):
    projects.register_analyzer("bodies", lambda files: {"documents": [{"id": f["id"], "type": "Code", "body": f["body"].upper()} for f in files]})
    files = spark.createDataFrame([("p", "a", "a.x", "text"), ("q", "b", "b.x", "other")], "project string, id string, path string, body string")
    said = projects.analyze(files, "bodies")
    made, _ = projects.upsert(files.select("id", "path"), files, said)
    assert sorted((r.id, r.type, r.body) for r in made.collect()) == [("a", "Code", "TEXT"), ("b", "Code", "OTHER")]
