"""Files: Markdown, collections, assets, privacy, extensions, export, streams, and the engine object."""

import hashlib
import hmac
import json
import time

import pytest
from pyspark.sql import functions as F

from corpusgrid import envelope
from corpusgrid.engine import Engine
from corpusgrid.errors import GridError
from corpusgrid.operators import audit, enrich, export, federation, lexical, privacy
from corpusgrid.plans import stored
from corpusgrid.sources import assets, bundle, markdown, providers
from corpusgrid.streaming import watch

GOOD = """---
type: Concept
title: Alpha
description: First one
keywords: [graph, engine]
tags: core
status: stable
related: [beta, /deep/gamma.md, gone]
when: 2024-01-02
nested: {a: [1, {b: true}]}
---
See [Beta](beta.md#part), [ext](https://x.y), [self](#here), ![img](pic.png), `[no](code.md)` and [root](/deep/gamma.md?x).

```md
[fenced](fenced.md)
```
[full][Ref], [ref][], [ref] and [<odd>](<deep/gamma.md> "t") and [bad](two words.md).

[REF]: nope.md "Title"
"""


def test_links():
    links = markdown.extract_links(markdown.split_frontmatter(GOOD)[1])
    assert links == [
        ("[Beta](beta.md#part)", "beta.md#part"), ("[ext](https://x.y)", "https://x.y"), ("[self](#here)", "#here"), ("[root](/deep/gamma.md?x)", "/deep/gamma.md?x"),
        ("[full][Ref]", "nope.md"), ("[ref][]", "nope.md"), ("[ref]", "nope.md"), ("[<odd>](<deep/gamma.md> \"t\")", "deep/gamma.md"),
    ]


@pytest.mark.parametrize("target, folder, expected", [
    ("beta.md#x", "a", "a/beta.md"), ("../b.md", "a/c", "a/b.md"), ("/x/./y.md?q", "a", "x/y.md"), ("https://x", ".", None), ("mailto:x", ".", None), ("#a", ".", None), ("?q", ".", None), ("./", ".", ""), ("../../z", "a", "../z")])
def test_resolution(target, folder, expected):
    assert markdown.resolve_link(target, folder) == expected


def test_frontmatter_and_fields():
    assert markdown.split_frontmatter("no") == (None, "no") and markdown.split_frontmatter("---\na: 1\n")[0] is None
    assert markdown.split_frontmatter("---\n---\nbody") == ({}, "body")
    row = markdown.parse_concept("dir/Alpha.MD", GOOD.encode())
    assert (row["id"], row["type"], row["keywords"], row["tags"], row["status"], row["related"]) == ("dir/Alpha", "Concept", ["graph", "engine"], ["core"], "stable", ["beta", "/deep/gamma.md", "gone"])
    assert json.loads(row["frontmatter"])["nested"] == {"a": [1, {"b": True}]} and row["warnings"] == []
    loose = markdown.parse_concept("x.md", b"---\ntype: 7\nkeywords: [a, 3]\nstatus: other\ntags: [1, true]\ntitle: 5\n---\n")
    assert (loose["type"], loose["keywords"], loose["status"], loose["tags"], loose["title"]) == ("", None, None, ["1", "true"], "5")
    assert loose["warnings"][:2] == ["missing type", "missing keywords"]
    assert markdown.parse_concept("x.md", b"\xff")["warnings"] == ["parse error: invalid UTF-8"]
    assert markdown.parse_concept("x.md", b"plain")["warnings"] == ["missing frontmatter"]
    assert markdown.parse_concept("x.md", b"---\na: [\n---\n")["warnings"][0].startswith("parse error")
    free = markdown.parse_concept("d/some.file.md", "intro line\ngoes on\n\n```\ncode\n```\n# Head ing \nrest".encode(), True)
    assert (free["type"], free["title"], free["description"], free["has_frontmatter"], free["warnings"]) == ("Document", "Head ing", "intro line goes on", False, ["missing frontmatter"])
    assert markdown.parse_concept("d/some.file.md", b"", True)["title"] == "some.file"


def test_index_lines():
    entries, version, error = markdown.parse_index(b"---\nokf_version: 1.0\n---\n- [A](/a.md) - about a\n* [B](b.md)\ntext\n")
    assert [(e["title"], e["target"], e["description"]) for e in entries] == [("A", "a.md", "about a"), ("B", "b.md", None)] and (version, error) == ("1.0", None)
    assert [e["target"] for e in markdown.parse_index(b"see [A](/a.md) and [B](b.md)")[0]] == ["a.md", "b.md"]
    assert markdown.parse_index(b"\xff")[2].startswith("parse error")


@pytest.fixture()
def folder(tmp_path):
    files = {
        "alpha.md": GOOD, "beta.md": "---\ntype: Concept\nkeywords: [beta]\n---\n[back](alpha.md) [[x\n", "deep/gamma.md": "---\ntype: Other\n---\nbody *graph*\n",
        "loose.md": "no front", "index.md": "---\nokf_version: '9'\n---\n- [A](alpha.md)\n- [Z](zzz.md)\n", "deep/index.md": "skip", "deep/log.md": "skip", ".git/x.md": "skip",
        "node_modules/y.md": "skip", "pic.png": "x", "data.json": "{}",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "real.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\0" * 20)
    (tmp_path / "wrong.jpg").write_bytes(b"GIF89a" + b"\0" * 20)
    return tmp_path


def test_engine(spark, folder, tmp_path_factory):
    engine = Engine.parse(spark, str(folder))
    assert {r.id: r.warnings for r in engine.validation.collect()}["loose"] == ["missing frontmatter"]
    assert {r.id for r in engine.concepts.collect()} == {"alpha", "beta", "deep/gamma"}
    found = {(r["from"], r["to"], r["source"]) for r in engine.edges.collect()}
    assert found == {("alpha", "beta", "link"), ("alpha", "deep/gamma", "link"), ("alpha", "beta", "related"), ("alpha", "deep/gamma", "related"), ("beta", "alpha", "link")}
    assert {(r.id, r.in_degree, r.out_degree) for r in engine.nodes.collect()} == {("alpha", 1, 4), ("beta", 2, 1), ("deep/gamma", 2, 0)}
    codes = [(r.code, r.concept or r.source, r.target) for r in engine.audit().collect()]
    assert ("BROKEN_LINK", "alpha", "nope.md") in codes and ("BROKEN_RELATED", "alpha", "gone") in codes and ("MISSING_INDEX_TARGET", "index.md", "zzz.md") in codes
    assert ("UNINDEXED_CONCEPT", "beta", "") in codes and ("MISSING_FRONTMATTER", "loose", "") in codes and ("UNSUPPORTED_OKF_VERSION", "index.md", "") in codes
    assert audit.failed(engine.audit())
    assert engine.path("beta", "deep/gamma") == ["beta", "alpha", "deep/gamma"]
    with pytest.raises(GridError):
        engine.path("deep/gamma", "alpha")
    assert [r.id for r in engine.search("graph", "keyword").collect()] == ["alpha"]
    assert {r.id for r in engine.search("graph", "hybrid_bm25").collect()} >= {"alpha"}
    assert engine.show("./alpha.md").first().title == "Alpha" and {r.id for r in engine.backlinks("alpha").collect()} == {"beta"}
    for bad in (lambda: engine.search("x", "no"), lambda: engine.show("none"), lambda: engine.search("x", "semantic"), lambda: engine.explain("x", "alpha", "no")):
        with pytest.raises(GridError):
            bad()
    assert engine.explain("graph", "alpha", "keyword").first().score == 1.0
    free = Engine.parse(spark, str(folder), permissive=True)
    assert {r.id for r in free.concepts.collect()} == {"alpha", "beta", "deep/gamma", "loose"}
    store = str(tmp_path_factory.mktemp("store"))
    engine.ingest(store)
    other = Engine(spark, engine.concepts.filter("id = 'beta'"), "other")
    other.ingest(store)
    assert Engine.load(spark, store, str(folder)).concepts.count() == 3 and Engine.load(spark, store, "other").concepts.count() == 1
    (folder / "beta.md").write_text("---\ntype: New\nkeywords: [b]\n---\n")
    (folder / "delta.md").write_text("---\ntype: New\nkeywords: [d]\n---\n")
    (folder / "deep/gamma.md").unlink()
    counts = Engine.parse(spark, str(folder)).sync(store)
    assert counts == {"documents": 3, "added": 1, "updated": 1, "removed": 1, "skipped": 1}
    assert {(r.id, r.type) for r in Engine.load(spark, store, str(folder)).concepts.collect()} == {("alpha", "Concept"), ("beta", "New"), ("delta", "New")}
    assert Engine.parse(spark, str(folder)).sync(store)["skipped"] == 3 and Engine.load(spark, store, "other").concepts.count() == 1


def test_assets_and_codecs(spark, folder):
    found = {r.path: (r.media_type, r.is_text, r.warning) for r in assets.scan(spark, str(folder)).collect()}
    assert found["data.json"] == ("application/json", True, None) and found["real.png"] == ("image/png", False, None)
    assert found["wrong.jpg"][0] == "image/gif" and "mismatch" in found["wrong.jpg"][2] and not any(p.endswith(".md") for p in found)
    blobs = assets.scan(spark, str(folder), ("image/*",))
    assert {r.path for r in blobs.collect()} == {"real.png", "wrong.jpg"}  # pic.png holds text
    stored = assets.encode(assets.scan(spark, str(folder)))
    back = {r.path: bytes(r.content) for r in assets.decode(stored).collect()}
    assert back == {r.path: bytes(r.content) for r in assets.scan(spark, str(folder)).collect()}
    broken = assets.decode(stored.withColumn("body_codec", F.when(F.col("path") == "real.png", "lost").otherwise(F.col("body_codec"))))
    assert {r.path: r.warning for r in broken.collect() if r.warning} == {"real.png": "BODY_DECODE_FAILED"}
    with pytest.raises(GridError):
        assets.encode(blobs, "lost")


def test_privacy(spark):
    key = bytes(range(32))
    df = spark.createDataFrame([("a", "Secret words, ÜBER alles!"), ("b", ""), ("c", None)], "id string, body string")
    sealed = df.select("id", "body", privacy.encrypt(F.col("body"), key).alias("e"))
    for r in sealed.select("body", privacy.decrypt(F.col("e"), key).alias("back"), "e").collect():
        assert r.back == r.body and (r.e is None or r.e.startswith("enc:v1:"))
    wrong = sealed.select(privacy.decrypt(F.col("e"), bytes(32)).alias("x"), privacy.decrypt(F.col("body"), key).alias("plain"), "body").collect()
    assert all(r.x is None and r.plain == r.body for r in wrong)
    named = df.select(privacy.tokenized(F.col("body"), key).alias("t"), privacy.hashed(F.col("body"), key).alias("h")).collect()
    def mac(text):
        return hmac.new(key, text.encode(), hashlib.sha256).hexdigest()
    assert named[0].t == f"tok{mac('secret')} tok{mac('words')}, tok{mac('über')} tok{mac('alles')}!" and named[0].h == "hash" + mac("secret words, über alles!") and named[2].t is None
    assert privacy.query_aliases("Secret  Words", {"k": key}) == [f"tok{mac('secret')}", f"tok{mac('words')}", f"hash{mac('secret words')}"]
    assert privacy.key_bytes("00" * 32) == bytes(32) and privacy.key_bytes("x") == hashlib.sha256(b"x").digest()
    with pytest.raises(GridError):
        privacy.resolve_key("none-such")
    with pytest.raises(GridError):
        privacy.check_directive("shout", "k")
    body = 'a {{private:hash key_id="k"}}in{{/private:hash}} `{{private:hash key_id="k"}}x{{/private:hash}}`\n```\n{{private:hash key_id="k"}}\n```\n{{private:encrypt key_id="k"}}open\n{{private:odd}}\n'
    spans, warnings = privacy.inline_spans(body)
    assert [(p, body[a:b]) for p, _, a, b in spans] == [("hash", "in")] and warnings == ["unclosed directive encrypt", "invalid directive odd"]
    hidden = privacy.redacted(df.withColumn("policy", F.when(F.col("id") == "a", "encrypt").otherwise("none"))).collect()
    assert [r.body for r in hidden] == [None, "", None]


def test_inline_protection(spark):
    keys = {"k": bytes(32), "m": bytes(range(32))}
    body = 'open {{private:encrypt key_id="k"}}my secret{{/private:encrypt}} and {{private:tokenize key_id="m"}}Word two{{/private:tokenize}} end'
    df = spark.createDataFrame([("a", body, None, None), ("b", "whole text", "encrypt", "k"), ("c", "Whole Text", "hash", "m"), ("d", None, "none", None)], "id string, body string, policy string, key_id string")
    made = privacy.protect(df, keys)
    found = {r.id: r.body for r in made.collect()}
    assert "my secret" not in found["a"] and "enc:v1:" in found["a"] and "Word" not in found["a"] and found["a"].startswith("open {{private:encrypt")
    assert found["b"].startswith("enc:v1:") and found["c"] == privacy.named("hash", keys["m"], "whole text") and found["d"] is None
    back = {r.id: r.body for r in made.select("id", privacy.reveal_inline(F.col("body"), keys["k"]).alias("body")).collect()}
    assert "my secret" in back["a"] and back["b"] == "whole text"
    names = privacy.query_aliases("word", {"m": keys["m"]})
    concepts = made.select("id", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("description"), F.array().cast("array<string>").alias("keywords"), "body")
    assert [r.id for r in lexical.lexical_search(concepts, "word", aliases=tuple(names)).collect()] == ["a"]
    with pytest.raises(Exception, match="KEY_UNAVAILABLE|key unavailable"):
        privacy.protect(df.withColumn("body", F.lit('{{private:hash key_id="zz"}}x{{/private:hash}}')), keys).collect()


def test_cached_parsing_and_index_delta(spark, folder, tmp_path_factory):
    _, snapshot = bundle.parse_cached(spark, str(folder), None)
    rows = spark.createDataFrame(snapshot.collect(), snapshot.schema)
    (folder / "fresh.md").write_text("---\ntype: x\n---\nnew words")
    (folder / "loose.md").unlink()
    again, _ = bundle.parse_cached(spark, str(folder), rows.withColumn("title", F.lit("kept")))
    titles = {r.id: r.title for r in again.collect()}
    assert set(titles) == {"alpha", "beta", "deep/gamma", "fresh"} and titles["alpha"] == "kept" and titles["fresh"] is None
    place = str(tmp_path_factory.mktemp("index"))
    stored.build(rows.filter("is_concept"), place)
    stored.change(spark, place, spark.createDataFrame([("beta",)], "id string"), again.filter("id = 'fresh'"))
    assert {r.id for r in stored.Index(spark, place).table("postings").collect()} == {"alpha", "deep/gamma", "fresh"}


def test_providers_and_registry(spark):
    providers.register_provider("good", lambda root: {"documents": [{"id": "_g/a", "body": "x"}], "relations": [{"from": "_g/a", "to": "y", "kind": "imports"}], "consumed": ["a.md"], "artifacts": [{"path": "x.json", "media_type": "application/json", "content": {"b": 1}}]})
    found = providers.materialize(spark, "good", "/r")
    assert found["documents"].first().path == "_g/a.md" and found["relations"].first().kind == "imports" and found["artifacts"].first().content == '{"b": 1}'
    for bad in ({"documents": [{"id": "a"}]}, {"relations": [{"from": "a", "to": "b", "kind": "Bad"}]}, {"consumed": ["../x"]}, {"documents": [{"id": "_a"}] * 1001}):
        providers.register_provider("bad", lambda root, bad=bad: bad)
        with pytest.raises(GridError):
            providers.materialize(spark, "bad", "/r")
    registry = spark.createDataFrame([("a", "/a", "ok", 3, 1, "h"), ("b", "/b", "ok", 1, 1, "h")], federation.REGISTRY)
    news = spark.createDataFrame([("a", "/a2", "ok", None, 2, "i"), ("c", "/c", "ok", None, 2, "j")], federation.REGISTRY)
    rows = {r.alias: (r.path, r.generation) for r in federation.upsert_sources(registry, news).collect()}
    assert rows == {"a": ("/a2", 4), "b": ("/b", 1), "c": ("/c", 1)}
    assert [r.alias for r in federation.prune_sources(registry, ["b"]).collect()] == ["b"] and federation.prune_sources(registry, []).count() == 0


def test_envelopes(spark):
    said = envelope.success(spark.range(5), 3)
    assert said["ok"] and len(said["result"]["rows"]) == 3 and said["result"]["truncated"] and json.loads(envelope.text(said))
    assert envelope.failure(GridError("X", "no"))["error"] == {"code": "X", "message": "no"} and envelope.failure(ValueError("v"))["error"]["code"] == "INTERNAL"


def test_extensions(spark):
    concepts = spark.createDataFrame([("a", None, "", "Alpha body", ["One"], "a.md", "t", None), ("b", "Kept", "d", "x", None, "b.md", "t", None)],
                                     "id string, title string, description string, body string, keywords array<string>, path string, type string, status string")

    def words(row):
        if row["id"] == "b":
            raise ValueError("no")
        return {"keywords": ["one", " Two ", ""], "title": "Made", "description": "Said"}

    enrich.register("enricher", "words", words)
    enrich.register("embedder", "lengths", lambda text: [len(text), 1.0])
    enrich.register("scorer", "short", lambda query, rows: {r["id"]: 2.0 if r["id"] == "a" else -1.0 for r in rows})
    found = enrich.enrichments(concepts, "words")
    assert {r.id: bool(r.warning) for r in found.collect()} == {"a": False, "b": True}
    merged = {r.id: (r.title, r.description, r.keywords) for r in enrich.apply_enrichments(concepts, found).collect()}
    assert merged == {"a": ("Made", "Said", ["One", "Two"]), "b": ("Kept", "d", [])}
    made = {r.id: (r.vector, r.warning) for r in enrich.embed(concepts, "lengths", "m", 2).collect()}
    assert made["a"][1] is None and made["a"][0][1] == 1.0
    assert all(r.vector is None and r.warning for r in enrich.embed(concepts, "lengths", "m", 3).collect())
    hits = spark.createDataFrame([("a", 0.5), ("b", 0.4)], "id string, score double")
    given = enrich.given_scores(enrich.candidates(hits, concepts), "short", "q")
    assert {r.id: r.given_score for r in given.collect()} == {"a": 1.0, "b": 0.0}
    assert ("scorer", "short") in enrich.listed()
    for bad in (lambda: enrich.registered("scorer", "none"), lambda: enrich.register("cook", "x", len)):
        with pytest.raises(GridError):
            bad()


def test_export(spark, folder, tmp_path_factory):
    engine = Engine.parse(spark, str(folder))
    out = str(tmp_path_factory.mktemp("out"))
    assert export.write_files(spark, export.rendered(engine.concepts), out, {"kind": "raw"}) == 3
    again = Engine.parse(spark, out)
    assert {(r.id, r.title, r.body.strip()) for r in again.concepts.collect()} == {(r.id, r.title, r.body.strip()) for r in engine.concepts.collect()}
    key = bytes(32)
    sealed = {r.path: r.text for r in export.rendered(engine.concepts, key, "k1").collect()}
    assert all('"encoded": true' in t and "enc:v1:" in t for t in sealed.values())
    assert [r.line for r in export.index_text(engine.concepts).collect()][0] == "- [Alpha](alpha.md) - First one\n"
    with pytest.raises(GridError):
        export.write_files(spark, spark.createDataFrame([("../x", "t")], "path string, text string"), out, {})
    with pytest.raises(GridError):
        export.check_data([{"key": "a", "path": "/x", "size": 1}])
    files = spark.createDataFrame([("h1", "p1"), ("h2", "p2")], "sha256 string, path string")
    assert [r.path for r in export.unreferenced(files, files.filter("sha256 = 'h1'")).collect()] == ["p2"]


def test_synthetic_sources(spark):
    concepts = spark.createDataFrame([("a/b/c", "a/b/c.md"), ("a/d", "a/d.md"), ("ab", "ab.md")], "id string, path string")
    made = spark.createDataFrame([("_s/x", "_s/x.md")], "id string, path string")
    scopes = spark.createDataFrame([("_s/x", "a"), ("_s/x", "ab.md")], "id string, scope string")
    merged, contains = export.synthetic_merge(concepts, made, concepts.filter("id = 'a/d'").select("path"), scopes)
    assert {r.id for r in merged.collect()} == {"a/b/c", "ab", "_s/x"} and {r.to for r in contains.collect()} == {"a/b/c", "ab"}
    for bad in (made.selectExpr("'x' AS id", "path"), made.selectExpr("'_s' AS id", "path").unionByName(concepts.limit(0)).selectExpr("'ab' AS id", "path")):
        with pytest.raises(GridError):
            export.synthetic_merge(concepts, bad, concepts.limit(0).select("path"))
    relations = spark.createDataFrame([("a/d", "e1"), ("ab", "e1"), ("ab", "e2"), ("ab", "a/d")], "id string, to string")
    outer = spark.createDataFrame([("e1", True), ("e2", True), ("in", False)], "id string, external boolean")
    assert {r.id for r in export.external_documents(outer, relations).collect()} == {"e1", "in"}
    assert [(r.id, r.to) for r in export.drop_unknown_ends(relations, concepts).collect()] == [("ab", "a/d")]


def test_watching(spark, folder, tmp_path_factory):
    stored = watch.listing(spark, str(folder))
    rows = [tuple(r) for r in stored.collect()]
    assert {p for p, _ in rows} == {"alpha.md", "beta.md", "deep/gamma.md", "loose.md"}
    events = []
    query = watch.watch_folder(spark, str(folder), str(tmp_path_factory.mktemp("cp")), lambda e, c: events.append((e, c and sorted(map(tuple, c.collect())))), "200 milliseconds")
    try:
        (folder / "new.md").write_text("---\ntype: x\n---\n")
        (folder / "beta.md").unlink()
        deadline = time.time() + 30
        while not events and time.time() < deadline:
            time.sleep(0.2)
    finally:
        query.stop()
    seen = [c for _, changes in events for c in changes or []]
    assert ("new.md", "added") in seen and ("beta.md", "removed") in seen and json.loads(watch.event_line(events[0][0]))["event"] == "sync"


def test_stream_state_equals_batch(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stream")
    rows = spark.range(300).selectExpr("id", "id % 17 AS user", "id * 1.5 AS value", "timestamp_seconds(id * 100) AS ts")
    rows.repartition(3).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    query = watch.apply_stream(stream, "user", "id", f"{base}/state", f"{base}/cp")
    query.awaitTermination()
    last = max(int(p.name) for p in (base / "state").iterdir() if p.name.isdigit())
    expected = watch.latest(rows, "user", "id")
    assert last >= 2 and sorted(map(tuple, spark.read.parquet(f"{base}/state/{last}").collect())) == sorted(map(tuple, expected.collect()))
    was, changes = watch.fold_batch(expected.filter("user < 5"), rows.filter("user < 7"), "user", "id")
    assert {r.user: r.action for r in changes.collect()} == {u: "skipped" if u < 5 else "added" for u in range(7)} and was.count() == 7
    assert watch.tumbling(rows, "ts", "1 hour", "user").agg(F.sum("events")).first()[0] == 300
    assert watch.sessions(rows, "ts", "10 minutes").first().events == 300


def test_bundle_of_nothing(spark, tmp_path):
    (tmp_path / "x.txt").write_text("x")
    assert Engine.parse(spark, str(tmp_path)).concepts.count() == 0
    entries, warnings = bundle.index(spark, str(tmp_path))
    assert entries.count() == 0 and warnings == ["empty bundle: no concept files found"]


def test_show_counts_and_stored_edges(spark, folder, tmp_path_factory):
    engine = Engine.parse(spark, str(folder))
    row = engine.show("beta").first()
    assert row.backlinks == ["alpha"] and row.privacy_state == "clear" and [(x.target, x.resolves_in_bundle) for x in row.links] == [("alpha.md", True)]
    sealed = Engine(spark, engine.concepts.withColumn("policy", F.lit("hash")), str(folder))
    assert sealed.show("beta").first().body is None and sealed.show("beta").first().privacy_state == "withheld"
    stats = engine.stats.first()
    assert (stats.nodes, stats.edges, stats.orphans, stats.kinds) == (3, 5, 0, {"link": 3, "related": 2})
    store = str(tmp_path_factory.mktemp("edges"))
    engine.ingest(store)
    kept = [(r["from"], r["to"], r.dangling) for r in Engine.load_edges(spark, store, str(folder)).collect()]
    assert ("alpha", "beta", False) in kept and ("alpha", "nope.md", True) in kept and ("alpha", "gone", True) in kept
    vectors = spark.createDataFrame([("alpha", [1.0, 0.0]), ("beta", [1.0, 1.0]), ("gone", [1.0, 0.1])], "id string, vector array<double>")
    hits = Engine(spark, engine.concepts, str(folder), embeddings=vectors).search("", "semantic", 3, [1.0, 0.0]).collect()
    assert [(r.id, r.title, r.score) for r in hits] == [("alpha", "Alpha", 1.0), ("beta", "beta", 0.7071)]


@pytest.mark.parametrize("name, data, expected", [
    ("a.yaml", b"a: 1", "application/x-yaml"), ("a.JS", b"x", "application/javascript"), ("a.h", b"x", "text/x-c"), ("a.log", b"", "text/plain"), ("a.png", b"\x89PNG\r\n\x1a\n", "image/png"),
    ("a", b"  <!DOCTYPE HTML><p>", "text/html"), ("a", b"<?xml version='1.0'?>", "text/xml"), ("a", b"plain", "text/plain"), ("a", b"\xff\x00\x01", "application/octet-stream"),
    ("a.bin", b"ID3\x04", "audio/mpeg"), ("a.pdf", b"\x01\x02", "application/pdf"), ("a.py", b"\xff", "application/octet-stream"), (".gitignore", b"x", "text/plain"), ("a.svg", b"<svg>", "text/plain")])
def test_media_types_by_name_and_bytes(name, data, expected):
    assert assets.detect(name, data)[0] == expected


def test_assets_are_bounded(spark, folder, monkeypatch):
    monkeypatch.setattr(assets, "TOTAL", 10)
    with pytest.raises(GridError):
        assets.scan(spark, str(folder))


def test_inline_directives_pair_up():
    def tag(policy, text="", close=True):
        return f'{{{{private:{policy} key_id="k"}}}}{text}' + (f"{{{{/private:{policy}}}}}" if close else "")

    body = f"{tag('hash', 'one')} {tag('tokenize', 'two')}\n{tag('hash', 'out ' + tag('hash', 'in', False))} {tag('hash', 'three')}\n  ~~~\n{tag('hash', 'no')}\n  ~~~\n{tag('encrypt', 'a', False)}{{{{/private:hash}}}}\n"
    spans, warnings = privacy.inline_spans(body)
    assert [body[a:b] for _, _, a, b in spans] == ["one", "two", "three"]
    assert warnings == ["nested directive hash", "unclosed directive encrypt"]
    other = body.replace("private:", "secret:")
    assert privacy.inline_spans(other)[0] == [] and len(privacy.inline_spans(other, "secret")[0]) == 3


def test_a_watcher_keeps_its_listing_in_a_table(spark, folder, tmp_path):
    seen = []
    query = watch.watch_folder(spark, str(folder), str(tmp_path / "watch"), lambda event, changes: seen.append((event, changes and sorted(map(tuple, changes.collect())))))
    try:
        time.sleep(3)
        (folder / "new.md").write_text("---\ntype: New\n---\n")
        for _ in range(60):
            if seen:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert seen and seen[0][0]["added"] == 1 and seen[0][1] == [("new.md", "added")]
