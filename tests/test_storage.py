"""Versioned tables, stored collections and the segmented index: what a change keeps, loses and writes."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corpusgrid.engine import Engine
from corpusgrid.errors import GridError
from corpusgrid.functions.similarity import similarity
from corpusgrid.operators import fuzzy, graph
from corpusgrid.plans import stored
from corpusgrid.storage import versions
from corpusgrid.storage.collection import Collection, place
from corpusgrid.storage.versions import Conflict, Versions

CONCEPT = """id string, path string, title string, description string, keywords array<string>, tags array<string>, type string, status string, body string,
  related array<string>, content_hash string, links array<struct<raw: string, target: string, resolved: string, resolves_in_bundle: boolean>>"""


def scan(spark, docs):
    """{id: (body, [linked ids], [related])} as a scan gives it, links resolved against each other."""
    rows = []
    for i, (body, links, related) in docs.items():
        links = [(f"[x]({t}.md)", f"{t}.md", f"{t}.md", t in docs) for t in links]
        rows.append((i, i + ".md", i.title(), None, [i], [], "Doc", None, body, related, str(hash((body, str(links) and tuple(x[1] for x in links), tuple(related)))), links))
    return spark.createDataFrame(rows, CONCEPT)


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert sorted(map(repr, map(tuple, a.select(*columns).collect()))) == sorted(map(repr, map(tuple, b.select(*columns).collect())))


DOCS = {"a": ("alpha beta words", ["b", "c"], ["c", "late"]), "b": ("beta alpha", ["a"], []), "c": ("gamma", [], []), "d": ("delta words", ["late", "b"], [])}
RELATIONS = "id string, to string, kind string, raw string, seq long"


def check(spark, kept, docs, relations=None, index=False):
    """The store against a collection made at once, its index too."""
    now = scan(spark, docs)
    same(kept.read("concepts"), now)
    same(kept.read("edges"), graph.stored_edges(now, relations))
    if not index:
        return
    fresh = Collection(spark, kept.versions.root + "-fresh", kept.root)
    fresh.ingest(now, relations)
    for table in ("postings", "keywords", "lengths"):
        same(kept.read(table), fresh.read(table))
    one, other = kept.index(), fresh.index()
    assert (one.documents, one.tokens) == (other.documents, other.tokens)
    for query in ('"alpha beta"', 'words -"alpha beta"'):
        same(one.bm25(query), other.bm25(query))
    same(one.fuzzy("alpa wrds"), other.fuzzy("alpa wrds"))


def test_sync_keeps_relations_and_empties_the_store(spark, tmp_path):
    relations = spark.createDataFrame([("a", "d", "imports", None, 0), ("c", "late", "imports", None, 0)], RELATIONS)
    kept = Collection(spark, str(tmp_path), "/notes", indexed=False)
    with pytest.raises(GridError):
        kept.sync(scan(spark, DOCS))
    kept.ingest(scan(spark, DOCS), relations)
    check(spark, kept, DOCS, relations)
    docs = {**DOCS, "late": ("late words", ["a"], [])}  # links, an entry and a relation led to it before it was there
    assert kept.sync(scan(spark, docs)) == {"documents": 5, "added": 1, "updated": 0, "removed": 0, "skipped": 4}
    check(spark, kept, docs, relations)
    kinds = {(r["from"], r["to"], r.source): r.dangling for r in kept.read("edges").collect()}
    assert kinds["a", "d", "imports"] is False and kinds["c", "late", "imports"] is False and kinds["d", "late", "link"] is False and kinds["a", "late", "related"] is False
    docs = {**docs, "b": ("changed alpha", ["late"], [])}
    del docs["c"]
    assert kept.sync(scan(spark, docs)) == {"documents": 4, "added": 0, "updated": 1, "removed": 1, "skipped": 3}
    check(spark, kept, docs, relations)
    assert {r.id for r in kept.read("relations").collect()} == {"a"}  # the removed concept's own go with it
    same(Engine.load(spark, str(tmp_path), "/notes").edges, graph.build_edges(scan(spark, docs), relations))
    given = spark.createDataFrame([("d", "a", "declares", None, 0)], RELATIONS)
    assert kept.sync(scan(spark, docs), given)["skipped"] == 4  # nothing changed but the relations
    check(spark, kept, docs, given)
    was = kept.snapshot()["version"]
    assert kept.sync(scan(spark, docs))["skipped"] == 4 and kept.snapshot()["version"] == was
    assert kept.sync(scan(spark, {})) == {"documents": 0, "added": 0, "updated": 0, "removed": 4, "skipped": 0}
    check(spark, kept, {}, given)
    assert kept.read("edges").count() == 0
    assert kept.sync(scan(spark, DOCS))["added"] == 4
    check(spark, kept, DOCS)


def test_sync_keeps_the_index(spark, tmp_path):
    kept = Collection(spark, str(tmp_path), "r")
    kept.ingest(scan(spark, DOCS))
    kept.sync(scan(spark, {}))
    assert kept.index().documents == 0 and kept.index().bm25("alpha").count() == 0
    docs = {**DOCS, "b": ("changed alpha", ["late"], []), "late": ("late alpha beta", [], [])}
    kept.sync(scan(spark, docs))
    check(spark, kept, docs, index=True)


def test_readers_never_see_two_halves(spark, tmp_path):
    kept = Collection(spark, str(tmp_path), "r")
    kept.ingest(scan(spark, DOCS))
    record, index = kept.snapshot(), kept.index()
    before = sorted(map(repr, index.bm25("alpha").collect()))
    kept.sync(scan(spark, {"z": ("alpha zebra", [], [])}))
    assert {r.id for r in kept.read("concepts", record).collect()} == set(DOCS) and kept.read("edges", record).count() > 0
    assert sorted(map(repr, index.bm25("alpha").collect())) == before
    assert {r.id for r in kept.read("concepts").collect()} == {"z"}
    # what a writer that stopped before its commit has written is not seen, and goes later
    lost = kept.versions.begin()
    lost.put("concepts", scan(spark, DOCS))
    assert {r.id for r in kept.read("concepts").collect()} == {"z"}
    assert kept.versions.vacuum(lease=-60) >= 1 and kept.read("concepts").count() == 1 and kept.index().bm25("zebra").count() == 1


def test_of_two_writers_one_commits(spark, tmp_path):
    table = Versions(spark, str(tmp_path), {"t": "t"})
    one, other = table.begin(), table.begin()
    one.put("t", spark.range(3))
    other.put("t", spark.range(5))
    assert one.commit(by="one") == 1
    with pytest.raises(Conflict):
        other.commit(by="other")
    assert table.read(table.record(), "t").count() == 3 and table.record()["facts"] == {"by": "one"}


def test_tombstones_and_compaction(spark, tmp_path, monkeypatch):
    """Rows of a later version live, whatever order the versions wrote and removed them in."""
    table = Versions(spark, str(tmp_path), {"t": "s", "u": "s"}, {"u": "key"})
    draw, state = random.Random(1), {}
    def rows(found):
        return spark.createDataFrame(sorted(found.items()), "id long, v long")
    for n in range(11):
        gone = {k for k in state if draw.random() < 0.3}
        new = {draw.randrange(40): n * 100 + k for k in range(5)}
        changes = table.begin()
        changes.bury("s", spark.createDataFrame([(k,) for k in gone | set(new)], "id long"))
        changes.put("t", rows(new))
        changes.put("u", rows(new).withColumnRenamed("id", "key"))
        changes.commit()
        state = {k: v for k, v in state.items() if k not in gone} | new
        if n in (8, 10):
            monkeypatch.setattr(versions, "BROADCAST", 0)  # the other plan
            table.compact()
            assert len(table.record()["tables"]["t"]) <= versions.SEGMENTS
        found = table.record()
        assert {r.id: r.v for r in table.read(found, "t").collect()} == state
        assert {r.key: r.v for r in table.read(found, "u").collect()} == state
    assert not table.record()["tombstones"].get("s")  # a compaction of all rows leaves nothing to bury


def test_a_change_writes_its_own_rows(spark, tmp_path):
    """After a change of 1 % the index equals a full one and has written a few hundredths of it."""
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(2000)]
    docs = {f"n{i}": (" ".join(draw.choices(words, k=60)), [f"n{draw.randrange(600)}"], []) for i in range(600)}
    kept = Collection(spark, str(tmp_path), "r")
    kept.ingest(scan(spark, docs))
    def size(version):
        return {t: sum(s["bytes"] for s in found if s["version"] == version) for t, found in kept.snapshot()["tables"].items()}
    whole = size(1)
    for i in range(0, 600, 100):
        docs[f"n{i}"] = ("new words " + docs[f"n{i}"][0], docs[f"n{i}"][1], [])
    assert kept.sync(scan(spark, docs))["updated"] == 6
    added = size(2)
    assert all(added[t] < 0.06 * whole[t] for t in ("concepts", "postings")), (added, whole)
    check(spark, kept, docs, index=True)


def test_grams_find_every_similar_token(spark, tmp_path):
    draw = random.Random(7)
    words = {"".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 12))) for _ in range(700)} | {"a" * k for k in (1, 2, 3, 5, 9, 62, 63, 70)} | {"worthless", "statin", "wo", "w", "日本語", "tökn"}
    df = spark.createDataFrame([(w, w, None, [], "") for w in sorted(words)], "id string, title string, description string, keywords array<string>, body string")
    stored.build(df, str(tmp_path))
    index = stored.Index(spark, str(tmp_path))
    asked = ["worthles", "aaaa", "aaaaaaaaaaaa", "ab", "tökn", "日本語", "abcdabcd", "é", "a" * 64]
    for q in asked:
        found = {r.token for r in fuzzy.similar_tokens(index.candidates([q]), [q]).collect()}
        near = df.select("id").filter((similarity(F.lit(q), F.col("id")) >= 0.55) if len(q) >= 3 else F.startswith("id", F.lit(q)))
        assert found == {r.id for r in near.collect()}, q


def test_letter_pairs_of_a_long_token(spark):
    """A token's pairs are made once, not once for each pair: 6,000 characters took minutes."""
    began = time.perf_counter()
    tokens = ["abababa", "aaaa", "ééx", "ab" * 3_000]
    rows = stored.gram_rows(spark.createDataFrame([(t,) for t in tokens], "token string")).groupBy("token").agg(F.collect_list("gram").alias("grams")).collect()
    assert {r["token"]: sorted(r["grams"]) for r in rows} == {t: sorted(stored.numbered_pairs(t)) for t in tokens}
    assert time.perf_counter() - began < 30


def test_candidates_are_a_small_part_of_the_vocabulary(spark, tmp_path):
    draw = random.Random(11)
    words = {"".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(3, 11))) for _ in range(4000)} | {"worthless"}
    df = spark.createDataFrame([(w, w, None, [], "") for w in sorted(words)], "id string, title string, description string, keywords array<string>, body string")
    stored.build(df, str(tmp_path))
    index = stored.Index(spark, str(tmp_path))
    assert index.candidates(["worthles"]).count() < 0.1 * len(words) and index.fuzzy("worthles").first().id == "worthless"
    plan = index.candidates(["worthles"])._jdf.queryExecution().toString()
    assert "In(gram" in plan.replace(" ", "") or "gramIN" in plan.replace(" ", "")


def test_phrases_read_only_their_tokens(spark, tmp_path):
    df = scan(spark, DOCS)
    stored.build(df, str(tmp_path))
    plan = stored.Index(spark, str(tmp_path)).bm25('"alpha beta" -gamma')._jdf.queryExecution().toString().replace(" ", "")
    assert "PushedFilters:[In(token,[alpha,beta,gamma])]" in plan


def test_collections_of_a_store_are_apart(spark, tmp_path):
    one, other = Collection(spark, str(tmp_path), "one"), Collection(spark, str(tmp_path), "other", indexed=False)
    one.ingest(scan(spark, DOCS), artifacts=spark.createDataFrame([("a", "vector", "x"), ("b", "vector", "y")], "id string, kind string, data string"))
    other.ingest(scan(spark, {"z": ("zebra", [], [])}))
    assert place(str(tmp_path), "one") != place(str(tmp_path), "other")
    one.sync(scan(spark, {k: v for k, v in DOCS.items() if k != "b"}))
    assert [r.id for r in one.read("artifacts").collect()] == ["a"] and other.read("concepts").count() == 1
    for bad in (lambda: other.index(), lambda: other.read("relations"), lambda: Engine.load(spark, str(tmp_path), "none")):
        with pytest.raises(GridError):
            bad()


def test_a_scan_is_made_once(spark, tmp_path):
    """Concepts, edges, references and the index come from the rows as written, however costly the scan is."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    plain = scan(spark, DOCS)
    kept = Collection(spark, str(tmp_path), "/notes")
    kept.ingest(plain.mapInArrow(count, plain.schema))
    assert made.value == len(DOCS)
    check(spark, kept, DOCS, index=True)
