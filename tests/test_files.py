"""Files written under a commit protocol, providers as data sources, and a watched folder."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from corpusgrid.engine import Engine
from corpusgrid.errors import GridError
from corpusgrid.operators import export
from corpusgrid.sources import bundle, files, markdown, providers
from corpusgrid.streaming import watch


def below(folder):
    return sorted(os.path.relpath(os.path.join(d, n), folder) for d, _, names in os.walk(folder) for n in names)


def test_files_are_written_by_tasks_and_the_manifest_last(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.range(57).select(F.concat(F.lit("deep/"), (F.col("id") % 5).cast("string"), F.lit("/n"), F.col("id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("té "), "id").alias("text"))
    assert export.write_files(spark, rows.repartition(6), out, {"kind": "raw"}) == 57
    assert len(below(out)) == 58 and (tmp_path / "out/deep/3/n8.md").read_text() == "té 8"
    assert json.loads((tmp_path / "out/manifest.json").read_text()) == {"files": 57, "kind": "raw"}
    assert export.write_files(spark, rows.limit(0), str(tmp_path / "none"), {}) == 0 and below(tmp_path / "none") == ["manifest.json"]
    assert export.write_files(spark, rows.limit(3), "file://" + str(tmp_path / "uri"), {}) == 3


def test_files_are_rendered_by_the_worker_that_writes_them(spark, tmp_path):
    rows = [("a.md", '{"b": "é", "a": [1]}', "body"), ("b.md", None, None), ("c.md", "{}", "")]
    concepts = spark.createDataFrame(rows, "path string, frontmatter string, body string")
    for key_id in (None, "k1"):
        out = str(tmp_path / str(key_id))
        given = export.unrendered(concepts)
        assert "Python" not in given._jdf.queryExecution().executedPlan().toString() and export.write_files(spark, given, out, {}, key_id) == 3
        for r in export.rendered(concepts, key_id=key_id).collect():
            assert open(f"{out}/{r.path}", encoding="utf-8").read() == r.text


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.range(40).select(F.concat(F.lit("n"), "id").alias("path"), F.lit("x").alias("text")).repartition(4).unionByName(spark.createDataFrame([("../x", "t")], "path string, text string"))
    with pytest.raises(GridError):
        export.write_files(spark, rows, out, {})
    assert below(tmp_path) == []
    for bad in ("/etc/x", "a/../../x", "", files.ATTEMPTS + "/x"):
        assert not files.inside(bad)


def test_provider_parts_are_asked_in_tasks(spark):
    def call(root, part):
        return {"documents": [{"id": f"_{part}/{i}", "body": f"{root} {part} {os.getpid()}"} for i in range(3)], "relations": [{"from": f"_{part}/0", "to": f"_{part}/1", "kind": "next"}]}

    providers.register_provider("parted", call, lambda root: ["a", "b", "c"])
    found = providers.materialize(spark, "parted", "/r")
    rows = found["documents"].collect()
    assert {r.id for r in rows} == {f"_{p}/{i}" for p in "abc" for i in range(3)} and all(r.body.startswith("/r ") for r in rows)
    assert str(os.getpid()) not in {r.body.split()[-1] for r in rows}  # never on the driver
    assert found["relations"].count() == 3 and found["consumed"].count() == 0
    providers.register_provider("twice", lambda root, part: {"documents": [{"id": "_same"}]}, lambda root: ["a", "b"])
    for name, code in (("twice", "EXTENSION_INVALID"), ("absent", "EXTENSION_NOT_FOUND")):
        with pytest.raises(GridError) as error:
            providers.materialize(spark, name, "/r")
        assert error.value.code == code


@pytest.fixture
def folder(tmp_path):
    made = tmp_path / "notes"
    made.mkdir()
    for name in ("a", "b"):
        (made / f"{name}.md").write_text(f"---\ntype: x\nkeywords: [{name}]\n---\n{name}")
    return made


def until(condition, seconds=60):
    end = time.time() + seconds
    while not condition() and time.time() < end:
        time.sleep(0.2)
    assert condition()


def test_an_edit_while_changes_are_told_is_told_once(spark, folder, tmp_path):
    told = []

    def emit(event, changes):
        rows = sorted(map(tuple, changes.collect()))
        if rows == [("c.md", "added")]:  # an edit between the listing and its end
            (folder / "during.md").write_text("---\ntype: x\n---\n")
        told.append(rows)

    checkpoint = str(tmp_path / "cp")
    query = watch.watch_folder(spark, str(folder), checkpoint, emit, "200 milliseconds")
    try:
        (folder / "c.md").write_text("---\ntype: x\n---\n")
        until(lambda: len(told) > 1)
    finally:
        query.stop()
    assert told == [[("c.md", "added")], [("during.md", "added")]]
    (folder / "down.md").write_text("---\ntype: x\n---\n")  # nobody watches
    (folder / "a.md").unlink()
    query = watch.watch_folder(spark, str(folder), checkpoint, emit, "200 milliseconds")
    try:
        until(lambda: len(told) > 2)
        time.sleep(2)
    finally:
        query.stop()
    assert told[2:] == [[("a.md", "removed"), ("down.md", "added")]]


def test_what_could_not_be_told_comes_again(spark, folder, tmp_path):
    told = []

    def emit(event, changes):
        told.append(event["errors"] if changes is None else sorted(map(tuple, changes.collect())))
        if len(told) == 1:
            raise RuntimeError("lost")

    query = watch.watch_folder(spark, str(folder), str(tmp_path / "cp"), emit, "200 milliseconds")
    try:
        (folder / "c.md").write_text("---\ntype: x\n---\n")
        until(lambda: len(told) > 2)
    finally:
        query.stop()
    assert told == [[("c.md", "added")], 1, [("c.md", "added")]]


def test_listings_hash_only_what_changed(spark, folder):
    known = watch.whole_listing(spark, str(folder))
    marked = spark.createDataFrame(known.withColumn("content_hash", F.lit("known")).collect(), watch.LISTING)
    time.sleep(1.1)
    (folder / "b.md").write_text("---\ntype: x\n---\nlonger than it was")
    (folder / "c.md").write_text("---\ntype: x\n---\n")
    found = {r.path: r.content_hash for r in watch.whole_listing(spark, str(folder), marked).collect()}
    assert found["a.md"] == "known" and "known" not in (found["b.md"], found["c.md"]) and len(found) == 3
    (folder / "a.md").unlink()
    assert {r.path for r in watch.whole_listing(spark, str(folder), marked).collect()} == {"b.md", "c.md"}


def test_many_small_files_are_listed_and_read_by_few_tasks(spark, tmp_path):
    for i in range(600):  # Spark's own source deals 32 of them to a task
        (tmp_path / f"n{i}.md").write_text(f"text {i}")
    (tmp_path / "_hidden.md").write_text("x")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git/x.md").write_text("x")
    found = bundle.files(spark, str(tmp_path), "*.md")
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert {(r.path, bytes(r.content), r.length) for r in found.collect()} == {(f"n{i}.md", f"text {i}".encode(), len(f"text {i}")) for i in range(600)}
    own = spark.read.format("binaryFile").load(str(tmp_path)).select(F.regexp_extract("path", "[^/]+$", 0).alias("path"), "modificationTime", "length")
    listed = bundle.listed(spark, str(tmp_path), "*.md")
    assert listed.rdd.getNumPartitions() == 1 and listed.exceptAll(own).isEmpty() and own.exceptAll(listed).isEmpty()


def test_a_stored_collection_follows_its_folder(spark, folder, tmp_path):
    store, told = str(tmp_path / "store"), []
    Engine.parse(spark, str(folder)).ingest(store, indexed=False)
    query = watch.keep_synced(spark, str(folder), store, str(tmp_path / "cp"), told.append, "200 milliseconds")
    try:
        (folder / "new.md").write_text("---\ntype: x\nkeywords: [n]\n---\nsee [a](a.md)")
        until(lambda: any(t.get("added") for t in told))
    finally:
        query.stop()
    assert told[0]["skipped"] == 2 and {r.id for r in Engine.load(spark, store, str(folder)).concepts.collect()} == {"a", "b", "new"}
    assert [(r["from"], r["to"]) for r in Engine.load_edges(spark, store, str(folder)).collect()] == [("new", "a")]


@pytest.mark.parametrize("line, expected", [
    ("[a]: x", ("a", "x")), ("   [A b]:  <x y>", ("A b", "x y")), ('[a]: x "t"', ("a", "x")), ("[a]: x (t)", ("a", "x")), ("[a]:x", ("a", "x")),
    ("    [a]: x", None), ("[a] : x", None), ("[]: x", None), ("[a]:", None), ("[a]: x y", None), ('[a]: x "t" u', None), ("[a]: <>", ("a", "<>")), ("[a]: <x>y", ("a", "<x>y")), ("[a]: x (t(u)", None),
])
def test_lines_that_name_targets(line, expected):
    assert markdown._naming(line) == expected
