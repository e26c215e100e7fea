"""Workspaces: manifests, reconciling, states and searches over stored sources."""

import time

import pytest

from corpusgrid.errors import GridError
from corpusgrid.storage import workspace
from corpusgrid.storage.workspace import Workspace


def note(folder, name, body, links=""):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.md").write_text(f"---\ntype: x\nkeywords: [{name}]\n---\n{body} {links}")


def test_manifests():
    made = workspace.parse_manifest("version: 1\nindex: idx\nsources:\n  a: notes\n  b: {path: /abs}\n", "/w")
    assert made.index == "/w/idx" and made.sources == {"a": "/w/notes", "b": "/abs"}
    assert workspace.parse_manifest("version: 1", "/w").sources == {}
    for bad in ("version: 2", "[", "x", "version: 1\nsources: {workspace: a}", "version: 1\nsources: {a: 3}", "version: 1\nsources: {A!: x}", "version: 1\nsources: {a: x, b: x}"):
        with pytest.raises(GridError):
            workspace.parse_manifest(bad, "/w")


def test_reconcile_states_and_search(spark, tmp_path):
    note(tmp_path / "one", "a", "alpha beta")
    note(tmp_path / "two", "b", "alpha alpha", "[x](gone.md)")
    manifest = workspace.parse_manifest("version: 1\nsources: {one: one, two: two, lost: nowhere}", str(tmp_path))
    space = Workspace(spark, manifest)
    assert {(r.alias, r.status, r.added) for r in space.reconcile().collect()} == {("one", "ready", 1), ("two", "ready", 1), ("lost", "degraded", 0)}
    first = {r.alias: r for r in space.registry().collect()}
    assert first["lost"].status == "degraded" and first["one"].generation == 1 and first["one"].content_hash
    assert {(r.alias, r.documents, r.dangling) for r in space.stats().collect()} == {("one", 1, 0), ("two", 1, 1), ("*", 2, 1)}
    hits, status = space.search("alpha")
    assert {(r.source, r.id) for r in hits.collect()} == {("one", "a"), ("two", "b")}
    assert {r.source: r.status for r in status.collect()} == {"one": "ok", "two": "ok", "lost": "degraded"}
    note(tmp_path / "one", "c", "gamma")
    smaller = Workspace(spark, workspace.parse_manifest("version: 1\nsources: {one: one}", str(tmp_path)))
    assert [(r.alias, r.added, r.skipped) for r in smaller.reconcile().collect()] == [("one", 1, 1)]
    rows = smaller.registry().collect()
    assert [(r.alias, r.generation) for r in rows] == [("one", 2)] and rows[0].content_hash != first["one"].content_hash
    for bad in (lambda: smaller.collection("two"), lambda: smaller.search("alpha", "nothing")):
        with pytest.raises(GridError):
            bad()


def test_a_manifest_is_followed(spark, tmp_path):
    note(tmp_path / "one", "a", "alpha")
    note(tmp_path / "two", "b", "beta")
    path, told = tmp_path / "space.yaml", []
    path.write_text("version: 1\nsources: {one: one}\n")
    query = workspace.follow(spark, str(path), str(tmp_path / "cp"), lambda rows: told.append({r.alias: r.added for r in rows.collect()}), pace="300 milliseconds")
    def until(n):
        end = time.time() + 90
        while len(told) < n and time.time() < end:
            time.sleep(0.3)
        assert len(told) == n
    try:
        until(1)
        path.write_text("version: 1\nsources: {one: one, two: two}\n")
        until(2)
    finally:
        query.stop()
    assert told == [{"one": 1}, {"one": 0, "two": 1}]
