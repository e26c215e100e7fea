"""A stored collection: concepts, edges, relations, index and artifacts under one version record.

``ingest`` writes everything anew. ``sync`` compares content hashes and writes what a change touches: rows of new
and changed concepts, and of those whose links, entries or relations may lead to an id that came or went (an inverted
table of references finds them), with the keys they replace. Relations and artifacts that are not given
again stay; those of removed concepts go. An empty scan removes every concept, and is a version like any other.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrid.errors import GridError
from corpusgrid.operators import graph, sync
from corpusgrid.plans import stored
from corpusgrid.runtime import cut, together
from corpusgrid.storage.versions import Conflict, Transaction, Versions

SPACES = {"concepts": "graph", "edges": "graph", "references": "graph", "relations": "relations", "artifacts": "artifacts", "data": "data", "blobs": "blobs", **stored.SPACES}
KEYS = {"edges": "from", "data": "owner", "blobs": "sha256"}


def place(store: str, root: str) -> str:
    """The folder of a collection: a store keeps each by a digest of its root."""
    return f"{store.rstrip('/')}/{hashlib.sha256(root.encode()).hexdigest()[:16]}"


class Collection:
    """``indexed`` false leaves the search index out."""

    def __init__(self, spark: SparkSession, store: str, root: str, indexed: bool = True):
        self.spark, self.root, self.indexed = spark, root, indexed
        self.versions = Versions(spark, place(store, root), SPACES, KEYS)

    # -- reading ----------------------------------------------------------------------------------

    def snapshot(self, version: int | None = None) -> dict:
        record = self.versions.record(version)
        if not record["version"]:
            raise GridError("STORE_NOT_FOUND", f"nothing stored for {self.root!r}")
        return record

    def read(self, table: str, record: dict | None = None) -> DataFrame:
        """A table of the latest version, or of a record that ``snapshot`` gave."""
        record = record or self.snapshot()
        if not self.versions.has(record, table):
            raise GridError("STORE_NOT_FOUND", f"no {table} stored for {self.root!r}")
        return self.versions.read(record, table)

    def has(self, table: str, record: dict | None = None) -> bool:
        return self.versions.has(record or self.snapshot(), table)

    def index(self, version: int | None = None) -> stored.Index:
        """The search index; titles that are missing are ids."""
        return stored.Index(self.spark, self.versions.root, version, self.versions)

    # -- writing ----------------------------------------------------------------------------------

    def _graph(self, changes: Transaction, rows: DataFrame, ids: DataFrame | None) -> DataFrame:
        """Concepts with their edges and references; the concepts as written. They are made once: all else reads
        the columns that it needs from the segment."""
        rows = changes.versions._open(changes.put("concepts", rows))
        relations = changes.rows("relations") if "relations" in changes.tables else None
        own = relations if relations is None or ids is None else relations.join(rows.select("id"), "id", "left_semi")
        led = graph.references(rows, own).repartitionByRange("target").sortWithinPartitions("target")
        together(lambda: changes.put("edges", graph.stored_edges(rows, own, ids)), lambda: changes.put("references", led))
        return rows

    @staticmethod
    def _searched(rows: DataFrame) -> DataFrame:
        return rows.withColumn("title", F.coalesce("title", F.col("id").cast("string")))

    def ingest(self, concepts: DataFrame, relations: DataFrame | None = None, artifacts: DataFrame | None = None) -> int:
        """Replaces the whole collection; the version. ``artifacts`` have an id and any columns."""
        while True:
            changes = self.versions.begin()
            held = {t: changes.tables[t] for t in ("data", "blobs") if t in changes.tables}  # extension data is not made from a scan
            changes.tables, changes.graves = held, {s: g for s, g in changes.graves.items() if s in ("data", "blobs")}
            changes.base["facts"] = {}
            if relations is not None:
                changes.put("relations", relations)
            if artifacts is not None:
                changes.put("artifacts", artifacts)
            written = self._graph(changes, concepts, None)
            facts = stored.fill(changes, self._searched(written)) if self.indexed else {}
            try:
                return changes.commit(**facts)
            except Conflict:
                continue

    def sync(self, scanned: DataFrame, relations: DataFrame | None = None, artifacts: DataFrame | None = None) -> dict:
        """Brings the collection up to ``scanned``; counts of documents added, updated, removed and skipped.
        ``relations`` and ``artifacts`` replace those stored; without them the stored ones stay."""
        while True:
            changes = self.versions.begin()
            if not changes.base["version"]:
                raise GridError("STORE_NOT_FOUND", f"nothing stored for {self.root!r}")
            counts, touched = self._change(changes, scanned, relations, artifacts)
            if not touched:
                return counts
            try:
                changes.commit(**changes.base["facts"])
            except Conflict:
                continue  # against the version that was faster
            self.versions.compact()
            return counts

    def _change(self, changes: Transaction, scanned: DataFrame, relations: DataFrame | None, artifacts: DataFrame | None) -> tuple[dict, bool]:
        was = changes.rows("concepts")
        # a scan may parse files: its keys are taken once, and whole rows only of what is written
        keys = cut(scanned.select("id", "path", "content_hash"))
        found = cut(sync.diff(was, keys))
        counts = sync.report(found).first().asDict()
        changed = counts["added"] + counts["updated"] + counts["removed"]
        if not changed and relations is None and artifacts is None:
            return counts, False
        gone = cut(was.select("id", "path").join(found.filter("action IN ('updated', 'removed')"), "path").select("id"))
        new = cut(keys.join(found.filter("action IN ('added', 'updated')"), "path", "left_semi").select("id"))
        # ids that come or go change what others' links lead to
        moved = gone.join(keys, "id", "left_anti").unionByName(new.join(was.select("id"), "id", "left_anti"))
        led = changes.rows("references").join(moved.select(F.col("id").alias("target")), "target", "left_semi").select("id")
        again = led.unionByName(new).unionByName(gone)
        if relations is not None:
            before = changes.rows("relations").select("id") if "relations" in changes.tables else relations.select("id").limit(0)
            again = again.unionByName(relations.select("id")).unionByName(before)
            changes.replace("relations", relations)
        again = cut(again.distinct())
        changes.bury("graph", again)
        rewritten = self._graph(changes, scanned.join(again, "id", "left_semi").select(*was.columns), keys.select("id"))
        if artifacts is not None:
            changes.replace("artifacts", artifacts)
        # enrichments and embeddings of changed documents stay until they are made anew
        lost = gone.join(keys, "id", "left_anti")
        for table in ("relations", "artifacts"):
            if table in changes.tables and counts["removed"]:
                changes.bury(table, lost)
        if "data" in changes.tables and counts["removed"]:
            changes.bury("data", changes.rows("data").join(lost, "id", "left_semi").select("owner"))
        if self.indexed and "postings" in changes.tables and changed:
            changes.base["facts"].update(stored.bury(changes, gone))
            changes.base["facts"].update(stored.fill(changes, self._searched(rewritten.join(new, "id", "left_semi"))))
        return counts, True
