"""A workspace: named sources, each a stored collection, and a registry of their states.

The manifest is YAML, ``{version: 1, index: FOLDER, sources: {ALIAS: FOLDER or {path: FOLDER}}}``, with paths relative to
it. ``reconcile`` brings the store up to it: new sources are ingested, known ones synced, sources that are gone
leave the registry. One that fails is degraded; the others go on, and its last good version stays readable.
"""

from __future__ import annotations

import hashlib
import posixpath
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusgrid.engine import Engine
from corpusgrid.errors import GridError
from corpusgrid.operators import federation
from corpusgrid.storage.collection import Collection
from corpusgrid.storage.versions import Conflict, Versions

#: The manifest's version; aliases that no source may have; the pace at which a manifest is looked at.
VERSION, RESERVED, PACE = 1, ("contract", "workspace"), "2 seconds"


@dataclass(frozen=True)
class Manifest:
    index: str
    sources: dict[str, str]
    digest: str


def parse_manifest(text: str, folder: str) -> Manifest:
    """A manifest's text; relative paths are under ``folder``."""
    import yaml

    try:
        said = yaml.safe_load(text)
    except yaml.YAMLError as error:
        raise GridError("INVALID_REQUEST", f"the manifest is no YAML: {type(error).__name__}") from error
    if not isinstance(said, dict) or said.get("version") != VERSION:
        raise GridError("INVALID_REQUEST", f"a manifest has version {VERSION}")
    def whole(path):
        return path if path.startswith("/") or "://" in path else posixpath.normpath(posixpath.join(folder, path))
    listed = said.get("sources") or {}
    specs = {str(a): s.get("path") if isinstance(s, dict) else s for a, s in listed.items()} if isinstance(listed, dict) else {}
    if any(not isinstance(p, str) or not p for p in specs.values()) or set(specs) & set(RESERVED):
        raise GridError("INVALID_REQUEST", "a source has a path and an alias that is not reserved")
    sources = federation.parse_sources([f"{a}={whole(p)}" for a, p in sorted(specs.items())]) if specs else {}
    return Manifest(whole(str(said.get("index") or "index")), sources, hashlib.sha256(text.encode()).hexdigest())


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    rows = spark.read.text(path, wholetext=True).collect()  # one file
    if not rows:
        raise GridError("INVALID_REQUEST", f"no manifest at {path!r}")
    return parse_manifest(rows[0][0], posixpath.dirname(path))


class Workspace:
    """``open_`` makes an engine of a source's path; folders of Markdown if none is given."""

    def __init__(self, spark: SparkSession, manifest: Manifest, open_: Callable[[SparkSession, str], Engine] | None = None):
        self.spark, self.manifest, self.open = spark, manifest, open_ or Engine.parse
        self.states = Versions(spark, f"{manifest.index}/registry", {"sources": "sources"})

    def registry(self) -> DataFrame:
        """federation.REGISTRY rows: alias, path, status, generation, last_synced, content_hash."""
        record = self.states.record()
        return self.states.read(record, "sources") if self.states.has(record, "sources") else self.spark.createDataFrame([], federation.REGISTRY)

    def collection(self, alias: str) -> Collection:
        if alias not in self.manifest.sources:
            raise GridError("SOURCE_NOT_FOUND", f"no source {alias!r}")
        return Collection(self.spark, self.manifest.index, self.manifest.sources[alias])

    def reconcile(self) -> DataFrame:
        """A row for each source: alias, status, added, updated, removed, skipped, message."""
        told, news, now = [], [], int(time.time())
        for alias, path in sorted(self.manifest.sources.items()):
            try:
                engine, kept = self.open(self.spark, path), self.collection(alias)
                if kept.versions.numbers():
                    counts = kept.sync(engine.concepts, engine.relations)
                else:
                    kept.ingest(engine.concepts, engine.relations)
                    counts = {"added": kept.read("concepts").count(), "updated": 0, "removed": 0, "skipped": 0}
                told.append((alias, "ready", *(counts[k] for k in ("added", "updated", "removed", "skipped")), None))
                news.append((alias, path, "ready", None, now, self._digest(kept)))
            except Exception as error:
                told.append((alias, "degraded", 0, 0, 0, 0, f"{type(error).__name__}: {error}"[:300]))
                news.append((alias, path, "degraded", None, None, None))
        self._register(self.spark.createDataFrame(news, federation.REGISTRY))
        return self.spark.createDataFrame(told, "alias string, status string, added long, updated long, removed long, skipped long, message string")

    @staticmethod
    def _digest(kept: Collection) -> str:
        """One digest of all content hashes, whatever their order: the sum of numbers made from them."""
        part = F.conv(F.substr(F.sha2(F.concat_ws("\0", "path", "content_hash"), 256), F.lit(1), F.lit(15)), 16, 10).cast("decimal(38,0)")
        return str(kept.read("concepts").agg(F.coalesce(F.sum(part), F.lit(0).cast("decimal(38,0)"))).first()[0])

    def _register(self, news: DataFrame) -> None:
        while True:
            changes = self.states.begin()
            old = changes.rows("sources") if "sources" in changes.tables else self.spark.createDataFrame([], federation.REGISTRY)
            kept = federation.prune_sources(old, sorted(self.manifest.sources))
            # what a degraded source was synced to last stays known
            was = kept.select("alias", F.col("last_synced").alias("_synced"), F.col("content_hash").alias("_hash"))
            known = news.join(was, "alias", "left").withColumns({"last_synced": F.coalesce("last_synced", "_synced"), "content_hash": F.coalesce("content_hash", "_hash")}).select(*news.columns)
            changes.replace("sources", federation.upsert_sources(kept, known).coalesce(1))  # a row for each source
            try:
                changes.commit(manifest=self.manifest.digest)
                return
            except Conflict:
                continue

    def stats(self) -> DataFrame:
        """A row for each source that is stored: alias, documents, edges, dangling, tokens; and their sums (``*``)."""
        rows = []
        for alias in sorted(self.manifest.sources):
            kept = self.collection(alias)
            if kept.versions.numbers():
                record = kept.snapshot()
                edges = kept.read("edges", record).agg(F.count_if(~F.col("dangling")), F.count_if("dangling")).first()
                rows.append((alias, kept.read("concepts", record).count(), edges[0], edges[1], int(record["facts"].get("tokens", 0))))
        totals = tuple(sum(r[i] for r in rows) for i in range(1, 5))
        return self.spark.createDataFrame([*rows, ("*", *totals)], "alias string, documents long, edges long, dangling long, tokens long")

    def search(self, query: str, mode: str = "bm25", top_k: int = 10) -> tuple[DataFrame, DataFrame]:
        """(ranking over the stored indexes of all sources, status of each): source, id, score."""
        def asked(kept: Collection) -> DataFrame:
            hits = getattr(kept.index(), mode)(query, top_k)
            score = "total_score" if "total_score" in hits.columns else "score"
            return hits.select("id", F.col(score).alias("score"))
        if mode not in ("keyword", "fuzzy", "bm25", "hybrid_keyword", "hybrid_bm25"):
            raise GridError("INVALID_MODE", f"no stored ranking {mode!r}")
        sources = {a: (lambda a=a: asked(self.collection(a))) for a in self.manifest.sources}
        return federation.search_isolated(self.spark, sources, lambda hits: hits, top_k)


def follow(spark: SparkSession, path: str, checkpoint: str, told: Callable[[DataFrame], None], open_=None, pace: str = PACE) -> StreamingQuery:
    """Reconciles whenever the manifest's text changes, and once at the start; a manifest that cannot be read is
    looked at again."""
    def each(_: DataFrame, __: int) -> None:
        try:
            manifest = read_manifest(spark, path)
            space = Workspace(spark, manifest, open_)
            if space.states.record()["facts"].get("manifest") != manifest.digest:
                told(space.reconcile())
        except GridError:
            return

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=pace).start()
