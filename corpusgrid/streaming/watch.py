"""Watching a folder, and keeping a table in step with a stream of changes.

A file source only reports new files, so ``watch_folder`` uses a clock stream: each micro-batch writes a
listing of the folder if it differs from the last one, and tells the difference of the two. ``apply_stream``
folds a stream of rows into the latest state by key.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusgrid.operators import sync
from corpusgrid.runtime import cut, remove
from corpusgrid.sources import bundle

#: Fixed value: the pace of a watcher.
PACE = "500 milliseconds"


LISTING = "path string, modificationTime timestamp, length long, content_hash string"


def listed(spark: SparkSession, root: str) -> DataFrame:
    """path, modificationTime and length of the Markdown files that count, reserved ones left out; no content is read."""
    found = bundle.listed(spark, root, "*.md")
    return found.filter(~bundle.is_reserved(F.col("path"))).select("path", "modificationTime", "length")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path and content_hash of these files."""
    return whole_listing(spark, root).select("path", "content_hash")


def whole_listing(spark: SparkSession, root: str, known: DataFrame | None = None, now: DataFrame | None = None) -> DataFrame:
    """A listing (LISTING). Files that ``known``, an earlier one, has with the same time and length keep its hash;
    the contents of the others only are read, so a tick without changes reads none. ``now`` is what
    ``listed`` gave, if that is known."""
    marks = ["path", "modificationTime", "length"]
    def hashed(some):
        found = bundle.contents(some, root) if bundle.in_tasks(spark, root, "*.md") else bundle.files(spark, root, "*.md").join(some.select("path"), "path", "left_semi")
        return found.select(*marks, F.sha2("content", 256).alias("content_hash"))
    now = listed(spark, root) if now is None else now
    if known is None:
        return hashed(now)
    same = known.join(now, marks, "left_semi").select(*marks, "content_hash")
    # a file that was touched again meanwhile is listed as it is now
    return same.unionByName(hashed(now.join(same.select("path"), "path", "left_anti")))


def event_of(changes: DataFrame) -> dict:
    counts = dict(changes.groupBy("action").count().collect())
    return {"event": "sync", "at": datetime.now(UTC).isoformat(timespec="seconds"), **{k: counts.get(k, 0) for k in ("added", "updated", "removed")}, "errors": 0}


def tick(spark: SparkSession, root: str, stored: DataFrame) -> tuple[DataFrame, dict]:
    """The changes against ``stored`` (path, content_hash) and their event."""
    changes = sync.diff(stored, listing(spark, root)).filter("action <> 'skipped'")
    return changes, event_of(changes)


class Listings:
    """Listings as tables below one folder, numbered by micro-batch. Each is written whole before anything is told
    of it, and what is told is the difference of two written ones: an edit between them is in the later
    one or in the next, whenever it happens."""

    def __init__(self, spark: SparkSession, root: str, folder: str):
        self.spark, self.root, self.folder = spark, root, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Those written whole."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        found = [s.getPath() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(p.getName()) for p in found if self._fs.exists(self._path(p, "_SUCCESS")))

    def read(self, number: int) -> DataFrame:
        return self.spark.read.schema(LISTING).parquet(f"{self.folder}/{number}")

    def start(self) -> None:
        """The first listing, if there is none: what it holds counts as known."""
        if not self.numbers():
            whole_listing(self.spark, self.root).write.mode("overwrite").parquet(f"{self.folder}/0")

    def take(self, number: int) -> DataFrame | None:
        """The changes of a micro-batch, or None. A batch that runs again tells what it told; one without changes
        leaves no listing."""
        known = self.numbers()
        before = max(n for n in known if n < number)
        if number not in known:
            marks = ["path", "modificationTime", "length"]
            now, was = cut(listed(self.spark, self.root)), self.read(before)  # listed once
            same = now.join(was, marks, "left_anti").isEmpty() and was.join(now, "path", "left_anti").isEmpty()
            if same:
                return None
            whole_listing(self.spark, self.root, was, now).write.mode("overwrite").parquet(f"{self.folder}/{number}")
        changes = sync.diff(self.read(before), self.read(number)).filter("action <> 'skipped'")
        return None if changes.isEmpty() else changes

    def forget(self, number: int) -> None:
        """A batch's listing, where its changes could not be told: they are found again."""
        remove(self.spark, f"{self.folder}/{number}")

    def settle(self, number: int) -> None:
        """Listings before the one that a batch was compared with go."""
        before = max((n for n in self.numbers() if n < number), default=0)
        for n in self.numbers():
            if n < before:
                remove(self.spark, f"{self.folder}/{n}")


def watch_folder(spark: SparkSession, root: str, checkpoint: str, emit: Callable[[dict, DataFrame], None], pace: str = PACE) -> StreamingQuery:
    """Calls ``emit`` with an event and its changes for each micro-batch that has some; one sync covers all edits
    of a tick. A watch that starts again on its checkpoint goes on from its last listing, so changes made
    meanwhile are told. An error, of the listing or of ``emit``, is an event itself; the changes come again."""
    listings = Listings(spark, root, f"{checkpoint.rstrip('/')}/listings")
    listings.start()

    def each(_: DataFrame, batch: int) -> None:
        number = batch + 1
        try:
            changes = listings.take(number)
            if changes is not None:
                emit(event_of(changes), changes)
            listings.settle(number)
        except Exception as error:  # the next tick tries again
            listings.forget(number)
            emit({"event": "sync", "at": datetime.now(UTC).isoformat(timespec="seconds"), "errors": 1, "message": str(error)[:500]}, None)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=pace).start()


def keep_synced(spark: SparkSession, root: str, store: str, checkpoint: str, told: Callable[[dict], None] = lambda report: None, pace: str = PACE) -> StreamingQuery:
    """A stored collection that follows its folder: synced at the start, and whenever a tick finds changes.
    ``told`` gets each sync's counts, or an error's event."""
    from corpusgrid.engine import Engine

    def follow(event: dict, changes: DataFrame | None) -> None:
        told(event if changes is None else Engine.parse(spark, root).sync(store))

    # the listing is older than the sync, so an edit during it is found by the first tick
    Listings(spark, root, f"{checkpoint.rstrip('/')}/listings").start()
    told(Engine.parse(spark, root).sync(store))
    return watch_folder(spark, root, checkpoint, follow, pace)


def event_line(event: dict) -> str:
    return json.dumps(event, sort_keys=True)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key (of rows that tie, the one with the largest other columns)."""
    rest = [order, *(c for c in rows.columns if c not in (key, order))]
    last = rows.groupBy(key).agg(F.max(F.struct(*rest)).alias("_last"))
    return last.select(*[F.col(c) if c == key else F.col("_last")[c].alias(c) for c in rows.columns])


def fold_batch(state: DataFrame, batch: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """The state after a micro-batch of rows, and what it added, updated or left."""
    new = latest(batch, key, order)
    marks = new.select(key, F.col(order).alias("_now")).join(state.select(key, F.col(order).alias("_was")), key, "left")
    changes = marks.select(key, F.when(F.col("_was").isNull(), "added").when(F.col("_now") > F.col("_was"), "updated").otherwise("skipped").alias("action"))
    return latest(state.unionByName(new), key, order), changes


def apply_stream(stream: DataFrame, key: str, order: str, state_path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the last row of each key at ``state_path``/<batch>; the latest complete batch is the state.

    Batches are written whole under their own number, so a batch that is run again after a failure
    writes the same folder again; older folders than the one that it reads go.
    """
    spark = stream.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        was = spark.read.parquet(f"{state_path}/{number - 1}") if number else batch.limit(0)
        fold_batch(was, batch, key, order)[0].write.mode("overwrite").parquet(f"{state_path}/{number}")
        if number > 1:
            remove(spark, f"{state_path}/{number - 2}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, time: str, width: str, *by: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of ``value`` in windows (an extra); late rows wait as long as the watermark says."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("window_start"), *by, "events", "total")


def sessions(events: DataFrame, time: str, gap: str, *by: str, late: str = "10 minutes") -> DataFrame:
    """Runs of events no further apart than ``gap`` (an extra)."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("events")).select(
        F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "events")
