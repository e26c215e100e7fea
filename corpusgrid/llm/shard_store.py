"""Sharding with size-tiered compaction and a versioned manifest.

``append`` writes arrivals as small immutable Parquet shards. ``compact`` gathers shards of similar
size (tiers, each ``FANOUT`` times the one before) and merges a tier's runs, once there are
``FANOUT`` of them, into files of about ``target`` bytes; repeated until no tier has enough. A merge
reads and writes without a shuffle, and its rows are counted against its inputs before anything is
committed.

A version is one manifest file that names its shards with their sizes, rows and tiers. It is written
under a temporary name and renamed to ``manifest/v<number>.json``; the rename fails if that version
exists, so of two writers one commits and the other starts again from the new version. Readers see
whole versions only.

A writer names the folder it is about to write in a record under ``pending`` and removes the record once
its version is committed or given up. ``vacuum`` removes what the versions kept do not name, but no
folder with a record younger than ``LEASE``: what a writer is writing, or has written and not yet
committed, stays. Records older than that are a lost writer's; a writer that outlives its lease
finds its record gone and fails before it commits.

All files are reached through Spark and Hadoop's file systems, and belong in a folder that all
executors share. Spark's own committer deals with lost executors while shards are written.

Defined results: null texts and ids are stored as they are; repeated rows keep their rows; an empty
table commits a version without shards, which reads as no rows with its columns; all columns are kept,
whatever their names.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs that a merge needs and sizes within a tier; rows of an arriving shard at most; the least
#: size that counts; bytes aimed at; merges at once; shards that one merge takes at most.
FANOUT, ARRIVAL_ROWS, LEAST, TARGET, MERGES, MOST = 4, 4000, 1 << 16, 128 << 20, 4, 4096
#: Seconds for which a writer's record keeps its folder.
LEASE = 24 * 3600


@dataclass(frozen=True)
class Shard:
    path: str
    size: int
    rows: int

    def folder(self) -> str:
        return self.path.rsplit("/", 2)[-2]

    def tier(self) -> int:
        return max(0, int(math.log(max(self.size, 1) / LEAST, FANOUT))) if self.size > LEAST else 0


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        where = self._fs.makeQualified(self._path(self.root)).toUri()
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where, conf)
        for name in ("manifest", "pending"):
            self._fs.mkdirs(self._path(f"{self.root}/{name}"))

    # -- manifest ---------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, T.StructType | None, list[Shard]]:
        """The version (latest if not given), its columns and its shards; version 0 is empty."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return 0, None, []
        stream = self._fs.open(self._path(self._manifest(version)))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        said = json.loads(text)
        return version, T.StructType.fromJson(said["schema"]), [Shard(**s) for s in said["shards"]]

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifest/v{version:09d}.json"

    def commit(self, base: int, schema: T.StructType, shards: list[Shard], new: list[Shard] = ()) -> int:
        """Version ``base + 1`` with these shards; ``Conflict`` if it exists. ``new`` are this writer's own."""
        if not all(self._fs.exists(self._path(self._record(f))) for f in {s.folder() for s in new}):
            raise RuntimeError("the lease ran out before the commit")
        said = json.dumps({"schema": schema.jsonValue(), "shards": [asdict(s) for s in sorted(shards, key=lambda s: s.path)]})
        temporary = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, False)
        stream.write(bytearray(said.encode()))
        stream.close()
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(temporary, self._path(self._manifest(base + 1)), none)
        except Exception as error:
            self._fs.delete(temporary, False)
            if base + 1 in self.versions():
                raise Conflict(f"version {base + 1} exists") from error
            raise
        return base + 1

    # -- shards -----------------------------------------------------------------------------------

    def _record(self, folder: str) -> str:
        return f"{self.root}/pending/{folder}"

    def _release(self, shards: list[Shard]) -> None:
        """The records of committed or abandoned shards go."""
        for folder in {s.folder() for s in shards}:
            self._fs.delete(self._path(self._record(folder)), False)

    def _written(self, folder: str) -> list[Shard]:
        sizes = {}
        for status in self._fs.listStatus(self._path(folder)):
            if status.getPath().getName().endswith(".parquet"):
                sizes[status.getPath().getName()] = int(status.getLen())
        if not sizes:
            return []
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        rows = dict(self.spark.read.parquet(folder).groupBy(name.alias("name")).count().collect())
        return [Shard(f"{folder}/{n}", s, rows[n]) for n, s in sorted(sizes.items()) if rows.get(n)]

    def _write(self, df: DataFrame, rows: int | None = None) -> list[Shard]:
        name = uuid.uuid4().hex
        record, folder = self._path(self._record(name)), f"{self.root}/data/{name}"
        self._fs.create(record, False).close()
        try:
            writer = df.write.option("maxRecordsPerFile", rows) if rows else df.write
            writer.parquet(folder)
            made = self._written(folder)
        except Exception:
            self._fs.delete(record, False)
            raise
        if not made:
            self._fs.delete(record, False)
        return made

    def append(self, df: DataFrame, rows: int = ARRIVAL_ROWS) -> int:
        """Arrivals as new shards; the version that holds them."""
        new = self._write(df, rows)
        while True:
            base, schema, shards = self.manifest()
            if schema is not None and schema.jsonValue() != df.schema.jsonValue():
                schema = self.read().unionByName(df.limit(0), allowMissingColumns=True).schema
            try:
                version = self.commit(base, schema or df.schema, shards + new, new)
            except Conflict:
                continue
            self._release(new)
            return version

    def plan(self, shards: list[Shard], target: int = TARGET) -> list[list[Shard]]:
        """Groups of similarly sized shards to merge; shards of over half the target are done."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.size <= target / 2:
                tiers.setdefault(s.tier(), []).append(s)
        groups = []
        for _, tier in sorted(tiers.items()):
            tier.sort(key=lambda s: (s.size, s.path))
            cut = [tier[i : i + MOST] for i in range(0, len(tier), MOST)]
            groups += [g for g in cut if len(g) >= FANOUT]
        return groups

    def _merge(self, schema: T.StructType, group: list[Shard], target: int) -> list[Shard]:
        df = self.spark.read.schema(schema).parquet(*[s.path for s in group])
        files = max(1, math.ceil(sum(s.size for s in group) / target))
        made = self._write(df.coalesce(files))
        if sum(s.rows for s in made) != sum(s.rows for s in group):
            self._release(made)
            raise RuntimeError("a merge lost rows")
        return made

    def compact(self, target: int = TARGET) -> int:
        """Merges until no tier has enough runs; the version reached."""
        while True:
            base, schema, shards = self.manifest()
            groups = self.plan(shards, target)
            if not groups:
                return base
            with ThreadPoolExecutor(MERGES) as pool:
                made = list(pool.map(lambda g: self._merge(schema, g, target), groups))
            replaced, new = {s.path for g in groups for s in g}, [s for m in made for s in m]
            try:
                self.commit(base, schema, [s for s in shards if s.path not in replaced] + new, new)
            except Conflict:
                pass  # merged again from the new version
            finally:
                self._release(new)

    def read(self, version: int | None = None) -> DataFrame:
        _, schema, shards = self.manifest(version)
        if not shards:
            return self.spark.createDataFrame([], schema or T.StructType())
        return self.spark.read.schema(schema).parquet(*[s.path for s in shards])

    def vacuum(self, keep: int = 1, lease: float = LEASE) -> int:
        """Removes manifests but the last ``keep``, and shards that those do not name; the count of files.

        The folders are listed first, then the records, then the versions: a folder without a live
        record by then is either named by a version that is read afterwards, or nobody's.
        """
        data, pending = self._path(f"{self.root}/data"), self._path(f"{self.root}/pending")
        folders = list(self._fs.listStatus(data)) if self._fs.exists(data) else []
        since = (time.time() - lease) * 1000
        writing = set()
        for record in self._fs.listStatus(pending):
            if record.getModificationTime() >= since:
                writing.add(record.getPath().getName())
            else:  # its writer, if it still runs, must not commit what goes now
                self._fs.delete(record.getPath(), False)
        versions = self.versions()
        named = {s.path for v in versions[-keep:] for s in self.manifest(v)[2]}
        for v in versions[:-keep]:
            self._fs.delete(self._path(self._manifest(v)), False)
        gone = 0
        for folder in folders:
            if folder.getPath().getName() in writing:
                continue
            files = [f for f in self._fs.listStatus(folder.getPath()) if f.getPath().getName().endswith(".parquet")]
            unnamed = [f for f in files if f"{self.root}/data/{folder.getPath().getName()}/{f.getPath().getName()}" not in named]
            gone += len(unnamed)
            if len(unnamed) == len(files):
                self._fs.delete(folder.getPath(), True)
            else:
                for f in unnamed:
                    self._fs.delete(f.getPath(), False)
        return gone
