"""Several tables under one version record.

A table is a list of segments, Parquet folders that are never changed. A transaction writes new segments
and commits them by one JSON record, ``versions/v<number>.json``, renamed into place: the rename fails if that
version exists, so of two writers one gets a ``Conflict``. A reader pins a record and sees its tables as they
belong together, whatever is committed meanwhile; a table that lost its last row is as much a version
as any other.

Tables of one space share tombstones: keys that a version removed or wrote anew. A row lives unless a later
version has a tombstone for its key, so a change writes its own rows and the keys it replaces, nothing else.
``compact`` writes the live rows of small segments as one, all segments once a quarter of the rows is dead.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Segments of a table from which small ones are merged; a segment is small beside the largest below this
#: share of its bytes; dead rows (tombstones for each row) from which all are written anew.
SEGMENTS, SMALL, DEAD = 8, 0.25, 0.25
#: Tombstones that may be broadcast; beyond that they meet the rows in a shuffle.
BROADCAST = 200_000
#: Seconds after which files that no version names are a lost writer's.
LEASE = 24 * 3600


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class Versions:
    """``spaces`` gives each table the name of its space, ``keys`` the tombstone's column where it is not ``id``."""

    def __init__(self, spark: SparkSession, root: str, spaces: dict[str, str], keys: dict[str, str] | None = None):
        self.spark, self.root, self.spaces, self.keys = spark, root.rstrip("/"), spaces, keys or {}
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        where = self._fs.makeQualified(self._path(self.root)).toUri()
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where, conf)

    # -- records ----------------------------------------------------------------------------------

    def numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def record(self, version: int | None = None) -> dict:
        """A version's record, the latest if none is named; version 0 has no tables."""
        version = max(self.numbers(), default=0) if version is None else version
        if not version:
            return {"version": 0, "tables": {}, "tombstones": {}, "facts": {}}
        stream = self._fs.open(self._path(self._name(version)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _name(self, version: int) -> str:
        return f"{self.root}/versions/v{version:09d}.json"

    def _commit(self, record: dict) -> None:
        folder = self._path(f"{self.root}/versions")
        self._fs.mkdirs(folder)
        temporary = self._path(f"{self.root}/versions/.{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, False)
        stream.write(bytearray(json.dumps(record).encode()))
        stream.close()
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(temporary, self._path(self._name(record["version"])), none)
        except Exception as error:
            self._fs.delete(temporary, False)
            if record["version"] in self.numbers():
                raise Conflict(f"version {record['version']} exists") from error
            raise

    # -- reading ----------------------------------------------------------------------------------

    def has(self, record: dict, table: str) -> bool:
        return bool(record["tables"].get(table))

    def read(self, record: dict, table: str) -> DataFrame:
        """The live rows of a table. Segments with nothing dead in them are read without a join."""
        key, segments = self.keys.get(table, "id"), record["tables"][table]
        graves = record["tombstones"].get(self.spaces[table], [])
        clean, stale = [], []
        for s in segments:
            (stale if any(g["version"] > s["version"] for g in graves) else clean).append(s)
        parts = [self._open(s) for s in clean]
        if stale:
            rows = [self._open(s).withColumn("_made", F.lit(s["version"])) for s in stale]
            least = min(s["version"] for s in stale)
            late = [g for g in graves if g["version"] > least]
            dead = _union([self._open(g).select(F.col("key").alias("_key"), F.lit(g["version"]).alias("_gone")) for g in late])
            if sum(g["rows"] for g in late) <= BROADCAST:
                dead = F.broadcast(dead)
            every = _union(rows)
            parts.append(every.join(dead, (F.col(key) == F.col("_key")) & (F.col("_made") < F.col("_gone")), "left_anti").drop("_made"))
        return _union(parts)

    def _open(self, segment: dict) -> DataFrame:
        # the schema is known, so no file is opened to find it
        return self.spark.read.schema(T.StructType.fromJson(segment["schema"])).parquet(f"{self.root}/data/{segment['folder']}")

    # -- writing ----------------------------------------------------------------------------------

    def begin(self) -> Transaction:
        return Transaction(self, self.record())

    def compact(self) -> int:
        """Merges what has too many segments or too many dead rows; the version reached. It commits like any
        other writer, and starts again where one was faster."""
        while True:
            changes = self.begin()
            for table in sorted(self.spaces):
                changes.merge(table)
            if not changes.made:
                return changes.base["version"]
            try:
                return changes.commit()
            except Conflict:
                continue

    def vacuum(self, keep: int = 1, lease: float = LEASE) -> int:
        """Removes all records but the last ``keep``, and folders that those do not name and that are older than
        the lease; the count of folders. Folders are listed before the records are read."""
        data = self._path(f"{self.root}/data")
        if not self._fs.exists(data):
            return 0
        old = [f for f in self._fs.listStatus(data) if f.getModificationTime() < (time.time() - lease) * 1000]
        numbers = self.numbers()
        named = set()
        for n in numbers[-keep:]:
            record = self.record(n)
            named |= {s["folder"] for found in (*record["tables"].values(), *record["tombstones"].values()) for s in found}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(self._name(n)), False)
        gone = [f.getPath() for f in old if f.getPath().getName() not in named]
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)


class Transaction:
    """New segments on top of the version it began with."""

    def __init__(self, versions: Versions, base: dict):
        self.versions, self.base = versions, base
        self.number = base["version"] + 1
        self.tables = {name: list(segments) for name, segments in base["tables"].items()}
        self.graves = {space: list(found) for space, found in base["tombstones"].items()}
        self.made: list[dict] = []

    def _segment(self, df: DataFrame) -> dict:
        folder = uuid.uuid4().hex
        place = f"{self.versions.root}/data/{folder}"
        df.write.option("parquet.writer.version", "PARQUET_2_0").option("compression", "zstd").parquet(place)
        files = self.versions._fs.listStatus(self.versions._path(place))
        size = sum(int(f.getLen()) for f in files if f.getPath().getName().endswith(".parquet"))
        made = {"folder": folder, "version": self.number, "bytes": size, "schema": df.schema.jsonValue()}
        made["rows"] = self.versions._open(made).count()  # from the files' footers
        self.made.append(made)
        return made

    def put(self, table: str, df: DataFrame) -> dict:
        """Rows added to a table."""
        made = self._segment(df)
        self.tables.setdefault(table, []).append(made)
        return made

    def replace(self, table: str, df: DataFrame) -> dict:
        """The table's only rows."""
        self.tables[table] = []
        return self.put(table, df)

    def bury(self, space: str, keys: DataFrame) -> None:
        """Rows of these keys (one column) that earlier versions wrote are dead."""
        made = self._segment(keys.toDF("key").distinct())
        if made["rows"]:
            self.graves.setdefault(space, []).append(made)

    def rows(self, table: str) -> DataFrame:
        """The table as this transaction leaves it."""
        return self.versions.read({"tables": self.tables, "tombstones": self.graves}, table)

    def keys_of(self, table: str) -> int:
        """Rows of the space's table that has the fewest, about one for each key."""
        space = self.versions.spaces[table]
        return min(sum(s["rows"] for s in self.tables[t]) for t in self.tables if self.versions.spaces[t] == space)

    def merge(self, table: str) -> None:
        segments = self.tables.get(table, [])
        graves = self.graves.get(self.versions.spaces[table], [])
        if not segments:
            return
        dead = sum(g["rows"] for g in graves)
        if dead and dead >= DEAD * self.keys_of(table):
            chosen = segments
        elif len(segments) > SEGMENTS:
            most = max(s["bytes"] for s in segments)
            small = [s for s in segments if s["bytes"] < SMALL * most]
            chosen = small if len(small) > 1 else segments
        else:
            return
        live = self.versions.read({"tables": {table: chosen}, "tombstones": self.graves}, table)
        merged = self._segment(_like(live, table))
        self.tables[table] = [s for s in segments if s not in chosen] + [merged]

    def commit(self, **facts) -> int:
        """All of it becomes the next version."""
        held = {}
        for space, found in self.graves.items():
            tables = [s for t, name in self.versions.spaces.items() if name == space for s in self.tables.get(t, [])]
            oldest = min((s["version"] for s in tables), default=self.number)
            held[space] = [g for g in found if g["version"] > oldest]  # others have nothing left to bury
        self.versions._commit({"version": self.number, "tables": self.tables, "tombstones": held, "facts": {**self.base["facts"], **facts}})
        return self.number


#: Columns by which a table's segments are sorted, so that a lookup prunes row groups.
ORDER: dict[str, tuple[str, ...]] = {}


def _like(df: DataFrame, table: str) -> DataFrame:
    keys = ORDER.get(table)
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    first, *rest = parts
    for df in rest:
        first = first.unionByName(df)
    return first
