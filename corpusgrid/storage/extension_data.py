"""Extension data of a stored collection: metadata rows, and bytes by their SHA-256.

Both are tables of the collection's version record, so data and what refers to it become visible together. Bytes
are hashed by the tasks that write them and held against the metadata; equal bytes are kept once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.errors import GridError
from corpusgrid.runtime import cut
from corpusgrid.storage.collection import Collection
from corpusgrid.storage.versions import Conflict

#: Items of one document and extension, bytes of an item, of all of them, of an item's metadata.
ITEMS, EACH, TOTAL, METADATA = 256, 32 << 20, 256 << 20, 8 << 10
COLUMNS = ("extension", "id", "key", "sha256", "size", "media_type", "metadata")


def _measured(items: DataFrame) -> DataFrame:
    content = F.col("content")
    given = items.select("extension", "id", "key", "media_type", F.coalesce("metadata", F.lit("{}")).alias("metadata"), "content", *(["sha256"] if "sha256" in items.columns else []))
    own = F.sha2(content, 256)
    return given.withColumns({"own": own, "size": F.octet_length(content).cast("long"), "sha256": F.coalesce("sha256", own) if "sha256" in items.columns else own})


def put(kept: Collection, items: DataFrame) -> int:
    """Stores ``items`` (extension, id, key, media_type, metadata, content, perhaps the sha256 that is expected): all
    data of an extension and document is replaced by what is given for them. The version reached."""
    held = _measured(items)
    by = held.groupBy("extension", "id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("keys"), F.sum("size").alias("total"), F.max("size").alias("most"),
        F.max(F.octet_length("metadata")).alias("told"), F.count_if(F.col("own") != F.col("sha256")).alias("wrong"))
    bad = by.filter((F.col("n") > ITEMS) | (F.col("keys") < F.col("n")) | (F.col("total") > TOTAL) | (F.col("most") > EACH) | (F.col("told") > METADATA) | (F.col("wrong") > 0)).first()
    if bad is not None:
        why = "bytes differ from their digest" if bad["wrong"] else "keys repeat" if bad["keys"] < bad["n"] else "data is too large"
        raise GridError("INVALID_REQUEST", f"{bad['extension']!r} of {bad['id']!r}: {why}")
    while True:
        changes = kept.versions.begin()
        rows = held.withColumn("owner", F.concat_ws("\0", "extension", "id"))
        if "data" in changes.tables:
            changes.bury("data", rows.select("owner"))
        changes.put("data", rows.select("owner", *COLUMNS))
        bytes_ = held.select("sha256", "content").dropDuplicates(["sha256"])
        if "blobs" in changes.tables:
            bytes_ = bytes_.join(changes.rows("blobs").select("sha256"), "sha256", "left_anti")
        changes.put("blobs", bytes_)
        try:
            return changes.commit()
        except Conflict:
            continue


def remove(kept: Collection, owners: DataFrame) -> int:
    """Takes out all data of ``owners`` (extension, id); the version reached. Bytes stay until they are swept."""
    while True:
        changes = kept.versions.begin()
        changes.bury("data", owners.select(F.concat_ws("\0", "extension", "id").alias("owner")))
        try:
            return changes.commit()
        except Conflict:
            continue


def listed(kept: Collection, extension: str | None = None, document=None) -> DataFrame:
    """Metadata rows, of one extension or document if named, by extension, document and key."""
    rows = kept.read("data").select(*COLUMNS)
    if extension is not None:
        rows = rows.filter(F.col("extension") == extension)
    if document is not None:
        rows = rows.filter(F.col("id") == document)
    return rows.orderBy("extension", "id", "key")


def fetched(kept: Collection, wanted: DataFrame) -> DataFrame:
    """``wanted`` rows of ``listed`` with their bytes, hashed again: ``content`` is null and ``warning`` says so where
    bytes are missing or changed."""
    blobs = kept.read("blobs").select("sha256", F.col("content").alias("_bytes"))
    joined = wanted.join(blobs, "sha256", "left")
    sound = F.coalesce(F.sha2("_bytes", 256) == F.col("sha256"), F.lit(False))
    said = F.when(F.col("_bytes").isNull(), "bytes are missing").when(~sound, "bytes differ from their digest")
    return joined.select(*wanted.columns, F.when(sound, F.col("_bytes")).alias("content"), said.alias("warning"))


def collect_garbage(kept: Collection, dry: bool = False) -> int:
    """Takes out bytes that no metadata row names; their number."""
    while True:
        changes = kept.versions.begin()
        if "blobs" not in changes.tables:
            return 0
        loose = cut(changes.rows("blobs").select("sha256").join(changes.rows("data").select("sha256"), "sha256", "left_anti"))
        n = loose.count()
        if dry or not n:
            return n
        changes.bury("blobs", loose)
        try:
            changes.commit()
        except Conflict:
            continue
        kept.versions.compact()
        return n
