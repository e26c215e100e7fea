"""A folder of Markdown files as DataFrames.

Folders that tasks can open are listed and read by tasks, with as many tasks as cores whatever the number of
files; any other store that Spark reads goes through its ``binaryFile`` source. Files are parsed vectorised on the executors. Root ``index.md`` is the index; nested ones and ``log.md``
are left out, as are ``.git``, ``node_modules`` and other names that start with a dot.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from fnmatch import fnmatchcase
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgrid.runtime import BATCH_BYTES, ship
from corpusgrid.sources import markdown

#: Rows of a batch at most.
ROWS = 2_000
#: What a listing and a reading of files give; times in milliseconds.
LISTED = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.LongType()), T.StructField("length", T.LongType())])
FILE = T.StructType([*LISTED.fields, T.StructField("content", T.BinaryType())])
LINK = T.StructType([T.StructField(n, T.StringType()) for n in ("raw", "target", "resolved")])
_TEXTS, _LISTS = ("type", "title", "description", "status", "policy", "key_id", "frontmatter", "body"), ("keywords", "tags", "related", "warnings")
CONCEPT = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("path", T.StringType())]
    + [T.StructField(n, T.BooleanType()) for n in ("is_concept", "has_frontmatter", "has_type", "has_keywords")]
    + [T.StructField(n, T.StringType()) for n in _TEXTS]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in _LISTS]
    + [T.StructField("links", T.ArrayType(LINK)), T.StructField("content_hash", T.StringType()), T.StructField("size", T.LongType())]
)


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path (relative to ``root``), modificationTime, length and content of the files that count."""
    kept = listed(spark, root, pattern)
    return contents(kept, root) if in_tasks(spark, root, pattern) else kept


def listed(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """The same without reading any content. Folders that tasks can open are listed by a task, entry by entry, and the
    driver holds none of them; other stores by Spark's ``binaryFile`` source, which keeps ``content`` for who selects it."""
    if in_tasks(spark, root, pattern):
        names = LISTED.fieldNames()

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for folder in batch["root"]:
                    entries = entries_of(local(folder), pattern)
                    while part := list(islice(entries, ROWS)):
                        yield pd.DataFrame(part, columns=names)

        ship(spark)
        found = spark.range(0, 1, 1, 1).select(F.lit(root).alias("root")).mapInPandas(walk, LISTED)
        found = found.withColumn("modificationTime", F.timestamp_millis("modificationTime"))
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
        base = F.lit(root.rstrip("/").removeprefix("file://") + "/")
        plain = F.regexp_replace("path", "^[a-z]+:(//[^/]*)?(?=/)", "")
        found = found.withColumn("path", F.substr(plain, F.locate(root.rstrip("/").removeprefix("file://") + "/", plain) + F.length(base)))
    ignored = F.exists(F.split("path", "/"), lambda p: p.startswith(".") | (p == "node_modules"))
    return found.filter(~ignored)


def contents(found: DataFrame, root: str) -> DataFrame:
    """Files (path) of a folder that tasks can open, as they are when they are read: path, modificationTime, length
    and content. Names are dealt over all cores, a batch holds a few megabytes."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for path in batch["path"]:
                with open(f"{local(root)}/{path}", "rb") as file:
                    content = file.read()
                    rows.append((path, os.fstat(file.fileno()).st_mtime_ns // 1_000_000, len(content), content))
                held += len(content)
                if held >= BATCH_BYTES or len(rows) >= ROWS:
                    yield pd.DataFrame(rows, columns=FILE.fieldNames())
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=FILE.fieldNames())

    spark = found.sparkSession
    ship(spark)
    dealt = found.select("path").repartition(spark.sparkContext.defaultParallelism, "path")
    return dealt.mapInPandas(read, FILE).withColumn("modificationTime", F.timestamp_millis("modificationTime"))


def local(root: str) -> str:
    return re.sub("^file:(//)?(?=/)", "", root).rstrip("/")


def in_tasks(spark: SparkSession, root: str, pattern: str = "*") -> bool:
    """Whether ``root`` is a folder of the file system that tasks see too, and the pattern one of names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.getUri().getScheme() == "file" and store.exists(path) and store.getFileStatus(path).isDirectory() and not set(pattern) & set("{[\\")


def entries_of(folder: str, pattern: str, below: str = "") -> Iterator[tuple[str, int, int]]:
    """path, time (ms) and length of the files below a folder, one by one; names that Spark's sources hide are left out."""
    with os.scandir(f"{folder}/{below}") as entries:
        for entry in entries:
            if entry.name.startswith((".", "_")) or entry.name.endswith("._COPYING_"):
                continue
            if entry.is_dir():
                yield from entries_of(folder, pattern, f"{below}{entry.name}/")
            elif fnmatchcase(entry.name, pattern):
                stat = entry.stat()
                yield below + entry.name, stat.st_mtime_ns // 1_000_000, stat.st_size


def parse_files(scanned: DataFrame, permissive: bool = False) -> DataFrame:
    """Rows of (path, content, length) parsed, whatever listed them."""
    names = CONCEPT.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, digest, size in zip(batch["path"], batch["content"], batch["content_hash"], batch["size"], strict=True):
                row = markdown.parse_concept(path, bytes(content), permissive) | {"content_hash": digest, "size": size}
                rows.append([row.get(n) for n in names])
            yield pd.DataFrame(rows, columns=names)

    ship(scanned.sparkSession)
    fields = scanned.select("path", "content", F.sha2("content", 256).alias("content_hash"), F.col("length").cast("long").alias("size"))
    return fields.mapInPandas(run, CONCEPT)


def is_reserved(path):
    return (path == "index.md") | path.endswith("/index.md") | (path == "log.md") | path.endswith("/log.md")


def parse(spark: SparkSession, root: str, permissive: bool = False) -> DataFrame:
    """Every Markdown file but the reserved ones: concepts, and files that are none with their warnings."""
    return parse_files(files(spark, root, "*.md").filter(~is_reserved(F.col("path"))), permissive)


def parse_cached(spark: SparkSession, root: str, snapshot: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(parsed, snapshot to store): only files whose path, time or length changed since ``snapshot`` are
    parsed again. The listing reads no content; contents of changed files only are fetched."""
    found = listed(spark, root, "*.md").filter(~is_reserved(F.col("path")))
    def read(some):
        return contents(some, root) if in_tasks(spark, root, "*.md") else some
    if snapshot is None:
        made = parse_files(read(found))
    else:
        same = snapshot.select("path", "modificationTime", F.col("size").alias("length"))
        fresh = parse_files(read(found.join(same, ["path", "modificationTime", "length"], "left_anti")))
        kept = snapshot.withColumnRenamed("size", "length").join(found.select("path", "modificationTime", "length"), ["path", "modificationTime", "length"], "left_semi")
        made = kept.withColumnRenamed("length", "size").select(*CONCEPT.fieldNames()).unionByName(fresh)
    times = found.select("path", "modificationTime")
    return made, made.join(times, "path")


def concepts(parsed: DataFrame) -> DataFrame:
    """The concepts with ``links`` resolved against each other, by one join of link targets and ids."""
    found = parsed.filter("is_concept").drop("is_concept")
    ids = found.select(F.col("id").alias("aim")).distinct()
    rows = found.select("id", F.posexplode("links").alias("seq", "link")).withColumn("aim", F.regexp_replace("link.resolved", r"\.md$", ""))
    known = rows.join(ids.withColumn("known", F.lit(True)), "aim", "left").select(
        "id", "seq", F.struct("link.raw", "link.target", "link.resolved", F.coalesce("known", F.lit(False)).alias("resolves_in_bundle")).alias("link"))
    lists = known.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seq", "link"))).alias("l")).select("id", F.transform("l", lambda x: x["link"]).alias("links"))
    empty = F.array().cast("array<struct<raw:string,target:string,resolved:string,resolves_in_bundle:boolean>>")
    return found.drop("links").join(lists, "id", "left").withColumn("links", F.coalesce("links", empty))


def validation(parsed: DataFrame) -> DataFrame:
    return parsed.select("id", "has_frontmatter", "has_type", "has_keywords", "warnings")


def index(spark: SparkSession, root: str) -> tuple[DataFrame, list[str]]:
    """Entries (title, target, description) of the root index, and the collection's warnings.

    The index is one file, read on the driver.
    """
    first = listed(spark, root, "*.md").filter("path = 'index.md'")
    rows = (contents(first, root) if in_tasks(spark, root, "*.md") else first).select("content").limit(1).collect()
    entries, version, error = markdown.parse_index(bytes(rows[0][0])) if rows else ([], None, None)
    warnings = [error] if error else []
    if version is not None and version != markdown.SUPPORTED:
        warnings.append(f"unsupported okf_version: {version}")
    if listed(spark, root, "*.md").filter(~is_reserved(F.col("path"))).limit(1).isEmpty():
        warnings.append("empty bundle: no concept files found")
    schema = "title string, target string, description string"
    return spark.createDataFrame([(e["title"], e["target"], e["description"]) for e in entries], schema), warnings
