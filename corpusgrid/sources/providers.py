"""Sources given by registered callables instead of folders.

A provider answers with documents, relations, consumed paths and artifacts. It becomes a data source of Spark
whose parts are asked, bounded and checked in tasks of their own, and DataFrames that
``operators.export.synthetic_merge`` takes.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusgrid.errors import GridError
from corpusgrid.runtime import cut, ship

#: Bounds of one answer (of a part, where a provider has several), and the form of a relation's kind.
DOCUMENTS, RELATIONS, ARTIFACTS, KIND = 1000, 5000, 100, re.compile("[a-z][a-z0-9_]{0,63}")
PROVIDERS: dict[str, Callable[..., dict]] = {}
PARTS: dict[str, Callable[[str], list[str]]] = {}
#: What a refused answer's error begins with.
REFUSED = "EXTENSION_INVALID"


def register_provider(name: str, call: Callable[..., dict], parts: Callable[[str], list[str]] | None = None) -> None:
    """``call(root)`` gives an answer; with ``parts``, ``call(root, part)`` gives one for each part that
    ``parts(root)`` names, in a task of its own."""
    PROVIDERS[name] = call
    PARTS.pop(name, None)
    if parts:
        PARTS[name] = parts


def safe_path(path: str) -> bool:
    return bool(path) and not path.startswith("/") and posixpath.normpath(path) == path and not path.startswith("..")


def _checked(said: dict) -> list[tuple[str, str]]:
    """An answer as (kind, JSON) rows, or a refusal: bounds, ids, kinds and paths."""
    documents, relations, consumed, artifacts = (said.get(k, []) for k in ("documents", "relations", "consumed", "artifacts"))
    if len(documents) > DOCUMENTS or len(relations) > RELATIONS or len(artifacts) > ARTIFACTS:
        raise ValueError(f"{REFUSED}: an answer holds too much")
    if any(not d["id"].startswith("_") for d in documents):
        raise ValueError(f"{REFUSED}: ids start with _")
    if any(not KIND.fullmatch(r["kind"]) for r in relations) or not all(map(safe_path, [*consumed, *(a["path"] for a in artifacts)])):
        raise ValueError(f"{REFUSED}: a kind or path is not allowed")
    rows = [("documents", {"id": d["id"], "title": d.get("title"), "body": d.get("body", "")}) for d in documents]
    rows += [("relations", {"id": r["from"], "to": r["to"], "kind": r["kind"], "seq": i}) for i, r in enumerate(relations)]
    rows += [("consumed", {"path": p}) for p in consumed]
    rows += [("artifacts", {"path": a["path"], "media_type": a["media_type"], "content": json.dumps(a["content"], sort_keys=True)}) for a in artifacts]
    return [(kind, json.dumps(row)) for kind, row in rows]


def source(name: str, call: Callable[..., dict], parts: Callable[[str], list[str]] | None = None) -> type[DataSource]:
    """A provider as a data source: a partition for each part, asked and checked by the task that reads it."""

    class Reader(DataSourceReader):
        def __init__(self, root: str):
            self.root = root

        def partitions(self):
            return [InputPartition(p) for p in (parts(self.root) if parts else [None])]

        def read(self, partition):
            yield from _checked(call(self.root) if partition.value is None else call(self.root, partition.value))

    class Provider(DataSource):
        @classmethod
        def name(cls):
            return f"provider_{name}"

        def schema(self):
            return "kind string, item string"

        def reader(self, schema):
            return Reader(self.options.get("path", ""))

    return Provider


def materialize(spark: SparkSession, name: str, root: str) -> dict[str, DataFrame]:
    """documents (id, path, title, body), relations (id, to, kind), consumed (path), artifacts (path, media_type,
    content). The provider is asked once, by the tasks; its rows are written and read from there."""
    if name not in PROVIDERS:
        raise GridError("EXTENSION_NOT_FOUND", f"no provider {name!r}")
    ship(spark)
    made = source(name, PROVIDERS[name], PARTS.get(name))
    spark.dataSource.register(made)
    try:
        said = cut(spark.read.format(made.name()).load(root))
    except Exception as error:
        if REFUSED in str(error):
            raise GridError("EXTENSION_INVALID", f"{name!r}: its answer was refused") from error
        raise

    def of(kind, schema, *columns):
        return said.filter(F.col("kind") == kind).select(F.from_json("item", schema).alias("x")).select("x.*").select(*columns)

    documents = of("documents", "id string, title string, body string", "id", F.concat("id", F.lit(".md")).alias("path"), "title", "body")
    if not documents.groupBy("id").count().filter("count > 1").isEmpty():
        raise GridError("EXTENSION_INVALID", f"{name!r}: ids repeat")
    return {
        "documents": documents,
        "relations": of("relations", "id string, to string, kind string, seq long", "id", "to", "kind", F.lit(None).cast("string").alias("raw"), "seq"),
        "consumed": of("consumed", "path string", "path"),
        "artifacts": of("artifacts", "path string, media_type string, content string", "path", "media_type", "content"),
    }
