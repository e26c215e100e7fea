"""Project analyzers: files of a project in, documents, symbols and relations out.

An analyzer is a registered callable over all files of one project. It runs as a table function that Spark
partitions by project, so projects are analyzed side by side; a project's files and its answer are bounded.
What it answers is checked in the task and upserted into the concepts.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.errors import GridError
from corpusgrid.runtime import cut, ship
from corpusgrid.sources.providers import KIND, safe_path

#: Bytes of a project's files and of its answer; artifacts of an answer.
BYTES, ARTIFACTS = 64 << 20, 100
ANALYZERS: dict[str, Callable[[list[dict]], dict]] = {}
DOCUMENT = "id string, type string, content_kind string, title string, description string, keywords array<string>, body string"
REFUSED = "EXTENSION_INVALID"


def register_analyzer(name: str, call: Callable[[list[dict]], dict]) -> None:
    """``call(files)`` answers {documents, external_documents, relations, artifacts}; a document may hold
    ``symbols``, documents of their own."""
    ANALYZERS[name] = call


def answer_rows(files: list[dict], said: dict) -> list[tuple[str, int, str]]:
    """(kind, place, JSON) of a checked answer: documents first, each followed by its symbols."""
    known, seen, rows = {f["id"] for f in files}, set(), []

    def put(kind: str, item: dict) -> None:
        rows.append((kind, len(rows), json.dumps(item)))

    for document in said.get("documents", []):
        if document["id"] not in known or document["id"] in seen:
            raise ValueError(f"{REFUSED}: document {document['id']!r} is unknown or comes twice")
        seen.add(document["id"])
        put("document", {k: v for k, v in document.items() if k != "symbols"})
        for symbol in document.get("symbols", []):
            put("symbol", symbol)
    for document in said.get("external_documents", []):
        put("external", document)
    for relation in said.get("relations", []):
        if KIND.fullmatch(relation["kind"].strip()):  # others are left out
            put("relation", relation | {"kind": relation["kind"].strip()})
    if len(said.get("artifacts", [])) > ARTIFACTS or not all(safe_path(a["path"]) for a in said.get("artifacts", [])):
        raise ValueError(f"{REFUSED}: artifacts are too many or leave their folder")
    for artifact in said.get("artifacts", []):
        put("artifact", {"path": artifact["path"], "content": json.dumps(artifact["content"], sort_keys=True)})
    if sum(len(r[2]) for r in rows) > BYTES:
        raise ValueError(f"{REFUSED}: the answer exceeds {BYTES} bytes")
    return rows


def analyze(files: DataFrame, name: str) -> DataFrame:
    """project, kind, place, item (JSON) from ``files`` (project, id, path, body)."""
    if name not in ANALYZERS:
        raise GridError("EXTENSION_NOT_FOUND", f"no analyzer {name!r}")
    from pyspark.sql.functions import udtf

    call = ANALYZERS[name]
    ship(files.sparkSession)

    class Analyze:
        def __init__(self):
            self.project, self.files, self.size = None, [], 0

        def eval(self, row):
            self.project = row["project"]
            self.size += len(row["body"] or "")
            if self.size > BYTES:
                raise ValueError(f"{REFUSED}: the project exceeds {BYTES} bytes")
            self.files.append({"id": row["id"], "path": row["path"], "body": row["body"]})

        def terminate(self):
            if self.files:
                files = sorted(self.files, key=lambda f: f["id"])
                for kind, place, item in answer_rows(files, call(files)):
                    yield self.project, kind, place, item

    made = udtf(Analyze, returnType="project string, kind string, place int, item string")
    given = files.select("project", "id", "path", "body")
    try:
        return cut(made(given.asTable().partitionBy("project")))
    except Exception as error:
        if REFUSED in str(error):
            raise GridError("EXTENSION_INVALID", f"{name!r}: its answer was refused") from error
        raise


def upsert(concepts: DataFrame, files: DataFrame, said: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(concepts, relations) after an analysis of ``files``.

    Files that the analyzer left out go. A document that is a concept gives it what it says (empty fields leave
    what was); others are added, the first of an id with what later ones say on top. External documents are
    added where more than one relation leads to them. Relations stay where both ends are concepts.
    """
    relations = said.filter("kind = 'relation'").select("project", "place", F.from_json("item", "from string, to string, kind string").alias("r")).select("place", F.col("r.from").alias("id"), F.col("r.to").alias("to"), F.col("r.kind").alias("kind"))
    told = said.filter("kind IN ('document', 'symbol', 'external')").select("project", "kind", "place", F.from_json("item", DOCUMENT).alias("d")).select("project", F.col("kind").alias("said_as"), "place", "d.*")
    kept = told.filter("said_as = 'document'").select("id")
    left = concepts.join(files.select("id"), "id", "left_semi").join(kept, "id", "left_anti").select("id")
    stay = concepts.join(left, "id", "left_anti")
    # an external document that too few relations lead to takes its relations with it, unless it is a concept anyway
    many = relations.groupBy("to").count().filter("count > 1").select(F.col("to").alias("id"))
    outer = told.filter("said_as = 'external'")
    rest = told.filter("said_as <> 'external'").unionByName(outer.join(many, "id", "left_semi").select(*told.columns))
    few = outer.select("id").distinct().join(many, "id", "left_anti")

    # later statements win, field by field; empty ones say nothing
    order = F.struct(F.when(F.col("said_as") == "external", 1).otherwise(0), "project", "place")
    def last(c):
        empty = F.size(c) == 0 if c == "keywords" else F.col(c) == ""
        return F.max_by(c, F.when(F.col(c).isNotNull() & ~empty, order)).alias(f"_{c}")
    fields = ("type", "content_kind", "title", "description", "keywords")
    merged = rest.groupBy("id").agg(*map(last, fields), F.min_by("body", order).alias("_body"))
    both = stay.join(merged, "id", "full_outer")
    known = {c: F.coalesce(f"_{c}", c) if c in concepts.columns else F.col(f"_{c}") for c in fields}
    known["body"] = F.coalesce("body", "_body") if "body" in concepts.columns else F.col("_body")
    known["path"] = F.coalesce("path", "id")
    columns = [*concepts.columns, *(c for c in (*fields, "body") if c not in concepts.columns)]
    made = both.select(*[known.get(c, F.col(c)).alias(c) for c in columns])
    ids = made.select("id")
    held = relations.join(few.select(F.col("id").alias("to")), "to", "left_anti").join(ids, "id", "left_semi").join(ids.select(F.col("id").alias("to")), "to", "left_semi")
    return made, held.select("id", "to", "kind", F.lit(None).cast("string").alias("raw"), F.col("place").cast("long").alias("seq"))
