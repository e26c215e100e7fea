"""Export of a collection as files, and the life of extension data.

Documents are written by the executors through Spark, one Parquet or JSON part per task, or rendered
as Markdown rows that ``write_files`` lets the tasks put as files; the manifest goes last, so a reader that
finds it finds everything.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrid.errors import GridError
from corpusgrid.operators import privacy
from corpusgrid.runtime import ship
from corpusgrid.sources import files


def yaml_value(value) -> str:
    """JSON is YAML: quoted strings, lists and maps in one line with sorted keys."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def render(front: dict, body: str) -> str:
    lines = [f"{k}: {yaml_value(v)}" for k, v in sorted(front.items()) if v is not None]
    return "---\n" + "".join(f"{line}\n" for line in lines) + "---\n" + body


def rendered_text(front: str, body: str, key_id: str | None = None) -> str:
    """A body under its front matter (JSON)."""
    fields = json.loads(front)
    if key_id:
        fields["privacy"] = {"policy": "encrypt", "key_id": key_id, "encoded": True}
    return render(fields, body)


def unrendered(concepts: DataFrame, key: bytes | None = None) -> DataFrame:
    """path, front and text of each concept, for ``write_files`` to render: one Python worker for a task, not two."""
    body = privacy.encrypt(F.col("body"), key) if key else F.col("body")
    return concepts.select("path", F.coalesce("frontmatter", F.lit("{}")).alias("front"), F.coalesce(body, F.lit("")).alias("text"))


def rendered(concepts: DataFrame, key: bytes | None = None, key_id: str | None = None) -> DataFrame:
    """path and text of each concept; with a key, bodies are encrypted and marked as encoded."""
    ship(concepts.sparkSession)
    given = unrendered(concepts, key).withColumnRenamed("text", "body")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for front, body in zip(batch["front"], batch["body"], strict=True):
                texts.append(rendered_text(front, body, key_id))
            yield pd.DataFrame({"path": batch["path"], "text": texts})

    return given.mapInPandas(run, "path string, text string")


def write_files(spark: SparkSession, rows: DataFrame, root: str, manifest: dict, key_id: str | None = None) -> int:
    """Files of (path, text), or of what ``unrendered`` gives, below ``root``, written by the tasks that hold the rows (``sources.files``), then
    ``manifest.json``; the number of files. A job that fails leaves no file of its own."""
    ship(spark)
    spark.dataSource.register(files.FileSink)
    try:
        front = F.col("front") if "front" in rows.columns else F.lit(None).cast("string")
        writer = rows.select("path", "text", front.alias("front")).write.format(files.FileSink.name()).mode("append").option("manifest", json.dumps(manifest, sort_keys=True))
        (writer.option("key_id", key_id) if key_id else writer).save(root)
    except Exception as error:
        if files.REFUSED in str(error):
            raise GridError("INVALID_PATH", "a path leaves the folder") from error
        raise
    return files.counted(root)


def index_text(concepts: DataFrame) -> DataFrame:
    """The root index: a line for each concept, by id."""
    line = F.concat(F.lit("- ["), F.coalesce("title", "id"), F.lit("]("), F.col("path"), F.lit(")"), F.coalesce(F.concat(F.lit(" - "), F.col("description")), F.lit("")), F.lit("\n"))
    return concepts.orderBy("id").select(line.alias("line"))


def check_data(items: list[dict], most: int = 256, each: int = 32 << 20, total: int = 256 << 20) -> None:
    """Bounds and paths of an extension's data manifest."""
    if len(items) > most or sum(i["size"] for i in items) > total or any(i["size"] > each for i in items):
        raise GridError("INVALID_REQUEST", "extension data is too large")
    if any(i["path"].startswith("/") or ".." in i["path"].split("/") for i in items):
        raise GridError("INVALID_PATH", "extension data leaves its folder")
    if len({i["key"] for i in items}) < len(items):
        raise GridError("INVALID_REQUEST", "extension data keys repeat")


def unreferenced(files: DataFrame, data: DataFrame) -> DataFrame:
    """Content-addressed files (sha256, path) that no data row names: what a collection may remove."""
    return files.join(data.select("sha256").distinct(), "sha256", "left_anti")


def synthetic_merge(concepts: DataFrame, made: DataFrame, consumed: DataFrame, scopes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Concepts with those that a source provider made, without the files it consumed; and ``contains``
    relations from scopes (id, scope) to all paths inside them. Ids must not collide, and made ids
    live in a namespace that starts with ``_``."""
    if not made.filter(~F.startswith("id", F.lit("_"))).limit(1).isEmpty():
        raise GridError("INVALID_REQUEST", "synthetic ids start with _")
    kept = concepts.join(consumed.select("path"), "path", "left_anti").select(*concepts.columns)
    if not kept.join(made.select("id"), "id", "left_semi").limit(1).isEmpty():
        raise GridError("ID_COLLISION", "a synthetic id exists")
    merged = kept.unionByName(made, allowMissingColumns=True)
    none = merged.select(F.col("id"), F.col("id").alias("to"), F.lit("contains").alias("kind")).limit(0)
    if scopes is None:
        return merged, none
    # a path's folders are few, so containment is an equi-join on them
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    inside = kept.select(F.col("id").alias("to"), F.explode(folders).alias("scope"))
    return merged, scopes.select("id", "scope").join(inside, "scope").select("id", "to", F.lit("contains").alias("kind"))


def external_documents(made: DataFrame, relations: DataFrame) -> DataFrame:
    """Made rows; external ones only where more than one relation refers to them."""
    many = relations.groupBy("to").count().filter("count > 1").select(F.col("to").alias("id"))
    return made.filter("NOT external").unionByName(made.filter("external").join(many, "id", "left_semi").select(*made.columns))


def drop_unknown_ends(relations: DataFrame, concepts: DataFrame) -> DataFrame:
    ids = concepts.select("id")
    return relations.join(ids, "id", "left_semi").join(ids.select(F.col("id").alias("to")), "to", "left_semi").select(*relations.columns)
