"""Extensions as registered Python callables: enrichers, embedders, rerankers and scorers.

They run vectorised over redacted columns, on the executors; a bounded candidate set goes to
rerankers and scorers. A failing call leaves the row as it was, with a warning.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgrid.errors import GridError
from corpusgrid.operators.semantic import embedding_text
from corpusgrid.runtime import ship

#: Keywords that a document takes at most and their length; keywords a scorer sees.
KEYWORDS, KEYWORD_CHARS, SHOWN = 32, 128, 64

REGISTRY: dict[str, dict[str, Callable]] = {"enricher": {}, "embedder": {}, "reranker": {}, "scorer": {}}


def register(kind: str, name: str, call: Callable) -> None:
    if kind not in REGISTRY:
        raise GridError("INVALID_REQUEST", f"no extension kind {kind!r}")
    REGISTRY[kind][name] = call


def registered(kind: str, name: str) -> Callable:
    try:
        return REGISTRY[kind][name]
    except KeyError:
        raise GridError("EXTENSION_NOT_FOUND", f"no {kind} {name!r}") from None


def listed() -> list[tuple[str, str]]:
    return sorted((kind, name) for kind, names in REGISTRY.items() for name in names)


def merge_keywords(declared, inferred):
    """Both lists without blanks and without repeats whatever the case; declared ones keep their place."""
    trimmed = F.filter(F.transform(F.coalesce(inferred, F.array().cast("array<string>")), lambda k: F.trim(k)), lambda k: (k != "") & (F.length(k) <= KEYWORD_CHARS))
    both = F.concat(F.coalesce(declared, F.array().cast("array<string>")), trimmed)
    low = F.transform(both, lambda k: F.lower(k))
    kept = F.filter(F.zip_with(both, F.transform(F.sequence(F.lit(1), F.greatest(F.size(both), F.lit(1))), lambda i: i), lambda k, i: F.struct(k.alias("k"), i.alias("i"))),
                    lambda x: x["k"].isNotNull() & (F.array_position(low, F.lower(x["k"])) == x["i"]))
    return F.slice(F.transform(kept, lambda x: x["k"]), 1, KEYWORDS)


def enrichments(concepts: DataFrame, name: str) -> DataFrame:
    """id, enricher, data (JSON of inferred keywords, title, description, text, metadata), warning."""
    call = registered("enricher", name)
    ship(concepts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                try:
                    out.append((row.id, name, json.dumps(call(row._asdict()), sort_keys=True), None))
                except Exception as error:
                    out.append((row.id, name, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["id", "enricher", "data", "warning"])

    given = concepts.select("id", "title", "description", "body")
    kind = given.schema[0].dataType.simpleString()
    return given.mapInPandas(run, f"id {kind}, enricher string, data string, warning string")


def apply_enrichments(concepts: DataFrame, found: DataFrame) -> DataFrame:
    """Blank titles and descriptions filled, keywords merged; with several enrichers the first by name."""
    data = F.col("data")
    parsed = found.filter("data IS NOT NULL").select("id", "enricher", F.from_json(data, "keywords array<string>, title string, description string").alias("d"))
    first = parsed.groupBy("id").agg(
        F.min_by("d.title", F.when(F.col("d.title").isNotNull(), F.col("enricher"))).alias("_title"),
        F.min_by("d.description", F.when(F.col("d.description").isNotNull(), F.col("enricher"))).alias("_description"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("enricher", "d.keywords"))), lambda x: F.coalesce(x["keywords"], F.array().cast("array<string>")))).alias("_keywords"),
    )
    def filled(column):
        return F.coalesce(F.when(F.trim(column) != "", F.col(column)), F.col(f"_{column}"), F.col(column))
    joined = concepts.join(first, "id", "left")
    return joined.withColumns({"title": filled("title"), "description": filled("description"), "keywords": merge_keywords(F.col("keywords"), F.col("_keywords"))}).drop("_title", "_description", "_keywords")


def embed(concepts: DataFrame, name: str, model: str, dim: int) -> DataFrame:
    """id, model, dim, vector, content_hash, warning; vectors of another length are refused."""
    call = registered("embedder", name)
    ship(concepts.sparkSession)
    given = embedding_text(concepts).join(concepts.select("id", "content_hash"), "id") if "content_hash" in concepts.columns else embedding_text(concepts).withColumn("content_hash", F.sha2("text", 256))
    kind = given.schema["id"].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, text, digest in zip(batch["id"], batch["text"], batch["content_hash"], strict=True):
                try:
                    vector = [float(x) for x in call(text)]
                    warning = None if len(vector) == dim else f"{len(vector)} components, not {dim}"
                except Exception as error:
                    vector, warning = [], f"{type(error).__name__}: {error}"
                out.append((key, model, dim, None if warning else vector, digest, warning))
            yield pd.DataFrame(out, columns=["id", "model", "dim", "vector", "content_hash", "warning"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("model", T.StringType()), T.StructField("dim", T.IntegerType()), T.StructField("vector", T.ArrayType(T.FloatType())),
                           T.StructField("content_hash", T.StringType()), T.StructField("warning", T.StringType())])
    return given.select("id", "text", "content_hash").mapInPandas(run, schema)


def candidates(hits: DataFrame, concepts: DataFrame) -> DataFrame:
    """What a scorer sees of a bounded ranking: scores, title, path, at most ``SHOWN`` keywords."""
    seen = concepts.select("id", "title", "path", "type", "description", "status", F.slice("keywords", 1, SHOWN).alias("keywords"))
    return seen.join(F.broadcast(hits.limit(100)), "id")


def given_scores(shown: DataFrame, name: str, query: str, kind: str = "scorer") -> DataFrame:
    """id, given_score from a call on all candidates at once (at most 100 rows); each id once, 0..1."""
    call = registered(kind, name)
    ship(shown.sparkSession)
    of = shown.schema["id"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        scored = call(query, frame.drop(columns="_all").to_dict("records"))
        if sorted(map(str, scored)) != sorted(map(str, frame["id"])):
            raise ValueError("a scorer must return each candidate once")
        return pd.DataFrame({"id": list(scored), "given_score": [min(1.0, max(0.0, float(s))) for s in scored.values()]})

    return shown.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, f"id {of}, given_score double")
