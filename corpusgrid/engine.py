"""One object for a collection: parse, search, navigate, audit, store and synchronise.

Frames are lazy; a stored collection has a folder of its own, so a query of one collection reads no other.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgrid.errors import GridError
from corpusgrid.operators import audit, enrich, explain, export, fuzzy, graph, hybrid, keyword, lexical, navigation, rerank, semantic
from corpusgrid.plans import stored
from corpusgrid.plans.postings import postings
from corpusgrid.runtime import ship
from corpusgrid.sources import bundle
from corpusgrid.storage.collection import Collection

MODES = ("keyword", "fuzzy", "bm25", "hybrid_keyword", "hybrid_bm25", "semantic")


class Engine:
    def __init__(self, spark: SparkSession, concepts: DataFrame, root: str = "", parsed: DataFrame | None = None, permissive: bool = False,
                 relations: DataFrame | None = None, embeddings: DataFrame | None = None):
        ship(spark)
        self.spark, self.concepts, self.root, self.parsed, self.permissive = spark, concepts, root, parsed, permissive
        self.relations, self.embeddings = relations, embeddings

    @classmethod
    def parse(cls, spark: SparkSession, root: str, permissive: bool = False) -> Engine:
        """A folder of Markdown files."""
        parsed = bundle.parse(spark, root, permissive)
        return cls(spark, bundle.concepts(parsed), root, parsed, permissive)

    @classmethod
    def load(cls, spark: SparkSession, store: str, root: str, version: int | None = None) -> Engine:
        """A collection that ``ingest`` stored, as of one version."""
        kept = Collection(spark, store, root)
        record = kept.snapshot(version)
        relations = kept.read("relations", record) if kept.has("relations", record) else None
        return cls(spark, kept.read("concepts", record), root, relations=relations)

    # -- storing ----------------------------------------------------------------------------------

    def ingest(self, store: str, artifacts: DataFrame | None = None, indexed: bool = True) -> int:
        """Stores this collection whole, with its edges, relations and index; the version."""
        return Collection(self.spark, store, self.root, indexed).ingest(self.concepts, self.relations, artifacts)

    @staticmethod
    def load_edges(spark: SparkSession, store: str, root: str) -> DataFrame:
        """The edges that ``ingest`` stored, dangling ones marked."""
        return Collection(spark, store, root).read("edges")

    @staticmethod
    def load_index(spark: SparkSession, store: str, root: str) -> stored.Index:
        """The stored collection's search index."""
        return Collection(spark, store, root).index()

    def sync(self, store: str, artifacts: DataFrame | None = None) -> dict:
        """Brings the stored collection up to this one's content; counts of what changed. Relations stay as
        stored where this engine has none."""
        return Collection(self.spark, store, self.root).sync(self.concepts, self.relations, artifacts)

    # -- reading ----------------------------------------------------------------------------------

    @cached_property
    def edges(self) -> DataFrame:
        return graph.build_edges(self.concepts, self.relations)

    @property
    def nodes(self) -> DataFrame:
        return graph.degrees(self.concepts.select("id", "path", "type", F.coalesce("title", F.col("id").cast("string")).alias("title"), "keywords", "status", "tags"), self.edges)

    @property
    def stats(self) -> DataFrame:
        """One row: nodes, orphans, edges and edges by kind."""
        return graph.counts(self.concepts, self.edges)

    @property
    def dangling(self) -> DataFrame:
        return graph.dangling(self.concepts)

    @property
    def validation(self) -> DataFrame:
        if self.parsed is None:
            raise GridError("INVALID_REQUEST", "a stored collection has no validation")
        return bundle.validation(self.parsed)

    def list(self, **filters) -> DataFrame:
        return navigation.list_concepts(self.concepts, **filters)

    def show(self, target: str) -> DataFrame:
        target = navigation.normalize_target(target, self.root)
        navigation.require(self.concepts, target)
        return navigation.show(self.concepts, target, "policy", self.edges)

    def backlinks(self, target: str) -> DataFrame:
        navigation.require(self.concepts, target)
        return graph.backlinks(self.edges, self.nodes, target)

    def relate(self, target: str, direction: str = "both", depth: int = 1, relations=()) -> tuple[DataFrame, DataFrame]:
        navigation.require(self.concepts, target)
        return graph.relate(self.edges, target, direction, depth, relations)

    def path(self, start: str, end: str, relations=()) -> list[str]:
        for target in (start, end):
            navigation.require(self.concepts, target)
        found = graph.shortest_path(self.edges, start, end, relations)
        if found is None:
            raise GridError("NO_PATH", f"no path from {start!r} to {end!r}")
        return found

    def rescored(self, query: str, mode: str, top_k: int = 10, scorer: str | None = None, reranker: str | None = None, weight: float = rerank.WEIGHT,
                 candidate_k: int | None = None, **options) -> DataFrame:
        """A search whose first ``candidate_k`` hits an extension scores: id, score, rank, given_score, final_score, warning."""
        hits = self.search(query, mode, rerank.candidate_count(top_k, candidate_k), **options)
        score = "total_score" if mode.startswith("hybrid") else "score"
        return rerank.rerank(hits.select("id", F.col(score).alias("score")), self.concepts, query, top_k, scorer, reranker, weight)

    def export(self, root: str, key: bytes | None = None, key_id: str | None = None) -> int:
        """Writes the concepts as Markdown files below ``root``, bodies encrypted with a key; the number of files."""
        kind = "encrypted" if key else "raw"
        return export.write_files(self.spark, export.unrendered(self.concepts, key), root, {"kind": kind, "root": self.root}, key_id)

    def spaces(self) -> DataFrame:
        """The embedding spaces, with their rows, those that fit, and those older than their document."""
        if self.embeddings is None:
            raise GridError("INVALID_REQUEST", "the collection has no embeddings")
        rows = self.embeddings.withColumn("_same", F.lit(None).cast("boolean"))
        if "content_hash" in self.embeddings.columns and "content_hash" in self.concepts.columns:
            now = self.concepts.select("id", F.col("content_hash").alias("_now"))
            rows = self.embeddings.join(now, "id", "left").withColumn("_same", F.col("content_hash") == F.col("_now"))
        vector, dim = F.col("vector"), F.col("dim") if "dim" in self.embeddings.columns else F.size("vector")
        return rows.groupBy("model", dim.alias("dim")).agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.size(vector) == dim).alias("valid_rows"), F.count_if(~F.coalesce("_same", F.lit(True))).alias("stale_rows"))

    def embedded(self, embedder: str, model: str, dim: int) -> Engine:
        """This collection with the embeddings of a space made anew (others stay)."""
        made = enrich.embed(self.concepts, embedder, model, dim).filter("warning IS NULL").drop("warning")
        rest = None if self.embeddings is None else self.embeddings.filter((F.col("model") != model) | (F.col("dim") != dim))
        rows = made if rest is None else rest.unionByName(made, allowMissingColumns=True)
        return Engine(self.spark, self.concepts, self.root, self.parsed, self.permissive, self.relations, rows)

    def without_space(self, model: str, dim: int) -> Engine:
        """This collection without a space of embeddings."""
        rest = None if self.embeddings is None else self.embeddings.filter((F.col("model") != model) | (F.col("dim") != dim))
        return Engine(self.spark, self.concepts, self.root, self.parsed, self.permissive, self.relations, rest)

    def search(self, query: str, mode: str, top_k: int = 10, vector: list[float] | None = None, embedder: str | None = None, **options) -> DataFrame:
        """A ranking; the mode is always named. A semantic search takes a vector, or an embedder for the query's text."""
        titled = self.concepts.withColumn("title", F.coalesce("title", F.col("id").cast("string")))
        match mode:
            case "keyword":
                return keyword.keyword_search(navigation.visible(self.concepts, "keyword"), query, top_k)
            case "fuzzy":
                return fuzzy.fuzzy_search(navigation.visible(titled, "fuzzy"), query, top_k)
            case "bm25":
                return lexical.lexical_search(navigation.visible(self.concepts, "lexical"), query, top_k, **options)
            case "hybrid_keyword":
                return hybrid.hybrid_keyword(navigation.visible(titled, "fuzzy"), query, top_k)
            case "hybrid_bm25":
                words = lexical.lexical_search(navigation.visible(self.concepts, "lexical"), query, top_k, **options)
                return hybrid.fuse_lexical_fuzzy(words, fuzzy.top(navigation.visible(titled, "fuzzy"), query, top_k), top_k)
            case "semantic":
                if embedder is not None and vector is None:
                    vector = [float(x) for x in enrich.registered("embedder", embedder)(query)]
                if self.embeddings is None or vector is None:
                    raise GridError("INVALID_REQUEST", "semantic search needs embeddings and a query vector")
                hits = semantic.knn(self.embeddings, vector, top_k)
                shown = navigation.visible(titled, "lexical").select("id", "title", "path", "type")
                return shown.join(F.broadcast(hits), "id").select("id", "title", "path", "type", "score").orderBy(F.desc("score"), "id")  # at most 100 rows
        raise GridError("INVALID_MODE", f"mode must be one of {', '.join(MODES)}")

    def explain(self, query: str, target: str, mode: str) -> DataFrame:
        navigation.require(self.concepts, target)
        titled = self.concepts.withColumn("title", F.coalesce("title", F.col("id").cast("string")))
        calls = {"keyword": explain.explain_keyword, "fuzzy": explain.explain_fuzzy, "bm25": explain.explain_lexical, "hybrid_bm25": explain.explain_hybrid,
                 "hybrid_keyword": explain.explain_hybrid_keyword, "bm25_total": explain.explain_lexical_total}
        if mode not in calls:
            raise GridError("INVALID_MODE", f"explain knows {', '.join(calls)}")
        return calls[mode](self.concepts if mode in ("keyword", "bm25") else titled, query, target)

    def index(self, path: str, titled: bool = True) -> None:
        """Writes the inverted frames; ``plans.stored.Index`` answers from them."""
        stored.build(self.concepts.withColumn("title", F.coalesce("title", F.col("id").cast("string"))) if titled else self.concepts, path)

    def postings(self) -> DataFrame:
        return postings(self.concepts)

    def audit(self, codecs=(), keys=None) -> DataFrame:
        """All findings in order."""
        concepts = self.concepts
        links = concepts.select("id", F.explode("links").alias("link")).select("id", "link.*")
        parts = audit.link_findings(links) + audit.orphan_findings(concepts, self.edges) + audit.related_findings(concepts)
        if self.parsed is not None:
            entries, warnings = bundle.index(self.spark, self.root)
            said = self.spark.createDataFrame([(w,) for w in warnings], "warning string")
            parts += audit.validation_findings(self.validation, self.permissive) + audit.index_findings(concepts, entries) + audit.version_findings(said)
        if codecs and "body_codec" in concepts.columns:
            parts += audit.codec_findings(concepts, codecs)
        if keys is not None and "key_id" in concepts.columns:
            parts += audit.key_findings(concepts.filter("key_id IS NOT NULL"), keys)
        return audit.ordered(audit.findings(parts))
