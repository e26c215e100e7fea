"""The corpus pipeline: toxicity, language ID, near-duplicates, source mix, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. ``run`` writes each stage's result to the shared checkpoint folder and reads it
back as the next one's input. The models learn from the labels and languages of the rows that reach
their stage; SQL cannot express the stages, so the tests hold them against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusgrid.llm import bpe, language_id, queries, simhash, source_mix, toxicity
from corpusgrid.runtime import checkpoint_dir, remove
from corpusgrid.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those that no learned language fits."""
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return source_mix.emit(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of whole texts, and the digests of ids and decoded text."""
    return bpe.encode_documents(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unidentified),
    ("near_duplicates", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("bpe", tokenize),
]

#: SQL cannot express the classifiers, fingerprints and tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        place = f"{base}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
        if i:  # its successor is whole, so a stage's copy of the corpus goes
            remove(spark, f"{base}/{i - 1}_{STAGES[i - 1][0]}")
    return docs
