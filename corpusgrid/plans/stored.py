"""Stored inverted tables: what a repeated query needs, without the texts.

``postings`` holds for each token and document the places of the token in each field, the weighted frequency
and the document's length, so single terms, phrases and excluded phrases are answered from it. ``tokens`` is the
vocabulary of the fuzzy fields, ``grams`` leads from numbered letter pairs to its tokens, ``keywords`` to keywords. All
are sorted by what a query looks up, so it reads few row groups. The statistics (documents and
their tokens) stand in the version record.

A change (``change``) adds segments with the rows of new and changed documents and tombstones for what they
replace; statistics are added up from what the change itself holds. ``storage.versions`` makes it visible at once.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgrid.errors import GridError, check_top_k
from corpusgrid.functions.similarity import LEAST
from corpusgrid.functions.text import round4
from corpusgrid.operators import fuzzy, hybrid, keyword
from corpusgrid.operators.lexical import B, FLOOR, K1
from corpusgrid.plans.postings import FUZZY_WEIGHTS, LEXICAL_WEIGHTS, field_tokens, keyword_tokens
from corpusgrid.plans.query_text import parse_terms, required_tokens
from corpusgrid.runtime import remove, ship, together
from corpusgrid.storage import versions
from corpusgrid.storage.versions import Transaction, Versions

SPACES = {"postings": "content", "lengths": "content", "keywords": "content", "tokens": "vocabulary", "grams": "vocabulary"}
ORDER = {"postings": ("token", "id"), "keywords": ("token",), "tokens": ("token",), "grams": ("gram",)}
versions.ORDER.update(ORDER)
#: Similar tokens share at least this many numbered letter pairs: d edits spoil at most 2 d of the n + 1 pairs of
#: a padded token, and d is at most 0.45 n; a shared trigram holds two.
SHARED = 2
#: Occurrences of tokens (rows of letter pairs) for each part of a table, so parts stay small however many there are;
#: sampled tokens at most.
ROWS, SAMPLE = 2_000_000, 400_000


def split(concepts: DataFrame) -> DataFrame:
    """id, each field's tokens in order, and the document's length: what all tables derive from."""
    fields = [field_tokens(concepts, f).alias(f) for f in LEXICAL_WEIGHTS]
    held = concepts.select("id", *fields)
    return held.withColumn("tokens", sum((F.size(f) for f in LEXICAL_WEIGHTS), F.lit(0)).cast("double"))


def positional(held: DataFrame, parts: int = 1) -> DataFrame:
    """token, id, tf (weighted over fields), tokens (the document's length), and the token's places by field
    (null where it has none), ascending. A document lies in one row of ``split``, so its places are gathered there,
    and each token and document is shuffled once, as one short row: into ``parts`` ranges of tokens, each sorted.
    The ranges come from a bounded sample of documents; rows of a token that fills several are dealt over them."""
    ship(held.sparkSession)
    bounds = _bounds(held, parts)
    ident = held.schema["id"].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("token", T.StringType()), T.StructField("id", ident),
                           T.StructField("tf", T.DoubleType()), T.StructField("tokens", T.DoubleType()), *[T.StructField(f, T.ArrayType(T.IntegerType())) for f in LEXICAL_WEIGHTS]])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            yield _gather(batch, bounds, seen)
            seen += batch.num_rows

    rows = held.select("id", "tokens", *LEXICAL_WEIGHTS).mapInArrow(gathered, schema)
    return rows.repartitionById(parts, "part").drop("part").sortWithinPartitions("token", "id")


def _bounds(held: DataFrame, parts: int) -> list[str]:
    """Tokens that begin the ranges after the first, from at most SAMPLE distinct tokens of documents."""
    if parts < 2:
        return []
    fraction = min(1.0, 2_000 / max(1, held.count()))
    some = held.sample(fraction, 7).select(F.explode(F.array_distinct(F.concat(*LEXICAL_WEIGHTS))).alias("token")).limit(SAMPLE)
    found = sorted(r["token"] for r in some.collect())
    return [found[len(found) * i // parts] for i in range(1, parts)] if found else []


def _gather(batch: pa.RecordBatch, bounds: list[str], seen: int) -> pa.RecordBatch:
    """The rows (part, token, id, tf, tokens, each field's places) of a batch of documents, by token."""
    words, docs, at, fields = [], [], [], []
    for i, field in enumerate(LEXICAL_WEIGHTS):
        column = batch.column(field)
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        begins = np.cumsum(lengths) - lengths
        words.append(pc.list_flatten(column).cast(pa.string()))
        docs.append(np.repeat(np.arange(batch.num_rows), lengths))
        at.append(np.arange(lengths.sum()) - np.repeat(begins, lengths))
        fields.append(np.full(lengths.sum(), i, np.int8))
    coded = pa.chunked_array(words, pa.string()).combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    doc, at, field = np.concatenate(docs), np.concatenate(at), np.concatenate(fields)
    key = rank[coded.indices.to_numpy(zero_copy_only=False)] * batch.num_rows + doc if len(names) else np.empty(0, np.int64)
    by = np.argsort(key, kind="stable")  # fields and places stay in their order
    key, at, field = key[by], at[by], field[by]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    word, doc = np.divmod(key[starts], max(1, batch.num_rows))
    names = [names[i] for i in order]
    low = np.array([bisect_left(bounds, n) for n in names], np.int64)
    high = np.array([bisect_right(bounds, n) for n in names], np.int64)
    share = (seen + doc) * 0.6180339887498949 % 1  # the same where a task runs again
    part = low[word] + (share * (high - low + 1)[word]).astype(np.int64) if len(names) else word
    row = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(key)]))
    tf, places = np.zeros(len(starts)), []
    for i, weight in enumerate(LEXICAL_WEIGHTS.values()):
        held = np.bincount(row[field == i], minlength=len(starts))
        tf += held * weight
        ends = pa.array(np.r_[0, np.cumsum(held)], pa.int32())
        places.append(pa.ListArray.from_arrays(ends, pa.array(at[field == i], pa.int32()), mask=pa.array(held == 0)))
    return pa.RecordBatch.from_arrays([
        pa.array(part, pa.int32()), pa.array(names, pa.string()).take(pa.array(word)), batch.column("id").take(pa.array(doc)), pa.array(tf), batch.column("tokens").take(pa.array(doc)), *places,
    ], ["part", "token", "id", "tf", "tokens", *LEXICAL_WEIGHTS])


def lexical_postings(concepts: DataFrame) -> DataFrame:
    """token, id, tf (weighted over fields)."""
    held = split(concepts)
    each = F.array(*[F.struct(F.lit(w).alias("w"), F.col(f).alias("held")) for f, w in LEXICAL_WEIGHTS.items()])
    rows = held.select("id", F.inline(each)).select("id", "w", F.explode("held").alias("token"))
    return rows.groupBy("token", "id").agg(F.sum("w").alias("tf"))


def _pairs(token: Column) -> Column:
    """The letter pairs of ``#token#``, sorted, each numbered among those like it. The outer ``transform`` makes the
    pairs once for a token: an expression inside a lambda would be made again for each pair."""
    padded = F.concat(F.lit("#"), token, F.lit("#"))
    pairs = F.sort_array(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substr(padded, i, F.lit(2))))
    def numbered(pairs):
        return F.transform(pairs, lambda p, i: F.concat(p, (i + 1 - F.array_position(pairs, p)).cast("string")))
    return F.transform(F.array(pairs), numbered)[0]


def numbered_pairs(token: str) -> list[str]:
    """``_pairs`` of a query token."""
    seen: Counter = Counter()
    out = []
    for i in range(len(token) + 1):
        pair = f"#{token}#"[i : i + 2]
        out.append(f"{pair}{seen[pair]}")
        seen[pair] += 1
    return out


def sizes(token: str) -> tuple[int, int]:
    """The least and greatest length of a plain token that may be similar to a plain query token. Each trigram of
    the query counts once for every time it has it, so tokens may be shorter the more it repeats one."""
    repeats = max(Counter(f"#{token}#"[i : i + 3] for i in range(len(token))).values())
    return int(len(token) * LEAST / (2 * repeats - LEAST)), int(len(token) * (2 - LEAST) / LEAST) + 1


def gram_rows(tokens: DataFrame) -> DataFrame:
    """gram, size, plain (its trigrams count with repeats), token, for tokens of three characters and more."""
    plain = (F.octet_length("token") == F.length("token")) & (F.length("token") <= 62)
    return tokens.filter(F.length("token") >= 3).select(F.explode(_pairs(F.col("token"))).alias("gram"), F.length("token").alias("size"), plain.alias("plain"), "token")


# -- writing --------------------------------------------------------------------------------------


def opened(spark: SparkSession, folder: str) -> Versions:
    return Versions(spark, folder, SPACES)


def _sorted(df: DataFrame, table: str) -> DataFrame:
    keys = ORDER[table]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def fill(changes: Transaction, concepts: DataFrame) -> dict:
    """Adds the rows of ``concepts`` to a transaction's index tables; the facts (documents, tokens) that they
    change. The texts are tokenized once: their tokens are written first, and go when all tables have been made."""
    facts = changes.base["facts"]
    if concepts.isEmpty() and "postings" in changes.tables:
        return facts
    spark, scratch = concepts.sparkSession, f"{changes.versions.root}/scratch/{uuid.uuid4().hex}"
    split(concepts).write.option("compression", "zstd").parquet(scratch)
    held = spark.read.parquet(scratch)
    size = held.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0.0)).alias("t")).first()

    def posted():
        made = changes.put("postings", positional(held, 1 + int(size["t"]) // ROWS))
        # the vocabulary from the postings: tokens that weigh more than their places among the keywords stand in a fuzzy field
        told = F.col("tf") > F.coalesce(F.size("keywords"), F.lit(0)) * F.lit(LEXICAL_WEIGHTS["keywords"])
        words = changes.versions._open(made).filter(told).select("token").distinct()
        if "tokens" in changes.tables:  # only tokens that no segment has; tokens that lost their last document do no harm
            words = words.join(changes.rows("tokens"), "token", "left_anti")
        new = changes.put("tokens", _sorted(words, "tokens"))
        # dealt by hash: finding ranges would make all pairs twice
        pairs = gram_rows(changes.versions._open(new)).repartition(1 + 10 * new["rows"] // ROWS, "gram")
        changes.put("grams", pairs.sortWithinPartitions(*ORDER["grams"]))

    together(posted, lambda: changes.put("lengths", held.select("id", "tokens")), lambda: changes.put("keywords", _sorted(keyword_tokens(concepts), "keywords")))
    remove(spark, scratch)
    return {"documents": facts.get("documents", 0) + size["n"], "tokens": facts.get("tokens", 0.0) + size["t"]}


def bury(changes: Transaction, gone: DataFrame) -> dict:
    """Takes documents (id) out of a transaction's index tables; the facts without them."""
    facts = changes.base["facts"]
    if "lengths" not in changes.tables:
        return facts
    lost = changes.rows("lengths").join(gone, "id", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0.0)).alias("t")).first()
    changes.bury("content", gone)
    return {"documents": facts.get("documents", 0) - lost["n"], "tokens": facts.get("tokens", 0.0) - lost["t"]}


def build(concepts: DataFrame, folder: str) -> None:
    """Writes all tables anew as one version."""
    found = opened(concepts.sparkSession, folder)
    changes = found.begin()
    changes.tables, changes.graves = {}, {}
    changes.base["facts"].update(documents=0, tokens=0.0)
    changes.commit(**fill(changes, concepts))


def change(spark: SparkSession, folder: str, gone: DataFrame, fresh: DataFrame) -> int:
    """Brings an index up to a change: ``gone`` (id) are removed or replaced, ``fresh`` are concepts that are new or
    changed. Writes their rows only; the version reached."""
    changes = opened(spark, folder).begin()
    changes.base["facts"].update(bury(changes, gone))
    return changes.commit(**fill(changes, fresh))


# -- asking ---------------------------------------------------------------------------------------


class Index:
    """Answers from one version; later ones do not change its answers."""

    def __init__(self, spark: SparkSession, folder: str, version: int | None = None, store: Versions | None = None):
        self.store = store or opened(spark, folder)
        self.spark, self.record = spark, self.store.record(version)
        if not self.store.has(self.record, "postings"):
            raise GridError("STORE_NOT_FOUND", f"no index in {folder!r}")
        self.documents, self.tokens = float(self.record["facts"]["documents"]), float(self.record["facts"]["tokens"])

    def table(self, name: str) -> DataFrame:
        return self.store.read(self.record, name)

    def keyword(self, query: str, top_k: int = 10) -> DataFrame:
        """id, score and matched keywords; only tokens that a query token begins are read."""
        asked = required_tokens(query)
        wanted = reduce(Column.__or__, [F.startswith("token", F.lit(q)) for q in asked])
        return keyword.ranked(self.table("keywords").filter(wanted), asked).orderBy(F.desc("score"), "id").limit(check_top_k(top_k))

    def candidates(self, asked: list[str]) -> DataFrame:
        """Tokens that may be similar to a query token: a short one by what it begins, others by the letter pairs
        they share with it (read from the pair's list, not from the vocabulary) and by their lengths."""
        short, long = [q for q in asked if len(q) < 3], [q for q in asked if len(q) >= 3]
        parts = []
        if short:
            parts.append(self.table("tokens").filter(reduce(Column.__or__, [F.startswith("token", F.lit(q)) for q in short])))
        for q in dict.fromkeys(long):
            listed = q.isascii() and len(q) <= 62
            near = F.col("size").between(*sizes(q))
            rows = self.table("grams").filter(F.col("gram").isin(*numbered_pairs(q)))
            rows = rows.filter(near | ~F.col("plain")) if listed else rows
            parts.append(rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SHARED).select("token"))
        begun = sorted({q[:k] for q in long for k in (1, 2)})
        if begun:  # tokens of one or two characters that begin a query token
            parts.append(self.table("tokens").filter(F.col("token").isin(*begun)))
        return reduce(DataFrame.unionByName, parts).distinct()

    def fuzzy(self, query: str, top_k: int = 10) -> DataFrame:
        """id, score and matched fields."""
        asked = required_tokens(query)
        similar = fuzzy.similar_tokens(self.candidates(asked), asked)
        rows = similar.limit(fuzzy.NAMED + 1).collect()
        posted = self.table("postings")
        if len(rows) <= fuzzy.NAMED:
            similar = F.broadcast(self.spark.createDataFrame(rows, similar.schema))
            posted = posted.filter(F.col("token").isin(sorted({r["token"] for r in rows})))
        fields = F.filter(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in FUZZY_WEIGHTS]), lambda f: f.isNotNull())
        found = posted.select("token", "id", F.explode(fields).alias("field")).join(similar, "token")
        return fuzzy.ranked(fuzzy.best_tokens(found), len(asked)).drop("terms").orderBy(F.desc("score"), "id").limit(check_top_k(top_k))

    def _terms(self, query: str) -> tuple[DataFrame, list[str]]:
        """id, tokens, tf_i of each positive term and ``excluded``, of documents that hold a token of the query."""
        terms = parse_terms(query)
        tokens = sorted({t for p in terms.positive + terms.negative for t in p})
        phrases = any(len(p) > 1 for p in terms.positive + terms.negative)
        rows = self.table("postings")
        rows = rows.filter(F.col("token").isin(*tokens)) if tokens else rows.limit(0)
        name = {t: f"t{i}" for i, t in enumerate(tokens)}

        def of(token, what):
            return F.max(F.when(F.col("token") == token, what))  # one row for each token and document

        held = [of(t, F.col("tf")).alias(f"{name[t]}_tf") for t in tokens]
        if phrases:
            within = {t for p in terms.positive + terms.negative if len(p) > 1 for t in p}
            held += [of(t, F.col(f)).alias(f"{name[t]}_{f}") for t in sorted(within) for f in LEXICAL_WEIGHTS]
        grouped = rows.groupBy("id").agg(F.max("tokens").alias("tokens"), *held) if held else rows.select("id", "tokens")

        def frequency(phrase):
            if len(phrase) == 1:
                return F.coalesce(F.col(f"{name[phrase[0]]}_tf"), F.lit(0.0))
            def start(token, field, k):
                return F.transform(F.col(f"{name[token]}_{field}"), lambda x: x - k)
            def often(field):  # places where each token stands as far on as it does in the phrase
                starts = [start(t, field, k) for k, t in enumerate(phrase)]
                return F.coalesce(F.size(reduce(F.array_intersect, starts)), F.lit(0))
            return sum((F.greatest(often(f), F.lit(0)) * F.lit(w) for f, w in LEXICAL_WEIGHTS.items()), F.lit(0.0))

        shown = [frequency(p).alias(f"tf_{i}") for i, p in enumerate(terms.positive)]
        excluded = reduce(Column.__or__, [frequency(p) > 0 for p in terms.negative], F.lit(False))
        return grouped.select("id", "tokens", *shown, excluded.alias("excluded")), [" ".join(p) for p in terms.positive]

    def contributions(self, query: str) -> tuple[DataFrame, list[str]]:
        """id, excluded and c_i, what each positive term adds to a document, and the terms."""
        counted, terms = self._terms(query)
        n = len(terms)
        # one row of counts, bounded by the query
        df = counted.agg(*[F.count_if(F.col(f"tf_{i}") > 0).cast("double").alias(f"df_{i}") for i in range(n)]) if n else None
        mean = self.tokens / self.documents if self.documents and self.tokens else 1.0

        def part(i):
            tf, seen = F.col(f"tf_{i}"), F.col(f"df_{i}")
            idf = F.log((F.lit(self.documents) - seen + 0.5) / (seen + 0.5))
            worth = F.when(idf <= 0, F.lit(FLOOR)).otherwise(idf)
            return F.when(tf > 0, worth * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("tokens") / F.lit(mean)))).otherwise(F.lit(0.0))

        joined = counted.crossJoin(F.broadcast(df)) if n else counted
        return joined.select("id", "excluded", *[part(i).alias(f"c_{i}") for i in range(n)]), terms

    def bm25(self, query: str, top_k: int = 10) -> DataFrame:
        """id, raw_score, score; phrases and exclusions are answered from the places of their tokens."""
        made, terms = self.contributions(query)
        total = sum((F.col(f"c_{i}") for i in range(len(terms))), F.lit(0.0))
        raw = made.filter("NOT excluded").select("id", total.alias("raw_score")).filter("raw_score > 0")
        top = raw.orderBy(F.desc("raw_score"), "id").limit(check_top_k(top_k))
        best = top.agg(F.max("raw_score").alias("_best"))
        return top.crossJoin(F.broadcast(best)).select("id", "raw_score", round4(F.col("raw_score") / F.col("_best")).alias("score"))

    def explain_bm25(self, query: str, target) -> DataFrame:
        """pos, query_token, matched and contribution of each positive term in one document."""
        made, terms = self.contributions(query)
        if not terms:
            raise GridError("EMPTY_QUERY", "the query has no positive term")
        asked = self.spark.range(1).select(F.posexplode(F.array(*map(F.lit, terms))).alias("pos", "query_token"))
        rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.col(f"c_{i}").alias("contribution")) for i in range(len(terms))])
        found = made.filter(F.col("id") == target).select(F.inline(rows))
        return asked.join(F.broadcast(found), "pos", "left").select("pos", "query_token", (F.coalesce("contribution", F.lit(0.0)) > 0).alias("matched"), F.coalesce("contribution", F.lit(0.0)).alias("contribution"))

    def explain_fuzzy(self, query: str, target) -> DataFrame:
        """pos, field, token, similarity and contribution in one document, from its postings."""
        asked = required_tokens(query)
        posted = self.table("postings").filter(F.col("id") == target)
        fields = F.filter(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in FUZZY_WEIGHTS]), lambda f: f.isNotNull())
        best = fuzzy.best_tokens(fuzzy.similar_tokens(posted.select("token", "id", F.explode(fields).alias("field")), asked))
        weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(w)) for f, w in FUZZY_WEIGHTS.items()])
        return best.select("pos", "field", "token", F.col("score").alias("similarity"), (F.col("score") * weight / len(asked) / fuzzy.WEIGHTS).alias("contribution"))

    def hybrid_keyword(self, query: str, top_k: int = 10) -> DataFrame:
        return hybrid.fuse_keyword_fuzzy(self.keyword(query, top_k), self.fuzzy(query, top_k), top_k)

    def hybrid_bm25(self, query: str, top_k: int = 10) -> DataFrame:
        return hybrid.fuse_lexical_fuzzy(self.bm25(query, top_k), self.fuzzy(query, top_k), top_k)
