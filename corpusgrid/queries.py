"""The registered queries over the driver's tables and their SQL.

Each query runs an operator over whole tables; the SQL states the same result independently.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusgrid.engine import Engine
from corpusgrid.functions import porter
from corpusgrid.functions.similarity import similarity
from corpusgrid.functions.text import round4, strip_markdown, tokens
from corpusgrid.operators import audit, enrich, explain, export, federation, fuzzy, graph, hybrid, keyring, keyword, lexical, metrics, navigation, privacy, rerank, semantic, sync
from corpusgrid.plans import stored
from corpusgrid.plans.concepts import from_documents
from corpusgrid.plans.postings import postings, vocabulary
from corpusgrid.runtime import checkpoint_dir, columnar, cut, ship, spread
from corpusgrid.sources import assets, bundle, keyed, projects, web
from corpusgrid.sources.tables import table
from corpusgrid.storage import extension_data, workspace
from corpusgrid.storage.collection import Collection
from corpusgrid.streaming import watch

KEYWORDS, PREFIXES, FUZZY, LEXICAL, PHRASE, WITHOUT = "the and", "th an", "worthles statin", "worthless atte", '"of the" idiot', "the -and idiot"
TARGET, TOP, SECRET = 7, 10, bytes(range(32))
#: A query whose tokens are like some of the explained document's.
LIKE = "erntr anous"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        _QUERIES[f.__name__] = run
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


# -- SQL fragments --------------------------------------------------------------------------------


def _tok(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def _r4(x: str) -> str:
    return f"round(({x}) * 10000) / 10000"


#: Bodies without Markdown's marks, step by step: fences, links and images, autolinks (closed or not), headings, emphasis.
_PLAIN_BODY = r"""translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '(?s)```[^\n]*(\n(.*?)(```([^\n]*\n)?|\z)|\z)', '\2', 'g'), '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '<https?://[^>]*>', '', 'g'), '<(https?://)', '\1', 'g'),
    '(?m)^#{1,6} ', '', 'g'), '*_~`', '')"""

CONCEPTS = f"""concepts AS (
  SELECT doc_id AS id, lang AS type, source, n_chars, text AS body, substr(split_part(text, chr(10), 1), 1, 60) AS title,
    substr(split_part(text, chr(10), 2), 1, 120) AS description,
    CASE WHEN n_chars < 500 THEN 'draft' WHEN n_chars < 5000 THEN 'stable' END AS status, {_PLAIN_BODY} AS plain
  FROM documents)"""

#: Letters outside ASCII as single bytes, for an edit distance that counts bytes.
_PLAIN = "translate({0}, 'éßçäóèñíêüöàáúùûôîâëïœæÿ', 'ABCDEFGHIJKLMNOPQRSTUVWX')"


def _grams(x: str) -> str:
    return f"list_transform(range(1, CAST(length({x}) + 1 AS BIGINT)), lambda i: substr('#' || {x} || '#', i, 3))"


def _similarity(q: str, t: str) -> str:
    a, b = _grams(q), _grams(t)
    ascii = f"(strlen({t}) = length({t}) AND length({t}) <= 62)"
    listed = f"2.0::DOUBLE * len(list_filter({a}, lambda x: list_contains({b}, x))) / (len({a}) + len({b}))"
    sets = f"2.0::DOUBLE * len(list_intersect(list_distinct({a}), list_distinct({b}))) / (len(list_distinct({a})) + len(list_distinct({b})))"
    edit = f"1 - levenshtein({q}, {_PLAIN.format(t)})::DOUBLE / greatest(length({q}), length({t}))"
    return f"""CASE WHEN {q} = {t} THEN 1.0::DOUBLE
      WHEN length({q}) < 3 OR length({t}) < 3 THEN CASE WHEN starts_with({q}, {t}) OR starts_with({t}, {q}) THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END
      ELSE greatest({edit}, CASE WHEN {ascii} THEN {listed} ELSE {sets} END) END"""


#: Each field's distinct tokens, bodies without Markdown's marks.
_FIELDS = " UNION ALL ".join(
    f"SELECT id, '{f}' AS field, unnest(list_distinct({_tok(c)})) AS token FROM concepts" for f, c in (("title", "title"), ("description", "description"), ("body", "plain"))
)


def _asked(query: str) -> str:
    rows = ", ".join(f"({i}, '{t}')" for i, t in enumerate(query.split()))
    return f"asked(pos, q) AS (VALUES {rows})"


def _keyword_sql(query: str) -> str:
    n = len(query.split())
    return f"""{CONCEPTS}, {_asked(query)},
  kw AS (SELECT id, unnest({_tok('title')}) AS token, generate_subscripts({_tok('title')}, 1) AS seq FROM concepts),
  hits AS (SELECT id, pos, token, seq, CASE WHEN token = q THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END AS score FROM kw JOIN asked ON starts_with(token, q)),
  best AS (SELECT *, row_number() OVER (PARTITION BY id, pos ORDER BY score DESC, seq) AS rn FROM hits),
  keyword AS (SELECT id, {_r4(f'sum(score) / {n}')} AS score, list_sort(list(DISTINCT token)) AS matched_keywords
    FROM best WHERE rn = 1 GROUP BY id HAVING count(*) = {n} ORDER BY score DESC, id LIMIT {TOP})"""


def _fuzzy_sql(query: str) -> str:
    n = len(query.split())
    def mean(f):
        return f"coalesce(sum(score) FILTER (WHERE field = '{f}'), 0.0) / {n}"
    return f"""{_asked(query)}, posted AS ({_FIELDS}),
  near AS (SELECT field, token, pos, s FROM (SELECT field, token, pos, q, {_similarity('q', 'token')} AS s FROM (SELECT DISTINCT field, token FROM posted) AS v, asked)
    WHERE s >= 0.55 AND (length(q) >= 3 OR starts_with(token, q))),
  ranked AS (SELECT id, field, pos, token, s AS score, row_number() OVER (PARTITION BY id, field, pos ORDER BY s DESC, token) AS rn
    FROM posted JOIN near USING (field, token)),
  best AS (SELECT * FROM ranked WHERE rn = 1),
  parts AS (SELECT id, {mean('title')} * 1.0 AS t, {mean('description')} * 0.6::DOUBLE AS d, {mean('body')} * 0.3::DOUBLE AS b FROM best GROUP BY id),
  fuzzy AS (SELECT id, {_r4('(t + d + b) / 1.9::DOUBLE')} AS score,
      list_sort(list_filter([CASE WHEN t / 1.9::DOUBLE > 0.05 THEN 'title' END, CASE WHEN d / 1.9::DOUBLE > 0.05 THEN 'description' END,
        CASE WHEN b / 1.9::DOUBLE > 0.05 THEN 'body' END], lambda f: f IS NOT NULL)) AS matched_fields
    FROM parts WHERE {_r4('(t + d + b) / 1.9::DOUBLE')} > 0 ORDER BY score DESC, id LIMIT {TOP})"""


def _count(tokens_: str, phrase: str) -> str:
    words = phrase.split()
    if len(words) == 1:
        return f"len(list_filter({tokens_}, lambda t: t = '{words[0]}'))"
    wanted = "[" + ", ".join(f"'{w}'" for w in words) + "]"
    return f"len(list_filter(range(1, greatest(len({tokens_}) - {len(words)} + 2, 1)), lambda i: {tokens_}[i:i + {len(words) - 1}] = {wanted}))"


def _lexical_sql(positive: list[str], negative: list[str] = []) -> str:  # noqa: B006
    weights = {"tt": 10, "tt2": 8, "td": 4, "tb": 1}
    def tf(p):
        return " + ".join(f"{w} * {_count(c, p)}" for c, w in weights.items())
    shown = "".join(f", CAST({tf(p)} AS DOUBLE) AS tf_{i}" for i, p in enumerate(positive))
    excluded = " OR ".join(f"({tf(p)}) > 0" for p in negative) or "false"
    stats = "".join(f", CAST(count(*) FILTER (WHERE tf_{i} > 0) AS DOUBLE) AS df_{i}" for i in range(len(positive)))
    parts = []
    for i in range(len(positive)):
        idf = f"CASE WHEN ln((n - df_{i} + 0.5) / (df_{i} + 0.5)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df_{i} + 0.5) / (df_{i} + 0.5)) END"
        parts.append(f"CASE WHEN tf_{i} > 0 THEN {idf} * (tf_{i} * 2.2::DOUBLE) / (tf_{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d / mean)) ELSE 0.0::DOUBLE END AS c_{i}")
    total = " + ".join(f"c_{i}" for i in range(len(positive)))
    return f"""split AS (SELECT id, {_tok('title')} AS tt, {_tok("array_to_string(" + _tok('title') + ", ' ')")} AS tt2, {_tok('description')} AS td, {_tok('plain')} AS tb FROM concepts),
  counted AS (SELECT id, CAST(len(tt) + len(tt2) + len(td) + len(tb) AS DOUBLE) AS d, {excluded} AS excluded{shown} FROM split),
  stats AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(d) AS mean{stats} FROM counted),
  made AS (SELECT counted.*, {', '.join(parts)} FROM counted, stats),
  raw AS (SELECT id, {total} AS raw_score FROM made WHERE NOT excluded AND {total} > 0 ORDER BY raw_score DESC, id LIMIT {TOP}),
  lexical AS (SELECT id, raw_score, {_r4('raw_score / max(raw_score) OVER ()')} AS score FROM raw)"""


# -- documents ------------------------------------------------------------------------------------


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_documents(spread(table(spark, sf_dir, "documents")))


def placed(ordered: DataFrame) -> DataFrame:
    """A sorted frame with each row's place from 1, counted without one task for all: rows are numbered within their
    partitions, which hold ranges, and the partitions' sizes (one number each) are added up."""
    kept = cut(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id() % (1 << 33)))
    sizes = {r["_part"]: r["count"] for r in kept.groupBy("_part").count().collect()}
    before, starts = 0, []
    for part in sorted(sizes):
        starts += [F.lit(part), F.lit(before)]
        before += sizes[part]
    start = F.create_map(*starts)[F.col("_part")] if starts else F.lit(0)
    return kept.withColumn("place", (start + F.col("_row") + 1).cast("long")).drop("_part", "_row")


def _lists(df: DataFrame) -> DataFrame:
    """Lists as text, for comparing."""
    return df.withColumns({c: F.array_join(c, ",") for c, kind in df.dtypes if kind == "array<string>"})


def _text(x: str) -> str:
    return f"coalesce(array_to_string({x}, ','), '')"


@_query(f"""WITH {_keyword_sql(KEYWORDS)}, {_fuzzy_sql(KEYWORDS).replace("asked(", "asked2(").replace("AS v, asked", "AS v, asked2").replace("best ", "best2 ")}
SELECT coalesce(k.id, f.id) AS id, coalesce(k.score, 0.0) AS keyword_score, coalesce(f.score, 0.0) AS fuzzy_score,
  {_r4('0.5 * coalesce(k.score, 0.0) + 0.5 * coalesce(f.score, 0.0)')} AS total_score, {_text('matched_keywords')} AS matched_keywords, {_text('matched_fields')} AS matched_fields
FROM keyword AS k FULL JOIN fuzzy AS f ON k.id = f.id ORDER BY total_score DESC, fuzzy_score DESC, keyword_score DESC, id LIMIT {TOP}""")
def hybrid_keyword_fuzzy(spark, sf_dir):
    """Keyword and fuzzy rankings fused (the flagship)."""
    return _lists(hybrid.hybrid_keyword(_concepts(spark, sf_dir), KEYWORDS, TOP))


@_query(f"""WITH {CONCEPTS} SELECT id, title, 'doc-' || id || '.md' AS path, type, status, source AS tags FROM concepts
WHERE type IN ('de', 'fr') AND source = 'src3' AND status = 'stable' ORDER BY id LIMIT 20""")
def doc_list_filtered(spark, sf_dir):
    """Any type, all tags, one status."""
    return _lists(navigation.list_concepts(_concepts(spark, sf_dir), ("de", "fr"), ("src3",), "stable"))


@_query(f"""WITH {CONCEPTS} SELECT id, title, description, type, status, body FROM concepts WHERE id = {TARGET}""")
def doc_show(spark, sf_dir):
    """One concept."""
    return navigation.show(_concepts(spark, sf_dir), TARGET).select("id", "title", "description", "type", "status", "body")


@_query(f"""WITH split AS (SELECT lang, {_tok('text')} AS t FROM documents)
SELECT lang, count(*) AS documents, CAST(sum(len(t)) AS BIGINT) AS tokens, CAST(max(len(t)) AS BIGINT) AS longest, CAST(sum(len(list_distinct(t))) AS BIGINT) AS distinct_tokens
FROM split GROUP BY lang""")
def doc_tokens_stats(spark, sf_dir):
    """Token counts by language."""
    split = table(spark, sf_dir, "documents").select("lang", tokens(F.col("text")).alias("t"))
    sizes = split.select("lang", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("d"))
    return sizes.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"), F.max("n").alias("longest"), F.sum("d").alias("distinct_tokens"))


@_query(f"""WITH {CONCEPTS}, posted AS ({_FIELDS}) SELECT field, token, count(*) AS documents FROM posted GROUP BY field, token""")
def vocab_df(spark, sf_dir):
    """Document frequencies of the whole vocabulary, by field."""
    return vocabulary(postings(_concepts(spark, sf_dir)))


@_query(f"""WITH {_keyword_sql(KEYWORDS)} SELECT id, score, {_text('matched_keywords')} AS matched_keywords FROM keyword""")
def keyword_search(spark, sf_dir):
    return _lists(keyword.keyword_search(_concepts(spark, sf_dir), KEYWORDS, TOP))


@_query(f"""WITH {_keyword_sql(PREFIXES)} SELECT id, score, {_text('matched_keywords')} AS matched_keywords FROM keyword""")
def keyword_search_prefix(spark, sf_dir):
    return _lists(keyword.keyword_search(_concepts(spark, sf_dir), PREFIXES, TOP))


@_query(f"""WITH {_keyword_sql(PREFIXES)} SELECT a.pos, a.q AS query_token, b.token AS matched_keyword, coalesce(b.score, 0.0) AS score
FROM asked AS a LEFT JOIN best AS b ON a.pos = b.pos AND b.rn = 1 AND b.id = {TARGET}""")
def keyword_explain(spark, sf_dir):
    return explain.explain_keyword(_concepts(spark, sf_dir), PREFIXES, TARGET)


@_query(f"""WITH {CONCEPTS}, {_asked(FUZZY)}, posted AS ({_FIELDS}), words AS (SELECT DISTINCT token FROM posted)
SELECT q AS query_token, token, {_r4(_similarity('q', 'token'))} AS similarity FROM words, asked""")
def token_similarity(spark, sf_dir):
    """Every token of the whole vocabulary against each query token."""
    words = postings(_concepts(spark, sf_dir)).select("token").distinct()
    each = F.array(*[F.struct(F.lit(q).alias("query_token"), round4(similarity(F.lit(q), F.col("token"))).alias("similarity")) for q in FUZZY.split()])
    return words.select("token", F.inline(each))


@_query(f"""WITH {CONCEPTS}, {_fuzzy_sql(FUZZY)} SELECT id, score, {_text('matched_fields')} AS matched_fields FROM fuzzy""")
def fuzzy_search(spark, sf_dir):
    return _lists(fuzzy.fuzzy_search(_concepts(spark, sf_dir), FUZZY, TOP).select("id", "score", "matched_fields"))


@_query(f"""WITH {CONCEPTS}, {_fuzzy_sql(LIKE)}
SELECT pos, field, token, score AS similarity, score * CASE field WHEN 'title' THEN 1.0::DOUBLE WHEN 'description' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END / 2 / 1.9::DOUBLE AS contribution
FROM best WHERE id = {TARGET}""")
def fuzzy_explain(spark, sf_dir):
    return explain.explain_fuzzy(_concepts(spark, sf_dir), LIKE, TARGET)


@_query(f"""WITH {CONCEPTS}, {_lexical_sql(LEXICAL.split())} SELECT id, raw_score, score FROM lexical""")
def bm25_search(spark, sf_dir):
    return lexical.lexical_search(_concepts(spark, sf_dir), LEXICAL, TOP)


@_query(f"""WITH {CONCEPTS}, {_lexical_sql(['of the', 'idiot'])} SELECT id, raw_score, score FROM lexical""")
def bm25_phrase(spark, sf_dir):
    return lexical.lexical_search(_concepts(spark, sf_dir), PHRASE, TOP)


@_query(f"""WITH {CONCEPTS}, {_lexical_sql(['the', 'idiot'], ['and'])} SELECT id, raw_score, score FROM lexical""")
def bm25_negative(spark, sf_dir):
    return lexical.lexical_search(_concepts(spark, sf_dir), WITHOUT, TOP)


@_query(f"""WITH {CONCEPTS}, {_lexical_sql(['of the', 'idiot'])}
SELECT 0 AS pos, 'of the' AS query_token, c_0 > 0 AS matched, c_0 AS contribution FROM made WHERE id = {TARGET}
UNION ALL SELECT 1, 'idiot', c_1 > 0, c_1 FROM made WHERE id = {TARGET}""")
def bm25_explain(spark, sf_dir):
    return explain.explain_lexical(_concepts(spark, sf_dir), PHRASE, TARGET).drop("fields")


def _held(phrases: list[str]) -> str:
    """Fields that hold a term."""
    columns = {"title": "tt", "keywords": "tt2", "description": "td", "body": "tb"}
    return "[" + ", ".join("CASE WHEN " + " OR ".join(f"{_count(c, x)} > 0" for x in phrases) + f" THEN '{f}' END" for f, c in columns.items()) + "]"


@_query(f"""WITH {CONCEPTS}, {_lexical_sql(['of the', 'idiot'])}, best AS (SELECT max(raw_score) AS best FROM raw),
  ranks AS (SELECT id, row_number() OVER (ORDER BY raw_score DESC, id) AS rank FROM raw)
SELECT m.id, CAST(c_0 + c_1 AS DOUBLE) AS raw_score, CAST(coalesce(r.rank, 0) AS INTEGER) AS rank, coalesce({_r4('(c_0 + c_1) / best')}, 0.0) AS score,
  array_to_string(list_sort(list_filter({_held(['of the', 'idiot'])}, lambda f: f IS NOT NULL)), ',') AS fields
FROM made AS m JOIN split USING (id) LEFT JOIN ranks AS r ON r.id = m.id, best WHERE m.id = {TARGET}""")
def bm25_explain_total(spark, sf_dir):
    """Raw score, rank and fields of one document, also outside the top."""
    return _lists(explain.explain_lexical_total(_concepts(spark, sf_dir), PHRASE, TARGET, TOP))


@_query()
def bm25_stemmed(spark, sf_dir):
    """BM25 over stemmed and folded tokens (a vectorised function; compared with an own index in tests)."""
    return lexical.lexical_search(_concepts(spark, sf_dir), LEXICAL, TOP, analyse=porter.analysed, analyzer=porter.analyse_tokens)


_BOTH = f"{CONCEPTS}, {_lexical_sql(LEXICAL.split())}, {_fuzzy_sql(LEXICAL)}"


@_query(f"""WITH {_BOTH}
SELECT coalesce(k.id, f.id) AS id, coalesce(k.score, 0.0) AS lexical_score, coalesce(f.score, 0.0) AS fuzzy_score,
  {_r4('0.5 * coalesce(k.score, 0.0) + 0.5 * coalesce(f.score, 0.0)')} AS total_score, {_text('matched_fields')} AS matched_fields
FROM lexical AS k FULL JOIN fuzzy AS f ON k.id = f.id ORDER BY total_score DESC, lexical_score DESC, fuzzy_score DESC, id LIMIT {TOP}""")
def hybrid_bm25_fuzzy(spark, sf_dir):
    return _lists(hybrid.hybrid_lexical(_concepts(spark, sf_dir), LEXICAL, TOP))


@_query(f"""WITH {_BOTH} SELECT c.id, coalesce(k.score, 0.0) AS lexical_score, coalesce(f.score, 0.0) AS fuzzy_score, 0.5::DOUBLE AS lexical_weight, 0.5::DOUBLE AS fuzzy_weight,
  {_r4('0.5 * coalesce(k.score, 0.0) + 0.5 * coalesce(f.score, 0.0)')} AS total_score
FROM concepts AS c LEFT JOIN lexical AS k ON c.id = k.id LEFT JOIN fuzzy AS f ON c.id = f.id WHERE c.id = {TARGET}""")
def hybrid_explain(spark, sf_dir):
    return explain.explain_hybrid(_concepts(spark, sf_dir), LEXICAL, TARGET, TOP)


@_query(f"""WITH {_keyword_sql("the")}, {_fuzzy_sql("the").replace("asked(", "asked2(").replace("AS v, asked", "AS v, asked2").replace("best ", "best2 ")}
SELECT c.id, coalesce(k.score, 0.0) AS keyword_score, coalesce(f.score, 0.0) AS fuzzy_score, 0.5::DOUBLE AS keyword_weight, 0.5::DOUBLE AS fuzzy_weight,
  {_r4('0.5 * coalesce(k.score, 0.0) + 0.5 * coalesce(f.score, 0.0)')} AS total_score
FROM concepts AS c LEFT JOIN keyword AS k ON c.id = k.id LEFT JOIN fuzzy AS f ON c.id = f.id WHERE c.id = {TARGET}""")
def hybrid_keyword_explain(spark, sf_dir):
    return explain.explain_hybrid_keyword(_concepts(spark, sf_dir), "the", TARGET, TOP)


def _blend_sql(weight: str) -> str:
    final = _r4(f"(1 - {weight}) * f.score + {weight} * coalesce(l.quality, 0)::DOUBLE")
    return f"""WITH {CONCEPTS}, {_fuzzy_sql(FUZZY)}
SELECT f.id, f.score, coalesce(l.quality, 0)::DOUBLE AS given_score, {final} AS final_score FROM fuzzy AS f LEFT JOIN labels AS l ON f.id = l.doc_id ORDER BY final_score DESC, f.id LIMIT {TOP}"""


def _given(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("given_score"))


@_query(_blend_sql("0.5::DOUBLE"))
def rerank_blend(spark, sf_dir):
    """A fuzzy ranking blended half and half with given scores."""
    hits = fuzzy.top(_concepts(spark, sf_dir), FUZZY, TOP).select("id", "score")
    return hybrid.blend(hits, _given(spark, sf_dir), 0.5, TOP)


@_query(_blend_sql("0.25::DOUBLE"))
def scorer_blend(spark, sf_dir):
    hits = fuzzy.top(_concepts(spark, sf_dir), FUZZY, TOP).select("id", "score")
    return hybrid.blend(hits, _given(spark, sf_dir), 0.25, TOP)


@_query(f"""WITH {CONCEPTS}, {_fuzzy_sql(FUZZY)}, core AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS core_rank FROM fuzzy),
  blended AS (SELECT core.*, coalesce(l.quality, 0)::DOUBLE AS given_score, {_r4('0.75::DOUBLE * score + 0.25::DOUBLE * coalesce(l.quality, 0)::DOUBLE')} AS final_score FROM core LEFT JOIN labels AS l ON id = l.doc_id),
  placed AS (SELECT *, row_number() OVER (ORDER BY final_score DESC, id) AS final_rank FROM blended)
SELECT id, score AS core_score, given_score, 0.75::DOUBLE AS core_weight, 0.25::DOUBLE AS given_weight, final_score, CAST(core_rank AS INTEGER) AS core_rank, CAST(final_rank AS INTEGER) AS final_rank
FROM placed WHERE core_rank = 2""")
def scorer_explain(spark, sf_dir):
    """The second of a fuzzy ranking: its own score, the given one, and its ranks before and after."""
    hits = fuzzy.top(_concepts(spark, sf_dir), FUZZY, TOP).select("id", "score")
    second = hits.orderBy(F.desc("score"), "id").limit(2).collect()[-1]["id"]
    return explain.explain_blend(hits, _given(spark, sf_dir), second, 0.25)


# -- vectors --------------------------------------------------------------------------------------

_KNN = "[0.25::DOUBLE, -0.5::DOUBLE" + ", 0.125::DOUBLE" * 62 + "]"
VECTOR = [0.25, -0.5] + [0.125] * 62


def _knn_sql(where: str) -> str:
    unit = "list_transform(embedding, lambda x: x::DOUBLE)"
    return f"""WITH v AS (SELECT vec_id, label, {unit} AS e FROM embeddings),
  n AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS size FROM v)
SELECT vec_id, {_r4(f"list_dot_product(e, {_KNN}) / size / sqrt(list_dot_product({_KNN}, {_KNN}))")} AS score FROM n WHERE size > 0{where} ORDER BY score DESC, vec_id LIMIT {TOP}"""


@_query(_knn_sql(""))
def semantic_knn(spark, sf_dir):
    return semantic.knn(table(spark, sf_dir, "embeddings"), VECTOR, TOP, "vec_id", "embedding")


@_query(_knn_sql(" AND label = 3"))
def semantic_knn_filtered(spark, sf_dir):
    return semantic.knn(table(spark, sf_dir, "embeddings").filter("label = 3"), VECTOR, TOP, "vec_id", "embedding")


@_query("""SELECT label, len(embedding) AS dim, count(*) AS rows, count(*) AS valid_rows FROM embeddings GROUP BY label, len(embedding)""")
def embedding_space_stats(spark, sf_dir):
    return semantic.spaces(table(spark, sf_dir, "embeddings"), "embedding", "label")


@_query("""SELECT 'EMBEDDING_STALE' AS code, 'warning' AS severity, '' AS source, CAST(vec_id AS VARCHAR) AS concept, '' AS target, 'embedding is older than the document' AS message
FROM embeddings JOIN documents AS now ON vec_id = now.doc_id JOIN documents AS made ON made.doc_id = vec_id - label % 2 WHERE sha256(now.text) <> sha256(made.text)""")
def embedding_stale(spark, sf_dir):
    """Embeddings whose recorded hash differs from the document's. Each was made from the document with its
    own id, or (odd labels) from the one before, whose text may be equal."""
    now = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), sync.content_hash("text").alias("content_hash"))
    made = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") - F.col("label") % 2).alias("id")).join(now, "id")
    return audit.findings(audit.stale_embeddings(made.select(F.col("vec_id").alias("id"), "content_hash"), now))


# -- graphs ---------------------------------------------------------------------------------------

PAGES = """page_concepts AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g') AS id,
    regexp_extract_all(html, 'href="([^"]*)"', 1) AS targets FROM pages),
  rows AS (SELECT page_id, id, unnest(targets) AS target, generate_subscripts(targets, 1) - 1 AS seq FROM page_concepts),
  aimed AS (SELECT *, CASE WHEN NOT (regexp_matches(target, '^[a-z][a-z0-9+.-]*:') OR starts_with(target, '#')) THEN
    nullif(regexp_replace(regexp_replace(target, '[#?].*$', ''), '^/+|/+$', '', 'g'), '') END AS resolved FROM rows),
  links AS (SELECT *, resolved IS NOT NULL AND resolved IN (SELECT id FROM page_concepts) AS resolves_in_bundle FROM aimed)"""
EDGES = """edges("from", "to", source, seq) AS (
  SELECT 'region/' || n_regionkey, 'nation/' || n_nationkey, 'parent_of', CAST(n_nationkey AS BIGINT) FROM nation
  UNION ALL SELECT 'nation/' || c_nationkey, 'customer/' || c_custkey, 'contains', c_custkey + 4294967296 FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey, 'depends_on', s_suppkey + 8589934592 FROM supplier),
  nodes(id, type, title) AS (SELECT 'region/' || r_regionkey, 'region', r_name FROM region UNION ALL SELECT 'nation/' || n_nationkey, 'nation', n_name FROM nation
    UNION ALL SELECT 'customer/' || c_custkey, 'customer', c_name FROM customer UNION ALL SELECT 'supplier/' || s_suppkey, 'supplier', s_name FROM supplier)"""


@_query(f"""WITH {PAGES} SELECT page_id, id, CAST(seq AS INTEGER) AS seq, target, resolved, resolves_in_bundle FROM links""")
def graph_links(spark, sf_dir):
    """Links of pages, resolved against the pages."""
    return web.page_links(web.page_concepts(table(spark, sf_dir, "pages"))).select("page_id", "id", "seq", "target", "resolved", "resolves_in_bundle")


@_query(f"""WITH {PAGES} SELECT page_id, id, target, resolved FROM links WHERE NOT resolves_in_bundle""")
def graph_dangling(spark, sf_dir):
    links = web.page_links(web.page_concepts(table(spark, sf_dir, "pages")))
    return links.filter("NOT resolves_in_bundle").select("page_id", "id", "target", "resolved")


@_query(f"""WITH {EDGES} SELECT "from", "to", source, seq FROM edges""")
def graph_edges(spark, sf_dir):
    """The typed graph, the first edge of each (from, to, kind)."""
    return graph.first_edges(keyed.trade_edges(spark, sf_dir)).select("from", "to", "source", "seq")


@_query(f"""WITH {EDGES} SELECT id, type, title, (SELECT count(*) FROM edges WHERE "to" = id) AS in_degree, (SELECT count(*) FROM edges WHERE "from" = id) AS out_degree FROM nodes""")
def graph_degrees(spark, sf_dir):
    return graph.degrees(keyed.trade_nodes(spark, sf_dir), keyed.trade_edges(spark, sf_dir))


@_query(f"""WITH {EDGES} SELECT "from", "to", source, CAST(row_number() OVER (ORDER BY "from", "to", source) AS BIGINT) AS place FROM edges""")
def graph_edges_ordered(spark, sf_dir):
    """The typed graph's edges in their order, each with its place."""
    ordered = graph.ordered_edges(graph.first_edges(keyed.trade_edges(spark, sf_dir)).select("from", "to", "source"))
    return placed(ordered)


@_query("""SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""")
def graph_orphans(spark, sf_dir):
    """Documents that no label refers to."""
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    edges = table(spark, sf_dir, "labels").select((-F.col("doc_id") - 1).alias("from"), F.col("doc_id").alias("to"))
    return graph.orphans(nodes, edges)


@_query(f"""WITH {EDGES} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT "from" FROM edges UNION SELECT "to" FROM edges)) AS orphans,
  (SELECT count(*) FROM edges) AS edges, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT source || '=' || count(*) AS k FROM edges GROUP BY source)) AS kinds""")
def graph_counts(spark, sf_dir):
    """Nodes, orphans, edges and edges by kind."""
    found = graph.counts(keyed.trade_nodes(spark, sf_dir), graph.first_edges(keyed.trade_edges(spark, sf_dir)))
    return found.withColumn("kinds", F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@_query(f"""WITH {EDGES} SELECT e."from" AS id, e.source, n.title FROM edges AS e JOIN nodes AS n ON n.id = e."from" WHERE e."to" = 'nation/3'""")
def graph_backlinks(spark, sf_dir):
    return graph.backlinks(keyed.trade_edges(spark, sf_dir), keyed.trade_nodes(spark, sf_dir), "nation/3")


@_query(f"""WITH {EDGES} SELECT "to" AS id FROM edges WHERE "from" = 'nation/3' UNION SELECT "from" FROM edges WHERE "to" = 'nation/3'""")
def graph_neighbors(spark, sf_dir):
    return graph.neighbors(keyed.trade_edges(spark, sf_dir), "nation/3")


_BOTHWAYS = """both_ways AS (SELECT "from" AS a, "to" AS b FROM edges UNION ALL SELECT "to", "from" FROM edges),
  d1 AS (SELECT DISTINCT b AS id FROM both_ways WHERE a = 'region/1' AND b <> 'region/1'),
  d2 AS (SELECT DISTINCT b AS id FROM both_ways JOIN d1 ON a = d1.id WHERE b <> 'region/1' AND b NOT IN (SELECT id FROM d1))"""


@_query(f"""WITH {EDGES}, {_BOTHWAYS} SELECT 'region/1' AS id, 0 AS depth UNION ALL SELECT id, 1 FROM d1 UNION ALL SELECT id, 2 FROM d2""")
def graph_relate_d2(spark, sf_dir):
    """Nodes within two steps of a region."""
    return graph.relate(keyed.trade_edges(spark, sf_dir), "region/1", "both", 2)[0].select("id", "depth")


@_query(f"""WITH {EDGES}, {_BOTHWAYS} SELECT "from", "to", source, CASE WHEN 'region/1' IN ("from", "to") THEN 1 ELSE 2 END AS depth FROM edges
WHERE 'region/1' IN ("from", "to") OR "from" IN (SELECT id FROM d1) OR "to" IN (SELECT id FROM d1)""")
def graph_relate_edges(spark, sf_dir):
    """Edges met within two steps, with their first depth."""
    return graph.relate(keyed.trade_edges(spark, sf_dir), "region/1", "both", 2)[1].drop("raw")


@_query(f"""WITH RECURSIVE {EDGES}, walk(id, path, depth) AS (
  SELECT 'supplier/1', ['supplier/1'], 0 UNION ALL SELECT e."to", list_append(path, e."to"), depth + 1 FROM walk JOIN edges AS e ON e."from" = walk.id WHERE depth < 3),
  one AS (SELECT path FROM walk WHERE id = (SELECT 'customer/' || min(c_custkey) FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_suppkey = 1) ORDER BY depth LIMIT 1)
SELECT CAST(step AS INTEGER) AS step, path[step + 1] AS id FROM one, range(len(path)) AS r(step)""")
def graph_path(spark, sf_dir):
    """The shortest directed path from a supplier to its nation's first customer."""
    nation = table(spark, sf_dir, "supplier").filter("s_suppkey = 1").select("s_nationkey")
    end = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("s_nationkey")).agg(F.min("c_custkey")).first()[0]
    path = graph.shortest_path(keyed.trade_edges(spark, sf_dir), "supplier/1", f"customer/{end}") or []
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("id")) for i, n in enumerate(path)])
    return spark.range(1).select(F.inline(rows))


@_query("""SELECT l_orderkey AS "from", l_suppkey AS "to", l_returnflag AS source, min(l_linenumber) AS seq FROM lineitem GROUP BY 1, 2, 3""")
def dedup_first_edge(spark, sf_dir):
    """The first line of each order, supplier and flag."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("from"), F.col("l_suppkey").alias("to"), F.col("l_returnflag").alias("source"), F.col("l_linenumber").alias("seq"))
    return graph.first_edges(lines)


# -- audit ----------------------------------------------------------------------------------------

_RULES = f"""{PAGES},
  validation AS (SELECT CAST(page_id AS VARCHAR) AS id, contains(html, '<title>') AS has_frontmatter, contains(html, '<html lang=') AS has_type, contains(html, '<article>') AS has_keywords FROM pages),
  linked AS (SELECT id AS e FROM links WHERE resolves_in_bundle UNION SELECT resolved FROM links WHERE resolves_in_bundle),
  findings AS (
    SELECT 'MISSING_FRONTMATTER' AS code, 'error' AS severity, '' AS source, id AS concept, '' AS target, 'file has no frontmatter' AS message FROM validation WHERE NOT has_frontmatter
    UNION ALL SELECT 'MISSING_TYPE', 'error', '', id, '', 'concept has no type' FROM validation WHERE has_frontmatter AND NOT has_type
    UNION ALL SELECT 'MISSING_KEYWORDS', 'error', '', id, '', 'concept has no keywords' FROM validation WHERE has_frontmatter AND NOT has_keywords
    UNION ALL SELECT 'DANGLING_EXTERNAL', 'info', id, '', target, 'external or non-bundle link' FROM links WHERE resolved IS NULL
    UNION ALL SELECT 'BROKEN_LINK', 'error', id, '', resolved, 'link target does not resolve in the bundle' FROM links WHERE resolved IS NOT NULL AND NOT resolves_in_bundle
    UNION ALL SELECT 'ORPHAN_CONCEPT', 'warning', '', id, '', 'concept has no incoming or outgoing edges' FROM page_concepts WHERE id NOT IN (SELECT e FROM linked)
    UNION ALL SELECT 'MISSING_INDEX_TARGET', 'error', 'index.md', '', 'doc-' || item_id, 'index entry points to an unknown concept' FROM benchmark
    UNION ALL SELECT 'UNINDEXED_CONCEPT', 'warning', '', id, '', 'concept is absent from the root index' FROM page_concepts)"""


def _audit(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    concepts = web.page_concepts(pages)
    links = web.page_links(concepts)
    html = F.col("html")
    validation = pages.select(F.col("page_id").cast("string").alias("id"), F.contains(html, F.lit("<title>")).alias("has_frontmatter"),
                              F.contains(html, F.lit("<html lang=")).alias("has_type"), F.contains(html, F.lit("<article>")).alias("has_keywords"))
    edges = links.filter("resolves_in_bundle").select(F.col("id").alias("from"), F.col("resolved").alias("to"))
    index = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("doc-"), F.col("item_id").cast("string")).alias("target"))
    return audit.findings(audit.validation_findings(validation) + audit.link_findings(links) + audit.orphan_findings(concepts, edges) + audit.index_findings(concepts, index))


@_query(f"""WITH {_RULES} SELECT * FROM findings""")
def audit_findings(spark, sf_dir):
    return audit.ordered(_audit(spark, sf_dir))


@_query(f"""WITH {_RULES} SELECT count(*) FILTER (WHERE code = 'ORPHAN_CONCEPT') AS orphans, count(*) FILTER (WHERE code = 'BROKEN_LINK') AS broken_links,
  count(*) FILTER (WHERE code = 'MISSING_KEYWORDS') AS missing_keywords, count(*) FILTER (WHERE code = 'MISSING_INDEX_TARGET') AS missing_index_targets,
  count(*) FILTER (WHERE code = 'UNINDEXED_CONCEPT') AS unindexed_concepts, count(*) FILTER (WHERE severity = 'error') AS errors,
  count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'info') AS infos FROM findings""")
def audit_summary(spark, sf_dir):
    return audit.summary(_audit(spark, sf_dir))


# -- synchronisation, federation, metrics ---------------------------------------------------------

_SIDES = """stored AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'old' ELSE sha256(text) END AS h FROM documents JOIN labels USING (doc_id)),
  scanned AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
  changes AS (SELECT coalesce(s.doc_id, n.doc_id) AS path, CASE WHEN s.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN s.h <> n.h THEN 'updated' ELSE 'skipped' END AS action
    FROM stored AS s FULL JOIN scanned AS n ON s.doc_id = n.doc_id)"""


def _changes(spark, sf_dir) -> DataFrame:
    """Two states of the table: labelled documents are stored, those of low quality with another hash;
    toxic ones are gone from the scan."""
    now = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), sync.content_hash("text").alias("content_hash"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), "quality", "toxic")
    stored = now.join(labels, "path").select("path", F.when(F.col("quality") == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"))
    return sync.diff(stored, now.join(labels.filter("toxic = 1"), "path", "left_anti"))


@_query(f"""WITH {_SIDES} SELECT path, action FROM changes""")
def sync_diff(spark, sf_dir):
    return _changes(spark, sf_dir)


@_query(f"""WITH {_SIDES} SELECT count(*) FILTER (WHERE action <> 'removed') AS documents, count(*) FILTER (WHERE action = 'added') AS added, count(*) FILTER (WHERE action = 'updated') AS updated,
  count(*) FILTER (WHERE action = 'removed') AS removed, count(*) FILTER (WHERE action = 'skipped') AS skipped FROM changes""")
def sync_report(spark, sf_dir):
    return sync.report(_changes(spark, sf_dir))


@_query("""SELECT doc_id AS id, sha256(text) AS content_hash, 'src-' || substr(sha256(source), 1, 16) AS source_id FROM documents""")
def hash_alias(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), sync.content_hash("text").alias("content_hash"), F.concat(F.lit("src-"), F.substr(F.sha2("source", 256), F.lit(1), F.lit(16))).alias("source_id"))


@_query(f"""WITH {_keyword_sql("an").replace(f"ORDER BY score DESC, id LIMIT {TOP})", ")")},
  ranked AS (SELECT k.id, k.score, coalesce(c.source, '') AS source, row_number() OVER (PARTITION BY coalesce(c.source, '') ORDER BY k.score DESC, k.id) AS rn FROM keyword AS k JOIN concepts AS c ON c.id = k.id)
SELECT id, score, source FROM ranked WHERE rn <= {TOP} ORDER BY score DESC, source, id LIMIT {TOP}""")
def federated_search(spark, sf_dir):
    """Each of the table's sources by itself (null is one of them); the rankings merged."""
    concepts = _concepts(spark, sf_dir)
    hits = keyword.scores(concepts, "an").select("id", "score").join(concepts.select("id", "tags"), "id")
    return federation.federated_by(hits, F.get("tags", 0), TOP).select("id", "score", "source")


_METRICS = f"""graded AS (SELECT source AS query, doc_id AS id, quality + 2 * toxic AS grade FROM labels JOIN documents USING (doc_id)),
  ranked AS (SELECT source AS query, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
  judged AS (SELECT r.query, r.rank, coalesce(g.grade, 0) AS grade FROM ranked AS r LEFT JOIN graded AS g ON r.query = g.query AND r.id = g.id WHERE rank <= 10),
  found AS (SELECT query, sum((pow(2.0, grade) - 1) / log2(rank + 1)) AS dcg, coalesce(max(CASE WHEN grade > 0 THEN 1.0::DOUBLE / rank END), 0.0) AS mrr FROM judged GROUP BY query),
  sorted AS (SELECT query, grade, row_number() OVER (PARTITION BY query ORDER BY grade DESC, id) AS rank FROM graded),
  best AS (SELECT query, sum((pow(2.0, grade) - 1) / log2(rank + 1)) AS ideal FROM sorted WHERE rank <= 10 GROUP BY query)"""


@_query(f"""WITH {_METRICS} SELECT best.query, {_r4('CASE WHEN ideal > 0 THEN coalesce(dcg, 0.0) / ideal ELSE 0.0 END')} AS ndcg, {_r4('coalesce(mrr, 0.0)')} AS mrr
FROM best LEFT JOIN found ON best.query = found.query""")
def relevance_ndcg(spark, sf_dir):
    """Each source's documents by length, judged by labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    order = W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    ranked = docs.select(F.col("source").alias("query"), F.col("doc_id").alias("id"), F.row_number().over(order).alias("rank"))
    grades = labels.join(docs.select("doc_id", "source"), "doc_id").select(F.col("source").alias("query"), F.col("doc_id").alias("id"), (F.col("quality") + 2 * F.col("toxic")).alias("grade"))
    return metrics.relevance(ranked, grades).select("query", round4(F.col("ndcg")).alias("ndcg"), round4(F.col("mrr")).alias("mrr"))


@_query("""WITH ranked AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) AS rank, count(*) OVER () AS n FROM lineitem WHERE l_extendedprice IS NOT NULL)
SELECT f AS fraction, n, CAST(x AS DOUBLE) AS value FROM ranked, (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) AS fractions(f) WHERE rank = greatest(1, ceil(f * n - 1e-9))""")
def price_percentiles(spark, sf_dir):
    """Exact percentiles of all lines' prices by nearest rank."""
    return metrics.nearest_ranks(table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.5, 0.95, 0.99])


# -- privacy and text -----------------------------------------------------------------------------


@_query("""SELECT doc_id AS id, text, true AS sealed FROM documents""")
def privacy_encrypt_roundtrip(spark, sf_dir):
    """Every text encrypted and decrypted again."""
    sealed = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", privacy.encrypt(F.col("text"), SECRET).alias("envelope"))
    return sealed.select("id", privacy.decrypt(F.col("envelope"), SECRET).alias("text"), F.startswith("envelope", F.lit(privacy.ENVELOPE)).alias("sealed"))


@_query()
def privacy_tokenize(spark, sf_dir):
    """Keyed names of every token (HMAC has no built-in form; held against the standard library in tests)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), privacy.tokenized(F.col("text"), SECRET).alias("tokens"), privacy.hashed(F.col("text"), SECRET).alias("hash"))


@_query(f"""SELECT doc_id AS id, {_PLAIN_BODY} AS text FROM documents""")
def strip_markdown_text(spark, sf_dir):
    """Every text without its Markdown marks, whole."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), strip_markdown(F.col("text")).alias("text"))


# -- files, extensions, streams -------------------------------------------------------------------


@_query("""SELECT 'd' || doc_id AS id, lang AS type, source AS keywords, 'T' || doc_id AS title, text AS body,
  sha256('---' || chr(10) || 'type: ' || lang || chr(10) || 'keywords: [' || source || ']' || chr(10) || 'title: T' || doc_id || chr(10) || '---' || chr(10) || text) AS content_hash FROM documents""")
def parse_frontmatter(spark, sf_dir):
    """Every text as a Markdown file with frontmatter, parsed."""
    docs = table(spark, sf_dir, "documents")
    front = F.concat(F.lit("---\ntype: "), "lang", F.lit("\nkeywords: ["), "source", F.lit("]\ntitle: T"), F.col("doc_id").cast("string"), F.lit("\n---\n"), "text").cast("binary")
    files = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), front.alias("content")).withColumn("length", F.octet_length("content"))
    return _lists(bundle.parse_files(files).select("id", "type", "keywords", "title", "body", "content_hash"))


@_query("""WITH rows AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)
SELECT page_id AS id, target, count(*) AS links FROM rows GROUP BY 1, 2""")
def markdown_links(spark, sf_dir):
    """Links of pages written as Markdown and read again by the link scanner."""
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    body = F.array_join(F.transform(hrefs, lambda h: F.concat(F.lit("[x](<"), h, F.lit(">) `[no](code)`"))), " ")
    pages = table(spark, sf_dir, "pages").select("page_id", body.alias("body"))
    files = pages.select(F.col("page_id").cast("string").alias("path"), F.concat(F.lit("---\n---\n"), "body").cast("binary").alias("content")).withColumn("length", F.octet_length("content"))
    links = bundle.parse_files(files).select(F.col("id").cast("bigint").alias("id"), F.explode("links.target").alias("target"))
    return links.groupBy("id", "target").agg(F.count(F.lit(1)).alias("links"))


#: Names of files, first bytes put before a page, what they are and whether they are text: stated by hand, not by the
#: tables of ``sources.assets``. A page is HTML, so a picture's name on it is contradicted by its content.
_FILES = [
    ("x.png", "", "text/html", True), ("x.jpg", "", "text/html", True), ("x.jpeg", "", "text/html", True), ("x.gif", "", "text/html", True), ("x.webp", "", "text/html", True), ("x.pdf", "", "text/html", True),
    ("x.txt", "", "text/plain", True), ("x.log", "", "text/plain", True), ("x.md", "", "text/plain", True), ("x.ini", "", "text/plain", True), ("x.csv", "", "text/csv", True),
    ("x.json", "", "application/json", True), ("x.xml", "", "application/xml", True), ("x.yaml", "", "application/x-yaml", True), ("x.yml", "", "application/x-yaml", True), ("x.toml", "", "application/toml", True),
    ("x.html", "", "text/html", True), ("x.htm", "", "text/html", True), ("x.css", "", "text/css", True), ("x.js", "", "application/javascript", True), ("x.jsx", "", "text/jsx", True),
    ("x.ts", "", "text/x-typescript", True), ("x.tsx", "", "text/x-typescript", True), ("x.go", "", "text/x-go", True), ("x.py", "", "text/x-python", True), ("x.rs", "", "text/x-rust", True),
    ("x.c", "", "text/x-c", True), ("x.h", "", "text/x-c", True), ("x.cc", "", "text/x-c++", True), ("x.cpp", "", "text/x-c++", True), ("x.cxx", "", "text/x-c++", True), ("x.hpp", "", "text/x-c++", True),
    ("x.hh", "", "text/x-c++", True), ("x.hxx", "", "text/x-c++", True), ("x.java", "", "text/x-java", True), ("x.scala", "", "text/x-scala", True), ("x.sc", "", "text/x-scala", True),
    ("x.dart", "", "text/x-dart", True), ("x.zig", "", "text/x-zig", True), ("x.sh", "", "text/x-shellscript", True), ("x.sql", "", "text/x-sql", True),
    ("x", "", "text/html", True), ("x.unknown", "", "text/html", True), (".hidden.PNG", "89504E470D0A1A0A00", "image/png", False), ("x.jpg", "FFD8FF", "image/jpeg", False),
    ("x.gif", "474946383961", "image/gif", True), ("x.pdf", "255044462D", "application/pdf", True), ("x.png", "1F8B08", "application/x-gzip", False), ("x.json", "00", "application/octet-stream", False),
    ("x", "504B0304", "application/zip", True), ("x.py", "FF", "application/octet-stream", False), ("x.webp", "52494646000000005745425056503820", "image/webp", False), ("x.csv", "0061736D", "application/wasm", False),
]
_FILE_ROWS = ", ".join(f"({i}, '{kind}', {str(text).lower()})" for i, (_, _, kind, text) in enumerate(_FILES))


@_query(f"""SELECT page_id AS id, kinds.media_type, kinds.is_text FROM pages JOIN (VALUES {_FILE_ROWS}) AS kinds(k, media_type, is_text) ON page_id % {len(_FILES)} = k""")
def media_types(spark, sf_dir):
    """Media types of pages as files: by extension, by first bytes, by content."""
    case = F.get(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(b).alias("first")) for n, b, _, _ in _FILES]), (F.col("page_id") % len(_FILES)).cast("int"))
    pages = table(spark, sf_dir, "pages").withColumn("case", case)
    files = pages.select(F.col("page_id").cast("string").alias("path"), "case.name", F.concat(F.unhex("case.first"), F.col("html").cast("binary")).alias("content"))
    return assets.detect_files(files).select(F.col("path").cast("bigint").alias("id"), "media_type", "is_text")


@_query("""SELECT doc_id AS id, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS size FROM documents""")
def codec_roundtrip(spark, sf_dir):
    """Texts packed with zstandard and unpacked again."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("content"), F.lit(False).alias("is_text"))
    back = assets.decode(assets.encode(docs, "zstd")).filter("warning IS NULL")
    return back.select("id", F.sha2("content", 256).alias("content_hash"), F.octet_length("content").cast("long").alias("size"))


_SCOPED = """ids AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g') AS id FROM pages)"""


@_query(f"""WITH {_SCOPED}, scopes(id, scope) AS (VALUES ('_s/en', 'en'), ('_s/de', 'de'), ('_s/x', 'e'))
SELECT s.id, i.id AS "to", 'contains' AS kind FROM scopes AS s JOIN ids AS i ON i.id = s.scope OR starts_with(i.id, s.scope || '/')""")
def scope_contains(spark, sf_dir):
    """Containment of paths in scopes, as an equi-join on each path's folders."""
    ids = web.page_concepts(table(spark, sf_dir, "pages")).select("id").distinct().withColumn("path", F.col("id"))
    rows = F.array(*[F.struct(F.lit(a).alias("id"), F.lit(b).alias("scope")) for a, b in (("_s/en", "en"), ("_s/de", "de"), ("_s/x", "e"))])
    scopes = spark.range(1).select(F.inline(rows))
    made = scopes.select("id", F.col("id").alias("path"))
    return export.synthetic_merge(ids, made, ids.select("path").limit(0), scopes)[1]


@_query(f"""WITH {_SCOPED}, rows AS (SELECT id, regexp_extract(id, '([^/]+)$', 1) AS entry, regexp_extract(id, '^(.*)/[^/]*$', 1) AS folder FROM ids WHERE contains(id, '/'))
SELECT r.id, r.entry, CASE WHEN folder || '/' || entry IN (SELECT id FROM ids) THEN folder || '/' || entry WHEN entry IN (SELECT id FROM ids) THEN entry END AS target FROM rows AS r""")
def related_targets(spark, sf_dir):
    """Bare names resolved beside the concept first, then as written."""
    ids = web.page_concepts(table(spark, sf_dir, "pages")).select("id").distinct()
    concepts = ids.withColumn("related", F.when(F.contains("id", F.lit("/")), F.array(F.regexp_extract("id", "([^/]+)$", 1))))
    return graph.resolve_related(concepts).select("id", "entry", "target")


@_query("""SELECT 'customer/' || o_custkey AS id FROM orders GROUP BY o_custkey HAVING count(*) > 1""")
def external_references(spark, sf_dir):
    """Outside documents kept where more than one relation refers to them."""
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")).alias("to"))
    made = orders.select(F.col("to").alias("id")).distinct().withColumn("external", F.lit(True))
    return export.external_documents(made, orders).select("id")


@_query("""SELECT sha256(text) AS sha256, 'blobs/' || doc_id AS path FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))""")
def extension_data_gc(spark, sf_dir):
    """Content-addressed files (every text) that nothing refers to: labels refer to their texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    files = docs.select("sha256", F.concat(F.lit("blobs/"), F.col("doc_id").cast("string")).alias("path"))
    return export.unreferenced(files, docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("sha256"))


@_query(f"""WITH {CONCEPTS}, split AS (SELECT id, {_tok('title')} AS t, {_tok('description')} AS d, {_tok('plain')} AS b FROM concepts),
  rows AS (SELECT id, unnest(t) AS token, 18.0::DOUBLE AS w FROM split UNION ALL SELECT id, unnest(d), 4.0::DOUBLE FROM split UNION ALL SELECT id, unnest(b), 1.0::DOUBLE FROM split)
SELECT token, id, sum(w) AS tf FROM rows GROUP BY token, id""")
def lexical_index(spark, sf_dir):
    """Weighted postings of the stored index (the keywords are the title's tokens, 10 + 8)."""
    return stored.lexical_postings(_concepts(spark, sf_dir))


def _folder(spark, name: str) -> str:
    """A folder of its own below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Folders of the indexes that this application has built, by its id and the tables' folder.
_BUILT: dict[tuple[str, str], str] = {}


def _index(spark, sf_dir) -> stored.Index:
    """A stored index of all documents, built by the first query that asks it and kept for the others."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        place = _folder(spark, "index")
        stored.build(_concepts(spark, sf_dir), place)
        _BUILT[key] = place
    return stored.Index(spark, _BUILT[key])


@_query(f"""WITH {_keyword_sql(PREFIXES)} SELECT id, score, {_text('matched_keywords')} AS matched_keywords FROM keyword""")
def stored_keyword(spark, sf_dir):
    return _lists(_index(spark, sf_dir).keyword(PREFIXES, TOP))


@_query(f"""WITH {CONCEPTS}, {_fuzzy_sql(FUZZY)} SELECT id, score, {_text('matched_fields')} AS matched_fields FROM fuzzy""")
def stored_fuzzy(spark, sf_dir):
    return _lists(_index(spark, sf_dir).fuzzy(FUZZY, TOP))


@_query(f"""WITH {CONCEPTS}, {_lexical_sql(LEXICAL.split())} SELECT id, raw_score, score FROM lexical""")
def stored_bm25(spark, sf_dir):
    return _index(spark, sf_dir).bm25(LEXICAL, TOP)


@_query(f"""WITH {_BOTH}
SELECT coalesce(k.id, f.id) AS id, coalesce(k.score, 0.0) AS lexical_score, coalesce(f.score, 0.0) AS fuzzy_score,
  {_r4('0.5 * coalesce(k.score, 0.0) + 0.5 * coalesce(f.score, 0.0)')} AS total_score, {_text('matched_fields')} AS matched_fields
FROM lexical AS k FULL JOIN fuzzy AS f ON k.id = f.id ORDER BY total_score DESC, lexical_score DESC, fuzzy_score DESC, id LIMIT {TOP}""")
def stored_hybrid(spark, sf_dir):
    return _lists(_index(spark, sf_dir).hybrid_bm25(LEXICAL, TOP))


@_query(f"""WITH {CONCEPTS}, {_lexical_sql(['of the', 'idiot'])} SELECT id, raw_score, score FROM lexical""")
def stored_phrase(spark, sf_dir):
    """A phrase, answered from the places of its tokens."""
    return _index(spark, sf_dir).bm25(PHRASE, TOP)


@_query(f"""WITH {CONCEPTS}, {_lexical_sql(['the', 'idiot'], ['and', 'of the'])} SELECT id, raw_score, score FROM lexical""")
def stored_negative(spark, sf_dir):
    """An excluded token and an excluded phrase."""
    return _index(spark, sf_dir).bm25(f'{WITHOUT} -"of the"', TOP)


#: A later state of the documents: those of low quality have other texts, toxic ones are gone, others came.
_LATER = """later AS (SELECT d.doc_id, CASE WHEN l.quality = 0 THEN text || ' of the idiot' ELSE text END AS text, lang, source, n_chars
  FROM documents AS d LEFT JOIN labels AS l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0)"""


def _states(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The documents before and after: first there are labelled ones only, later _LATER holds."""
    docs, labels = spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id", "left")
    other = F.when(F.col("quality") == 0, F.concat("text", F.lit(" of the idiot"))).otherwise(F.col("text"))
    later = joined.filter("coalesce(toxic, 0) = 0").withColumn("text", other).select(*docs.columns)
    return joined.filter("toxic IS NOT NULL OR quality IS NOT NULL").select(*docs.columns), later


@_query(f"""WITH {_LATER}, {CONCEPTS.replace("FROM documents", "FROM later")}, {_lexical_sql(['of the', 'idiot'])} SELECT id, raw_score, score FROM lexical""")
def stored_delta(spark, sf_dir):
    """An index of the labelled documents brought up to the later state by a change of its segments."""
    before, after = map(from_documents, _states(spark, sf_dir))
    place = _folder(spark, "index")
    stored.build(before, place)
    changes = sync.diff(before.select("id", F.sha2("body", 256).alias("content_hash")), after.select("id", F.sha2("body", 256).alias("content_hash")), "id")
    changes = cut(changes.filter("action <> 'skipped'"))
    stored.change(spark, place, changes.filter("action <> 'added'").select("id"), after.join(changes.filter("action <> 'removed'").select("id"), "id", "left_semi"))
    return stored.Index(spark, place).bm25(PHRASE, TOP)


def _linked(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Documents as scanned concepts: each links to the next one and to a third of its own id, and names twice its id."""
    n = F.col("doc_id")
    def name(x):
        return F.concat(F.lit("doc-"), x.cast("string"))
    aims = docs.select(n, F.posexplode(F.array(name(n + 1), name(F.floor(n / 3)))).alias("seq", "aim"))
    ids = known.select(name(F.col("doc_id")).alias("aim"), F.lit(True).alias("known"))
    link = F.struct(F.concat(F.lit("["), "aim", F.lit("]")).alias("raw"), F.concat("aim", F.lit(".md")).alias("target"), F.concat("aim", F.lit(".md")).alias("resolved"),
                    F.coalesce("known", F.lit(False)).alias("resolves_in_bundle"))
    links = aims.join(ids, "aim", "left").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", link.alias("link")))), lambda x: x["link"]).alias("links"))
    return docs.join(links, "doc_id").select(
        name(n).alias("id"), F.concat(name(n), F.lit(".md")).alias("path"), F.col("lang").alias("type"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("description"),
        F.array("source").alias("keywords"), F.col("text").alias("body"), F.array(name(n * 2)).alias("related"), F.sha2("text", 256).alias("content_hash"), "links")


@_query(f"""WITH {_LATER}, ids AS (SELECT doc_id FROM later), relations AS (SELECT doc_id, doc_id + 5 AS aim FROM labels WHERE doc_id IN (SELECT doc_id FROM ids) AND doc_id + 5 IN (SELECT doc_id FROM ids)),
  aims AS (SELECT doc_id, doc_id + 1 AS aim FROM later UNION SELECT doc_id, doc_id // 3 FROM later), known AS (SELECT *, aim IN (SELECT doc_id FROM ids) AS held FROM aims),
  named AS (SELECT doc_id, doc_id * 2 AS aim, doc_id * 2 IN (SELECT doc_id FROM ids) AS held FROM later),
  edges AS (SELECT doc_id, aim, 'link' AS kind, NOT held AS dangling FROM known UNION ALL SELECT doc_id, aim, CASE WHEN held THEN 'related' ELSE 'link' END, NOT held FROM named
    UNION ALL SELECT DISTINCT doc_id, aim, 'imports', false FROM relations)
SELECT 'doc-' || l.doc_id AS id, sha256(l.text) AS content_hash, count(*) FILTER (WHERE NOT dangling) AS edges, count(*) FILTER (WHERE dangling) AS dangling, count(*) FILTER (WHERE kind = 'imports') AS imports
FROM later AS l JOIN edges AS e ON e.doc_id = l.doc_id GROUP BY l.doc_id, l.text""")
def sync_store(spark, sf_dir):
    """A stored collection after adding, changing and removing documents, after removing all, and after the rest came
    back: each one's hash and edges. The relations were given once."""
    before, later = _states(spark, sf_dir)
    kept = Collection(spark, _folder(spark, "store"), "documents", indexed=False)
    def name(x):
        return F.concat(F.lit("doc-"), x.cast("string"))
    given = table(spark, sf_dir, "labels").select(name(F.col("doc_id")).alias("id"), name(F.col("doc_id") + 5).alias("to"), F.lit("imports").alias("kind"), F.lit(None).cast("string").alias("raw"), F.lit(0).cast("long").alias("seq"))
    kept.ingest(_linked(before, before), given)
    after = columnar(_linked(later, later))
    kept.sync(after)
    kept.sync(after.limit(0), given)
    kept.sync(after)
    return kept.read("concepts").select("id", "content_hash").join(
        kept.read("edges").groupBy(F.col("from").alias("id")).agg(F.count_if(~F.col("dangling")).alias("edges"), F.count_if("dangling").alias("dangling"), F.count_if(F.col("source") == "imports").alias("imports")), "id")


@_query("""SELECT 'text' AS extension, doc_id AS id, 'body' AS key, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size, 'text/plain' AS media_type, lang AS metadata, sha256(text) AS read_sha256
FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 UNION ALL
SELECT 'title', doc_id, 'first', sha256(split_part(text, chr(10), 1)), CAST(strlen(split_part(text, chr(10), 1)) AS BIGINT), 'text/plain', lang, sha256(split_part(text, chr(10), 1)) FROM documents JOIN labels USING (doc_id)""")
def extension_data_store(spark, sf_dir):
    """Two extensions' data of labelled documents stored, the toxic ones' texts replaced by nothing and swept, the rest read
    back by their digests."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").filter("toxic IS NOT NULL")
    first = F.substring_index("text", "\n", 1)
    def items(extension, key, text):
        return docs.select(F.lit(extension).alias("extension"), F.col("doc_id").alias("id"), F.lit(key).alias("key"), F.lit("text/plain").alias("media_type"), F.col("lang").alias("metadata"), text.cast("binary").alias("content"), "toxic")
    kept = Collection(spark, _folder(spark, "data"), "documents", indexed=False)
    extension_data.put(kept, items("text", "body", F.col("text")).unionByName(items("title", "first", first)).drop("toxic"))
    gone = items("text", "body", F.col("text")).filter("toxic = 1").drop("toxic")
    extension_data.remove(kept, gone.select("extension", "id"))
    extension_data.collect_garbage(kept)
    back = extension_data.fetched(kept, extension_data.listed(kept)).filter("warning IS NULL")
    return back.select(*extension_data.COLUMNS, F.sha2("content", 256).alias("read_sha256"))


@_query("""SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def watch_microbatch(spark, sf_dir):
    """The state after folding the events in micro-batches, a type each: each user's last event."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    state = events.limit(0)
    kinds = sorted((r[0] for r in events.select("event_type").distinct().collect()), key=lambda k: (k is None, k))
    for kind in kinds:
        state, _ = watch.fold_batch(state, events.filter(F.col("event_type").eqNullSafe(kind)), "user_id", "event_id")
    return state


@_query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def events_tumbling(spark, sf_dir):
    """Hourly windows by type (an extra)."""
    found = watch.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", "event_type")
    return found.withColumn("total", F.round("total", 4))


# -- what searches show, hide and keep ------------------------------------------------------------


@_query(f"""WITH {_BOTH.replace(_fuzzy_sql(LEXICAL), _fuzzy_sql(FUZZY))}, terms AS (SELECT id, list(DISTINCT token) AS t FROM best WHERE field = 'body' GROUP BY id),
  placed AS (SELECT f.id, f.score, c.title, plain, list_min(list_filter(list_transform(t, lambda x: instr(lower(plain), x)), lambda p: p > 0)) AS first, length(plain) AS whole
    FROM fuzzy AS f JOIN concepts AS c USING (id) LEFT JOIN terms USING (id)),
  cut AS (SELECT *, greatest(first - 41, 0) AS s, least(greatest(first - 41, 0) + 120, whole) AS e FROM placed)
SELECT id, title, score, CASE WHEN first IS NOT NULL THEN CASE WHEN s > 0 THEN '…' || substr(plain, s + 2, e - s - 1) ELSE substr(plain, 1, e) END || CASE WHEN e < whole THEN '…' ELSE '' END END AS snippet FROM cut""")
def search_snippets(spark, sf_dir):
    """A fuzzy ranking with titles and the text around its first match."""
    return fuzzy.fuzzy_search(_concepts(spark, sf_dir), FUZZY, TOP).select("id", "title", "score", "snippet")


@_query(f"""WITH {CONCEPTS}, {_lexical_sql(['of the', 'idiot'])}
SELECT 0 AS pos, 'of the' AS query_token, c_0 > 0 AS matched, c_0 AS contribution FROM made WHERE id = {TARGET}
UNION ALL SELECT 1, 'idiot', c_1 > 0, c_1 FROM made WHERE id = {TARGET}""")
def stored_bm25_explain(spark, sf_dir):
    """One document's terms, from the stored index."""
    return _index(spark, sf_dir).explain_bm25(PHRASE, TARGET)


@_query(f"""WITH {CONCEPTS}, {_fuzzy_sql(LIKE)}
SELECT pos, field, token, score AS similarity, score * CASE field WHEN 'title' THEN 1.0::DOUBLE WHEN 'description' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END / 2 / 1.9::DOUBLE AS contribution
FROM best WHERE id = {TARGET}""")
def stored_fuzzy_explain(spark, sf_dir):
    """One document's similar tokens, from the stored index."""
    return _index(spark, sf_dir).explain_fuzzy(LIKE, TARGET)


@_query(f"""WITH {CONCEPTS}, hits AS ({_knn_sql("")}) SELECT c.id, c.title, 'doc-' || c.id || '.md' AS path, c.type, h.score FROM hits AS h JOIN concepts AS c ON c.id = h.vec_id""")
def semantic_documents(spark, sf_dir):
    """The nearest embeddings with their documents."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return Engine(spark, _concepts(spark, sf_dir), embeddings=vectors).search("", "semantic", TOP, VECTOR)


@_query(f"""WITH {CONCEPTS}, whole AS (SELECT id, concat_ws(chr(10), title, description, body) AS t FROM concepts),
  ends AS (SELECT id, t, list_max(list_filter(range(0, least(length(t), 8192) + 1), lambda n: strlen(substr(t, 1, n)) <= 8192)) AS n FROM whole WHERE strlen(t) > 8192)
SELECT id, sha256(t) AS text_sha256, CAST(strlen(t) AS BIGINT) AS bytes FROM (SELECT id, t FROM whole WHERE strlen(t) <= 8192 UNION ALL SELECT id, substr(t, 1, n) FROM ends)""")
def embedding_texts(spark, sf_dir):
    """What an embedder is given of every document: its first 8 KiB, no character cut in two."""
    text = F.col("text")
    return semantic.embedding_text(_concepts(spark, sf_dir)).select("id", F.sha2(text, 256).alias("text_sha256"), F.octet_length(text).cast("long").alias("bytes"))


#: Each language's documents under another policy.
_POLICY = "CASE lang WHEN 'de' THEN 'encrypt' WHEN 'fr' THEN 'tokenize' WHEN 'es' THEN 'hash' ELSE 'none' END"


@_query(f"""WITH held AS (SELECT doc_id, {_POLICY} AS policy FROM documents)
SELECT 'keyword' AS ranking, doc_id AS id FROM held WHERE policy <> 'encrypt' UNION ALL SELECT 'lexical', doc_id FROM held WHERE policy <> 'encrypt' UNION ALL SELECT 'fuzzy', doc_id FROM held WHERE policy = 'none'""")
def privacy_visible(spark, sf_dir):
    """The documents that each ranking may index."""
    held = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.expr(_POLICY).alias("policy"))
    parts = [navigation.visible(held, r).select(F.lit(r).alias("ranking"), "id") for r in ("keyword", "lexical", "fuzzy")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query(f"""WITH {CONCEPTS}, held AS (SELECT *, {_POLICY.replace("lang", "type")} <> 'none' AND id % 3 <> 0 AS hidden FROM concepts)
SELECT id, CASE WHEN NOT hidden THEN title END AS title, CASE WHEN NOT hidden THEN description END AS description, CASE WHEN NOT hidden THEN sha256(body) END AS body_sha256 FROM held""")
def redacted_documents(spark, sf_dir):
    """Protected documents withheld from extensions, but where they allow it."""
    held = _concepts(spark, sf_dir).withColumn("policy", F.expr(_POLICY.replace("lang", "type"))).withColumn("allowed", F.col("id") % 3 == 0)
    return privacy.redacted(held, "policy", "allowed").select("id", "title", "description", F.sha2("body", 256).alias("body_sha256"))


@_query(f"""WITH {CONCEPTS}, lists AS (SELECT id, {_tok('title')} AS declared, list_concat([' '], list_transform({_tok('description')}, lambda t: ' ' || translate(t, 'aeiou', 'AEIOU'))) AS inferred FROM concepts),
  merged AS (SELECT id, list_concat(declared, list_filter(list_transform(inferred, lambda k: trim(k)), lambda k: k <> '' AND length(k) <= 128)) AS b FROM lists),
  low AS (SELECT id, b, list_transform(b, lambda k: lower(k)) AS l FROM merged)
SELECT id, coalesce(array_to_string(list_slice(list_filter(b, lambda k, i: list_position(l, lower(k)) = i), 1, 32), ','), '') AS keywords FROM low""")
def enriched_keywords(spark, sf_dir):
    """Declared keywords (the title's tokens) with inferred ones (the description's, in another case)."""
    other = F.transform(tokens(F.col("description")), lambda t: F.concat(F.lit(" "), F.translate(t, "aeiou", "AEIOU")))
    made = enrich.merge_keywords(F.col("keywords"), F.concat(F.array(F.lit(" ")), other))
    return _lists(_concepts(spark, sf_dir).select("id", made.alias("keywords")))


@_query("""SELECT vec_id AS id, label, sha256(made.text) AS content_hash FROM embeddings JOIN documents AS made ON made.doc_id = vec_id - label % 2
WHERE vec_id IN (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))""")
def carried_embeddings(spark, sf_dir):
    """Embeddings after the toxic documents are gone: the others stay, stale ones with their old hash."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("content_hash"))
    made = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "label", (F.col("vec_id") - F.col("label") % 2).alias("id")).join(docs, "id")
    left = docs.join(table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id")), "id", "left_anti")
    return sync.carried(made.select(F.col("key").alias("id"), "label", "content_hash"), left)


# -- parsing and findings of every kind -------------------------------------------------------------

#: Frontmatter of the documents by their id modulo six: fields of other kinds than expected.
_FRONTS = ["type: Note\ntags: [a, 2]\nkeywords: [x, y]\ntitle: 7\nstatus: stable", "type: [no]\ntags: one\nkeywords: [x, 3]\nstatus: odd\ndescription: true", "keywords: [x, ' ']\ntags: {a: 1}",
           "type: ''\nkeywords: word\nrelated: [u, 3, '']", "title: null\ntype: T", ""]


def _fronted(spark, sf_dir) -> DataFrame:
    """Documents as files; the last sixth has no frontmatter."""
    front = F.get(F.array(*map(F.lit, _FRONTS)), (F.col("doc_id") % 6).cast("int"))
    text = F.when(F.col("doc_id") % 6 == 5, F.col("text")).otherwise(F.concat(F.lit("---\n"), front, F.lit("\n---\n"), "text"))
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("n"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), text.cast("binary").alias("content"))
    return files.withColumn("length", F.octet_length("content"))


@_query("""WITH f(k, type, title, description, keywords, tags, status, related, has_type, has_keywords) AS (VALUES
  (0, 'Note', '7', NULL, 'x,y', 'a,2', 'stable', '', true, true), (1, '', NULL, 'true', '', 'one', NULL, '', false, false), (2, '', NULL, NULL, '', '', NULL, '', false, false),
  (3, '', NULL, NULL, '', '', NULL, 'u', false, false), (4, 'T', NULL, NULL, '', '', NULL, '', true, false))
SELECT 'n' || doc_id AS id, type, title, description, keywords, tags, status, related, has_type, has_keywords, true AS has_frontmatter, sha256(text) AS body_sha256 FROM documents JOIN f ON doc_id % 6 = k
UNION ALL SELECT 'n' || doc_id, NULL, NULL, NULL, '', '', NULL, '', false, false, false, NULL FROM documents WHERE doc_id % 6 = 5""")
def parse_fields(spark, sf_dir):
    """Fields of every kind, coerced or left out; files without frontmatter are no concepts."""
    parsed = _lists(bundle.parse_files(_fronted(spark, sf_dir)).select("id", "type", "title", "description", "keywords", "tags", "status", "related", "has_type", "has_keywords", "has_frontmatter", F.sha2("body", 256).alias("body_sha256")))
    return parsed.fillna("", ["keywords", "tags", "related"])


@_query("""SELECT 'n' || doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 'Note' WHEN 4 THEN 'T' ELSE 'Document' END AS type, doc_id % 6 <> 5 AS has_frontmatter,
  CASE doc_id % 6 WHEN 5 THEN 'missing frontmatter' WHEN 0 THEN '' WHEN 4 THEN 'missing keywords' ELSE 'missing type,missing keywords' END AS warnings,
  sha256(text) AS body_sha256 FROM documents WHERE NOT starts_with(text, '---')""")
def parse_permissive(spark, sf_dir):
    """The same files where missing fields are made up."""
    docs = table(spark, sf_dir, "documents").filter(~F.startswith("text", F.lit("---"))).select(F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("id"))
    parsed = bundle.parse_files(_fronted(spark, sf_dir), permissive=True).select("id", "type", "has_frontmatter", "warnings", F.sha2("body", 256).alias("body_sha256"))
    return _lists(parsed.join(docs, "id", "left_semi"))


@_query("""WITH rows AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) AS n FROM pages)
SELECT page_id AS id, target, count(*) AS links FROM rows WHERE NOT regexp_matches(target, '[\\s<>]') AND target <> '' GROUP BY 1, 2""")
def reference_links(spark, sf_dir):
    """Links of pages written as references, labels in another case and spacing than their definitions."""
    hrefs = F.filter(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), lambda h: ~h.rlike(r"[\s<>]") & (h != ""))
    said = F.array_join(F.transform(hrefs, lambda h, i: F.concat(F.lit("[x][Label  "), i.cast("string"), F.lit("]"))), " and ")
    named = F.array_join(F.transform(hrefs, lambda h, i: F.concat(F.lit("[lABEL "), i.cast("string"), F.lit("]: "), h, F.lit(" 'a title'"))), "\n")
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(said, F.lit("\n\n"), named).alias("body"))
    files = pages.select(F.col("page_id").cast("string").alias("path"), F.concat(F.lit("---\n---\n"), "body").cast("binary").alias("content")).withColumn("length", F.octet_length("content"))
    links = bundle.parse_files(files).select(F.col("id").cast("bigint").alias("id"), F.explode("links.target").alias("target"))
    return links.groupBy("id", "target").agg(F.count(F.lit(1)).alias("links"))


@_query("""WITH ids AS (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents)
SELECT 'BROKEN_RELATED' AS code, 'error' AS severity, CAST(doc_id AS VARCHAR) AS source, '' AS concept, CAST(doc_id * 2 AS VARCHAR) AS target, 'related target does not resolve in the bundle' AS message FROM documents WHERE CAST(doc_id * 2 AS VARCHAR) NOT IN (SELECT id FROM ids)
UNION ALL SELECT 'CODEC_MISSING', 'warning', '', CAST(doc_id AS VARCHAR), source, 'body codec ' || source || ' is not installed' FROM documents WHERE source NOT IN ('src1', 'src2') AND source IS NOT NULL
UNION ALL SELECT 'KEY_UNAVAILABLE', 'warning', 'doc-' || doc_id || '.md', CAST(doc_id AS VARCHAR), '', 'privacy key unavailable: ' || lang FROM documents WHERE lang NOT IN ('en', 'de')
UNION ALL SELECT 'EMBEDDING_INDEX_MISMATCH', 'warning', 'm' || label || '/64', '', '', 'embedding index does not match its source' FROM embeddings GROUP BY label HAVING count(*) FILTER (WHERE vec_id % 50 <> 0) <> count(*)
UNION ALL SELECT 'UNSUPPORTED_OKF_VERSION', 'warning', 'index.md', '', '', 'unsupported okf_version: ' || item_id FROM benchmark
UNION ALL SELECT 'EMPTY_BUNDLE', 'warning', '', '', '', 'empty bundle: ' || item_id FROM benchmark""")
def audit_codes(spark, sf_dir):
    """The findings that the other audit query has not: entries, codecs, keys, spaces and collection warnings."""
    docs = table(spark, sf_dir, "documents").withColumn("id", F.col("doc_id").cast("string"))
    related = docs.select("id", F.array((F.col("doc_id") * 2).cast("string")).alias("related"))
    keys = docs.select("id", F.concat(F.lit("doc-"), "id", F.lit(".md")).alias("path"), F.col("lang").alias("key_id"))
    vectors = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("m"), F.col("label").cast("string")).alias("model"), F.size("embedding").alias("dim"), "vec_id")
    def counted(rows):
        return rows.groupBy("model", "dim").agg(F.count(F.lit(1)).alias("rows"))
    item = F.col("item_id").cast("string")
    said = table(spark, sf_dir, "benchmark").select(F.explode(F.array(F.concat(F.lit("unsupported okf_version: "), item), F.concat(F.lit("empty bundle: "), item))).alias("warning"))
    return audit.findings(audit.related_findings(related) + audit.codec_findings(docs.select("id", F.col("source").alias("body_codec")), ("src1", "src2")) + audit.key_findings(keys, ("en", "de"))
                          + audit.embedding_counts(counted(vectors), counted(vectors.filter("vec_id % 50 <> 0"))) + audit.version_findings(said))


@_query("""WITH kept AS (SELECT l_orderkey, l_suppkey, l_returnflag FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderstatus = 'F')
SELECT 'o' || l_orderkey AS "from", 's' || l_suppkey AS "to", l_returnflag AS source FROM kept WHERE l_returnflag IN ('A', 'R') GROUP BY ALL""")
def relation_edges(spark, sf_dir):
    """Relations of lines from orders to suppliers: those whose ends exist, of two kinds."""
    def named(prefix, x):
        return F.concat(F.lit(prefix), F.col(x).cast("string"))
    lines = table(spark, sf_dir, "lineitem").select(named("o", "l_orderkey").alias("id"), named("s", "l_suppkey").alias("to"), F.col("l_returnflag").alias("kind"), F.lit(None).cast("string").alias("raw"), F.col("l_linenumber").cast("long").alias("seq"))
    ends = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(named("o", "o_orderkey").alias("id")).unionByName(table(spark, sf_dir, "supplier").select(named("s", "s_suppkey").alias("id")))
    nodes = ends.withColumn("links", F.array().cast("array<struct<raw:string,target:string,resolved:string,resolves_in_bundle:boolean>>"))
    return graph.only(graph.build_edges(nodes, lines), ("A", "R")).select("from", "to", "source")


@_query(f"""WITH {CONCEPTS} SELECT id, title, 'doc-' || id || '.md' AS path, type, status, coalesce(source, '') AS tags, type AS source FROM
  (SELECT *, row_number() OVER (PARTITION BY type ORDER BY id) AS n FROM concepts WHERE type IN ('de', 'en', 'fr')) WHERE n <= 20 ORDER BY type, id LIMIT 50""")
def federated_listing(spark, sf_dir):
    """The first documents of three sources, merged by source and id."""
    concepts = _concepts(spark, sf_dir)
    return _lists(federation.federated_list({a: concepts.filter(F.col("type") == a) for a in ("fr", "de", "en")}, navigation.list_concepts, 50))


@_query(f"""WITH {_SIDES}, langs AS (SELECT doc_id, lang FROM documents), each AS (SELECT lang AS source, count(*) FILTER (WHERE action <> 'removed') AS documents, count(*) FILTER (WHERE action = 'added') AS added,
    count(*) FILTER (WHERE action = 'updated') AS updated, count(*) FILTER (WHERE action = 'removed') AS removed, count(*) FILTER (WHERE action = 'skipped') AS skipped FROM changes JOIN langs ON path = doc_id WHERE lang IN ('de', 'en') GROUP BY lang)
SELECT * FROM each UNION ALL SELECT '*', sum(documents)::BIGINT, sum(added)::BIGINT, sum(updated)::BIGINT, sum(removed)::BIGINT, sum(skipped)::BIGINT FROM each""")
def federated_report(spark, sf_dir):
    """Sync reports of two sources and their sums."""
    changes = _changes(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "lang"), "path")
    return federation.merged_report({a: sync.report(changes.filter(F.col("lang") == a)) for a in ("de", "en")})


@_query("""SELECT 'n' || n_nationkey AS alias, CASE WHEN n_regionkey = 1 THEN 'new/' ELSE 'old/' END || n_name AS path, CASE WHEN n_regionkey = 1 THEN CAST(n_nationkey + 1 AS BIGINT) ELSE CAST(n_nationkey AS BIGINT) END AS generation
FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 'r' || r_regionkey, 'new/' || r_name, CAST(1 AS BIGINT) FROM region""")
def registry_upsert(spark, sf_dir):
    """A registry of sources after some were named again, others came and one region's went."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    none = F.lit(None).cast("string")
    def rows(frame, alias, path, generation):
        return frame.select(alias.alias("alias"), path.alias("path"), F.lit("ready").alias("status"), generation.cast("bigint").alias("generation"), F.lit(None).cast("bigint").alias("last_synced"), none.alias("content_hash"))
    alias = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    old = rows(nation, alias, F.concat(F.lit("old/"), "n_name"), F.col("n_nationkey"))
    again = rows(nation.filter("n_regionkey = 1"), alias, F.concat(F.lit("new/"), "n_name"), F.lit(None))
    came = rows(region, F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), F.concat(F.lit("new/"), "r_name"), F.lit(None))
    keep = [r[0] for r in nation.filter("n_regionkey <> 2").select(alias).collect()]  # the aliases of a manifest
    return federation.upsert_sources(federation.prune_sources(old, keep), again.unionByName(came)).select("alias", "path", "generation")


# -- files, keys, extensions and sources that fail -----------------------------------------------


@_query("""SELECT (page_id % 10) || '/p' || page_id || '.md' AS path, CAST(strlen(held) AS BIGINT) AS length, sha256(held) AS sha256
FROM (SELECT page_id, '---' || chr(10) || 'page: ' || page_id || chr(10) || '---' || chr(10) || coalesce(html, '') AS held FROM pages)""")
def exported_files(spark, sf_dir):
    """Every page rendered and written as a file by the tasks, then read back from the folder."""
    n = F.col("page_id").cast("string")
    path = F.concat((F.col("page_id") % 10).cast("string"), F.lit("/p"), n, F.lit(".md"))
    concepts = table(spark, sf_dir, "pages").select(path.alias("path"), F.to_json(F.struct(F.col("page_id").alias("page"))).alias("frontmatter"), F.col("html").alias("body"))
    root = _folder(spark, "files")
    export.write_files(spark, spread(export.unrendered(concepts)), root, {"collection": "pages"})
    return bundle.files(spark, root, "*.md").select("path", "length", F.sha2("content", 256).alias("sha256"))


class _MadeKeys(keyring.Provider):
    """Keys of the first ``newest`` versions."""

    name = "made"

    def __init__(self, newest: int):
        self.newest = newest

    def versions(self, key_id):
        return {v: bytes((b + v) % 256 for b in SECRET).hex() for v in range(1, self.newest + 1)} if key_id == "notes" else {}

    def key_ids(self):
        return ["notes"]


@_query("""SELECT doc_id, CASE WHEN text IS NOT NULL THEN sha256(text) END AS sha256, CASE WHEN text IS NOT NULL THEN 'enc:v2:notes:1' END AS sealed, CASE WHEN text IS NOT NULL THEN 'enc:v2:notes:2' END AS rewrapped,
  CASE WHEN text IS NOT NULL THEN true END AS same_box, CASE WHEN text IS NOT NULL THEN false END AS same_key FROM documents""")
def rotated_keys(spark, sf_dir):
    """All texts sealed with one version of a key, their data keys wrapped again by the next one, and opened."""
    def part(n):
        return F.sha2(F.split_part("text", F.lit(":"), F.lit(n)), 256)
    head = F.regexp_extract("text", r"\A((?:[^:]*:){3}[^:]*)", 1)
    # written: evaluating a sealing twice gives other keys
    first = cut(keyring.sealed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", _MadeKeys(1), "notes"))
    again = cut(keyring.rewrapped(first.withColumns({"sealed": head, "key": part(5), "box": part(6)}), "text", _MadeKeys(2)))
    seen = again.withColumns({"rewrapped": head, "same_box": part(6) == F.col("box"), "same_key": part(5) == F.col("key")})
    return keyring.opened(seen, "text", _MadeKeys(2)).select("doc_id", F.sha2("text", 256).alias("sha256"), "sealed", "rewrapped", "same_box", "same_key")


def _sevenths(query: str, shown: list[dict]) -> dict:
    return {c["id"]: c["id"] % 7 / 5 for c in shown}


def _even_fails(query: str, shown: list[dict]) -> dict:
    return {c["id"]: 1.0 for c in shown if c["id"] % 2 or 1 / 0}


@_query(f"""WITH {_keyword_sql("an").replace(f"LIMIT {TOP}", "LIMIT 100")}, core AS (SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM keyword),
  blended AS (SELECT *, {_r4('0.75::DOUBLE * score + 0.25::DOUBLE * least(1.0::DOUBLE, (id % 7)::DOUBLE / 5)')} AS final_score FROM core)
(SELECT 'sevenths' AS scorer, id, rank, final_score, false AS failed FROM blended ORDER BY final_score DESC, id LIMIT {TOP})
UNION ALL (SELECT 'fails', id, rank, score, true FROM core ORDER BY rank LIMIT {TOP})""")
def scored_candidates(spark, sf_dir):
    """A hundred candidates sent to a scorer in requests of 4 KB; and to one whose calls fail, which leaves the core order."""
    enrich.register("scorer", "sevenths", _sevenths)
    enrich.register("scorer", "fails", _even_fails)
    concepts = _concepts(spark, sf_dir)
    hits = cut(keyword.keyword_search(concepts, "an", rerank.candidate_count(TOP)).select("id", "score"))
    made = [rerank.rerank(hits, concepts, "an", TOP, scorer=name, most=4096).select(
        F.lit(name).alias("scorer"), "id", "rank", "final_score", F.col("warning").isNotNull().alias("failed")) for name in ("sevenths", "fails")]
    return made[0].unionByName(made[1])


def _sizes(files: list[dict]) -> dict:
    """An analyzer: of each file its length, its first characters as a symbol, and a module by its length; it leaves some out."""
    said = {"documents": [], "external_documents": [], "relations": []}
    for f in files:
        n = len(f["body"])
        if n % 11 == 0:
            continue
        symbol, module = f"_sym/{f['id']}", f"ext/{n % 997}"
        said["documents"].append({"id": f["id"], "type": "Code", "title": f"{n} characters", "symbols": [{"id": symbol, "type": "Symbol", "title": f["body"][:20]}]})
        said["external_documents"].append({"id": module, "type": "External", "title": "module"})
        said["relations"] += [{"from": f["id"], "to": symbol, "kind": "defines"}, {"from": f["id"], "to": module, "kind": " imports "}, {"from": f["id"], "to": "nowhere", "kind": "imports"}]
    return said


@_query("""WITH f AS (SELECT 'd' || doc_id AS id, text, length(text) AS n FROM documents WHERE length(text) % 11 <> 0)
SELECT id, 'Code' AS type, n || ' characters' AS title, CAST(0 AS BIGINT) AS relations FROM f UNION ALL SELECT '_sym/' || id, 'Symbol', substr(text, 1, 20), 1 FROM f
UNION ALL SELECT 'ext/' || (n % 997), 'External', 'module', count(*) FROM f GROUP BY n % 997 HAVING count(*) > 1""")
def analyzed_projects(spark, sf_dir):
    """Documents as files of small projects, analyzed and upserted twice: concepts and the relations that lead to each."""
    projects.register_analyzer("sizes", _sizes)
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    files = docs.select(F.floor(F.col("doc_id") / 8).cast("string").alias("project"), name.alias("id"), F.concat(name, F.lit(".md")).alias("path"), F.col("text").alias("body"))
    concepts = docs.select(name.alias("id"), F.concat(name, F.lit(".md")).alias("path"), F.col("lang").alias("type"), F.col("source").alias("title"))
    said = projects.analyze(files, "sizes")
    once, _ = projects.upsert(concepts, files, said)
    made, relations = projects.upsert(once.select(*concepts.columns), files, said)
    led = relations.groupBy(F.col("to").alias("id")).agg(F.count(F.lit(1)).alias("relations"))
    return made.select("id", "type", "title").join(led, "id", "left").fillna(0, ["relations"])


def _lost() -> DataFrame:
    raise RuntimeError("this source is not there")


@_query(f"""WITH {_keyword_sql("an").replace(f"ORDER BY score DESC, id LIMIT {TOP})", ")")},
  ranked AS (SELECT k.id, k.score, c.type AS source FROM keyword AS k JOIN concepts AS c ON c.id = k.id WHERE c.type IN ('de', 'en', 'fr') QUALIFY row_number() OVER (PARTITION BY c.type ORDER BY k.score DESC, k.id) <= {TOP}),
  merged AS (SELECT * FROM ranked ORDER BY score DESC, source, id LIMIT {TOP}),
  status AS (SELECT unnest(['de', 'en', 'fr', 'lost']) AS source)
SELECT source, CASE WHEN source = 'lost' THEN 'degraded' ELSE 'ok' END AS status, CASE WHEN source = 'lost' THEN 'RuntimeError: this source is not there' END AS message, id, score FROM status LEFT JOIN merged USING (source)""")
def isolated_search(spark, sf_dir):
    """Three sources and one that cannot be read: each one's status, and the merged ranking of the others."""
    concepts = _concepts(spark, sf_dir)
    sources = {a: (lambda a=a: concepts.filter(F.col("type") == a)) for a in ("fr", "de", "en")} | {"lost": _lost}
    hits, status = federation.search_isolated(spark, sources, lambda df: keyword.keyword_search(df, "an", TOP).select("id", "score"), TOP)
    return status.join(hits, "source", "left")


@_query("""SELECT event_id, event_type || '/' || (user_id % 3) AS media_type FROM events WHERE event_type = 'click' OR (event_type = 'view' AND user_id % 3 = 1)""")
def media_filtered(spark, sf_dir):
    """Rows of a whole family of types and of one exact type."""
    kinds = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit("/"), (F.col("user_id") % 3).cast("string")).alias("media_type"))
    return kinds.filter(assets.media_filter(F.col("media_type"), ("click/*", "view/1")))


@_query(f"""WITH {_LATER}, before AS (SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic IS NOT NULL OR quality IS NOT NULL))
SELECT 'n' || doc_id || '.md' AS path, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN l.doc_id IS NULL THEN 'removed' ELSE 'updated' END AS action
FROM (SELECT doc_id, coalesce(text, '') AS text, true AS held FROM before) AS b FULL JOIN (SELECT doc_id, coalesce(text, '') AS text FROM later) AS l USING (doc_id)
WHERE b.text IS DISTINCT FROM l.text""")
def watched_files(spark, sf_dir):
    """What a watcher tells of a folder of documents that reached a later state: the difference of two written listings."""
    listings = _folder(spark, "listings")
    roots = []
    for docs in _states(spark, sf_dir):
        roots.append(_folder(spark, "files"))
        export.write_files(spark, docs.select(F.concat(F.lit("n"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text"), roots[-1], {})
    watch.Listings(spark, roots[0], listings).start()
    return watch.Listings(spark, roots[1], listings).take(1).select("path", "action")


@_query(f"""WITH {_LATER}, before AS (SELECT doc_id, text, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic IS NOT NULL OR quality IS NOT NULL)),
  sides AS (SELECT doc_id, CASE WHEN coalesce(b.lang, l.lang) = 'en' THEN 'english' ELSE 'others' END AS alias, b.doc_id IS NOT NULL AS was, l.doc_id IS NOT NULL AS still, b.text IS NOT DISTINCT FROM l.text AS same
    FROM (SELECT doc_id AS k, * FROM before) AS b FULL JOIN (SELECT doc_id AS k, * FROM later) AS l USING (doc_id))
SELECT alias, 'ready' AS status, count(*) FILTER (WHERE still AND NOT was) AS added, count(*) FILTER (WHERE still AND was AND NOT same) AS updated, count(*) FILTER (WHERE was AND NOT still) AS removed,
  count(*) FILTER (WHERE was AND still AND same) AS skipped, CAST(2 AS BIGINT) AS generation, count(*) FILTER (WHERE still) AS documents FROM sides GROUP BY alias
UNION ALL SELECT 'lost', 'degraded', 0, 0, 0, 0, 2, NULL""")
def reconciled_workspace(spark, sf_dir):
    """A workspace of two sources, English documents and all others, and a source that cannot be read, reconciled with a first and a later
    state: what each one's last run did, its generation, and the documents that it stores."""
    made = [columnar(_linked(docs, docs)) for docs in _states(spark, sf_dir)]
    names = ("english", "others", "lost")
    manifest = workspace.Manifest(_folder(spark, "workspace"), {a: f"tables://{a}" for a in names}, "made")
    def opened(state: DataFrame):
        def open_(session, path):
            alias = path.rpartition("/")[2]
            return Engine(session, state.filter(F.col("type").eqNullSafe("en") == F.lit(alias == "english"))) if alias != "lost" else _lost()
        return open_
    for state in made:
        space = workspace.Workspace(spark, manifest, opened(state))
        told = space.reconcile()
    known = space.registry().select("alias", "generation").join(space.stats().select("alias", "documents"), "alias", "left")
    return told.drop("message").join(known, "alias")


QUERIES, SQL = dict(_QUERIES), dict(_SQL)
