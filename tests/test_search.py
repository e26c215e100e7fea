"""Search operators against plain Python and an own full-text index."""

import random
import sqlite3

import pytest
import regex
from pyspark.sql import functions as F

from corpusgrid.errors import GridError
from corpusgrid.functions import porter
from corpusgrid.functions.similarity import near, similarity
from corpusgrid.functions.text import plain_text, round4, snippet, tokens
from corpusgrid.operators import explain, fuzzy, hybrid, keyword, lexical, metrics, navigation, semantic
from corpusgrid.plans import stored
from corpusgrid.plans.query_text import parse_terms

SCHEMA = "id string, path string, title string, description string, keywords array<string>, tags array<string>, type string, status string, body string"
ROWS = [
    ("concepts/graph", "Graph engine", "Walks edges", ["graph", "graph engine"], ["core"], "Node", "stable", "The graph engine rotates alpha beta nodes. Alpha beta again."),
    ("concepts/bundle", "Bundles", None, ["bundle", "graphs"], ["core", "io"], "Doc", "draft", "A bundle holds graph files, beta alpha."),
    ("notes/café", "Café notes", "Naïve tökens", ["café"], [], "Doc", None, "Tokens in a café: naïve résumé ½ tökn."),
    ("notes/empty", None, None, None, None, "Doc", None, None),
    ("notes/long", "Long", "", ["io"], ["io"], "Note", "stable", "x " * 300 + "token " + "y " * 300),
]


@pytest.fixture(scope="module")
def concepts(spark):
    return spark.createDataFrame([(i, i + ".md", *rest) for i, *rest in ROWS], SCHEMA)


def brute_similarity(a, b):
    if a == b:
        return 1.0
    if len(a) < 3 or len(b) < 3:
        return 0.75 if a.startswith(b) or b.startswith(a) else 0.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    grams = [[f"#{t}#"[i : i + 3] for i in range(len(t))] for t in (a, b)]
    if not (a.isascii() and b.isascii() and max(len(a), len(b)) <= 62):
        grams = [sorted(set(g)) for g in grams]
    shared = sum(g in grams[1] for g in grams[0])
    return max(1 - row[-1] / max(len(a), len(b)), 2 * shared / (len(grams[0]) + len(grams[1])))


def test_similarity(spark):
    draw = random.Random(1)
    words = ["token", "tokn", "auth", "oauth", "to", "t", "aaaa", "aaaaaa", "a" * 70, "a" * 65, "tökn", "té", "abc", "cba", "ab"]
    words += ["".join(draw.choice("abcé") for _ in range(draw.randrange(1, 9))) for _ in range(60)]
    pairs = [(a, b) for a in words for b in words]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity(F.col("a"), F.col("b")).alias("s"))
    for r in df.collect():
        assert abs(r.s - brute_similarity(r.a, r.b)) < 1e-12, (r.a, r.b)


def test_known_values(spark):
    one = spark.createDataFrame([("tokn", "token"), ("auth", "oauth"), ("to", "token")], "a string, b string")
    assert [r[0] for r in one.select(similarity(F.col("a"), F.col("b"))).collect()] == [0.8, 0.8, 0.75]
    assert spark.range(1).select(round4(F.lit(0.07895).cast("double"))).first()[0] == 0.079


def test_tokens(spark):
    text = "Ünï-Code ½ don't\tA1_b2 日本 " + "éx"
    found = spark.createDataFrame([(text,), (None,), ("--",)], "t string").select(tokens(F.col("t")).alias("x")).collect()
    assert [r.x for r in found] == [[t.lower() for t in regex.findall(r"[\p{L}\p{N}]+", text)], [], []]


def test_markdown_marks():
    text = "# Title\n#no\nA [label](x.md) and ![img](y.png) <https://a.b> *bold* `code` ~x~ [open\n```py\nkept *as is*\n```\nend ####### seven\n"
    assert plain_text(text) == "Title\n#no\nA label and img  bold code x [open\nkept *as is*\nend ####### seven\n"
    assert plain_text("a ```") == "a " and plain_text("x```\nrest") == "xrest"


def test_keyword(spark, concepts):
    found = keyword.keyword_search(concepts, "graph").collect()
    assert [(r.id, r.score, r.matched_keywords) for r in found] == [("concepts/graph", 1.0, ["graph"]), ("concepts/bundle", 0.75, ["graphs"])]
    assert [r.id for r in keyword.keyword_search(concepts, "graph eng").collect()] == ["concepts/graph"]
    assert keyword.keyword_search(concepts, "graph zzz").count() == 0
    for bad in (0, 101):
        with pytest.raises(GridError):
            keyword.keyword_search(concepts, "graph", bad)
    with pytest.raises(GridError):
        keyword.keyword_search(concepts, "--")


def brute_fuzzy(query):
    asked = [t.lower() for t in regex.findall(r"[\p{L}\p{N}]+", query)]
    out = {}
    for i, title, description, _, _, _, _, body in ROWS:
        total = 0.0
        for text, weight in ((title, 1.0), (description, 0.6), (body, 0.3)):
            words = {t.lower() for t in regex.findall(r"[\p{L}\p{N}]+", text or "")}
            best = [max([s for t in words if (len(q) >= 3 or t.startswith(q)) and (s := brute_similarity(q, t)) >= 0.55], default=0.0) for q in asked]
            total += sum(best) / len(asked) * weight
        if total:
            out[i] = round(total / 1.9 * 10000 + 1e-9) / 10000
    return out


@pytest.mark.parametrize("query", ["graph", "tokn graf", "caf", "al be", "bundl filez"])
def test_fuzzy(concepts, query):
    found = {r.id: r.score for r in fuzzy.fuzzy_search(concepts, query, 100).collect()}
    assert found == pytest.approx(brute_fuzzy(query), abs=1.01e-4)
    for i in found:
        parts = explain.explain_fuzzy(concepts, query, i).agg(F.sum("contribution")).first()[0]
        assert abs(parts - found[i]) < 1e-4


def test_snippets(spark, concepts):
    found = {r.id: r for r in fuzzy.fuzzy_search(concepts, "token").collect()}
    shown = found["notes/long"].snippet
    assert shown.startswith("…") and shown.endswith("…") and "token" in shown and len(shown) == 121
    short = spark.createDataFrame([("Alpha beta", ["beta"]), ("none", ["zzz"]), (None, ["a"])], "b string, t array<string>")
    assert [r[0] for r in short.select(snippet(F.col("b"), F.col("t"))).collect()] == ["Alpha beta", None, None]


def full_text(rows, tokenizer):
    made = sqlite3.connect(":memory:")
    made.execute(f"CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, title, keywords, description, body, tokenize='{tokenizer}')")
    made.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", [(i, t or "", " ".join(k or []), d or "", b or "") for i, t, d, k, _, _, _, b in rows])
    return made


CORPUS = [
    (f"d{i:03d}", " ".join(w[:2]), " ".join(w[2:4]), w[4:6], [], "t", None, " ".join(w[6:]))
    for i, w in enumerate([[random.Random(n).choice(["alpha", "beta", "gamma", "rotating", "rotate", "delta", "nodes", "cafe", "café"]) for _ in range(6 + n % 23)] for n in range(80)])
]


@pytest.mark.parametrize("query, match", [("alpha", '"alpha"'), ("alpha gamma", '"alpha" OR "gamma"'), ('"alpha beta" delta', '"alpha beta" OR "delta"'),
                                          ("alpha-beta", '"alpha-beta"'), ("alpha -delta", '"alpha" NOT "delta"'), ("rotates cafe", '"rotates" OR "cafe"')])
def test_lexical_equals_an_index(spark, query, match):
    rows = CORPUS + ROWS
    df = spark.createDataFrame([(i, i + ".md", *rest) for i, *rest in rows], SCHEMA)
    for tokenizer, options in (("unicode61 remove_diacritics 0", {}), ("porter unicode61", {"analyse": porter.analysed, "analyzer": porter.analyse_tokens})):
        expected = full_text(rows, tokenizer).execute("SELECT id, -bm25(t, 0.0, 10.0, 8.0, 4.0, 1.0) AS s FROM t WHERE t MATCH ? ORDER BY s DESC, id LIMIT 100", (match,)).fetchall()
        if tokenizer.startswith("unicode61") and "½" in query:
            continue
        found = [(r.id, r.raw_score) for r in lexical.lexical_search(df, query, 100, **options).collect()]
        assert {i for i, _ in found} == {i for i, _ in expected}, (query, tokenizer)
        assert dict(found) == pytest.approx(dict(expected), rel=1e-6)


def test_lexical_terms_and_explain(concepts):
    assert parse_terms('a "b c" -d -"e f" "" - x-y') == type(parse_terms(""))((("a",), ("b", "c"), ("x", "y")), (("d",), ("e", "f")))
    assert lexical.lexical_search(concepts, "-graph").count() == 0 and lexical.lexical_search(concepts, "").count() == 0
    hit = lexical.lexical_search(concepts, "alpha graph").filter("id = 'concepts/graph'").first()
    rows = explain.explain_lexical(concepts, "alpha graph", "concepts/graph").orderBy("pos").collect()
    assert abs(sum(r.contribution for r in rows) - hit.raw_score) < 1e-12 and rows[0].fields == ["body"]


def test_hybrid_fusion(concepts):
    found = hybrid.hybrid_keyword(concepts, "graph", 5).collect()
    assert (found[0].id, found[0].keyword_score, found[0].fuzzy_score) == ("concepts/graph", 1.0, 0.6842)
    assert all(r.total_score == pytest.approx(0.5 * r.keyword_score + 0.5 * r.fuzzy_score, abs=1e-4) for r in found)
    both = hybrid.hybrid_lexical(concepts, "graph", 5)
    best = both.first()
    assert explain.explain_hybrid(concepts, "graph", best.id, 5).first().total_score == best.total_score
    ranks = {r.id: r["rank"] for r in explain.rank_of(both, concepts, F.desc("total_score"), F.desc("lexical_score"), F.desc("fuzzy_score"), "id").collect()}
    assert ranks[best.id] == 1 and ranks["notes/empty"] == 0


def test_blend(spark):
    hits = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.8)], "id string, score double")
    given = spark.createDataFrame([("b", 5.0), ("c", None), ("z", 1.0)], "id string, given_score double")
    assert [(r.id, r.final_score) for r in hybrid.blend(hits, given, 0.5).collect()] == [("b", 0.9), ("a", 0.45), ("c", 0.4)]
    assert [r.id for r in hybrid.blend(hits, given, 0).collect()] == ["a", "b", "c"]
    with pytest.raises(GridError):
        hybrid.blend(hits, given, 2)


def test_navigation(concepts):
    assert [r.id for r in navigation.list_concepts(concepts, ("Node", "Doc"), ("core",)).collect()] == ["concepts/bundle", "concepts/graph"]
    assert [r.id for r in navigation.list_concepts(concepts, tags=("core", "io")).collect()] == ["concepts/bundle"]
    assert navigation.list_concepts(concepts, limit=0).count() == 5
    assert navigation.normalize_target(" /root/x/./a/b.MD ".replace("/./", "/"), "/root/x") == "a/b" and navigation.normalize_target("./a.md") == "a"
    with pytest.raises(GridError):
        navigation.require(concepts, "nope")


def test_semantic(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, [3.0, 3.0]), (5, [1.0]), (6, None), (7, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    assert [(r.id, r.score) for r in semantic.knn(df, [0.0, 5.0], 3).collect()] == [(2, 1.0), (4, 0.7071), (1, 0.0)]
    sizes = {r.dim: (r.rows, r.valid_rows) for r in semantic.spaces(df.filter("vector IS NOT NULL")).collect()}
    assert sizes == {2: (5, 3), 1: (1, 1)}
    with pytest.raises(GridError):
        semantic.knn(df, [0.0, 0.0])
    long = spark.createDataFrame([("a", "t", None, "é" * 5000)], "id string, title string, description string, body string")
    text = semantic.embedding_text(long).first().text
    assert len(text.encode()) in (8191, 8192) and text.startswith("t\né") and text.endswith("é")


def test_relevance(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("r", "a", 1)], "query string, id string, rank int")
    grades = spark.createDataFrame([("q", "b", 2), ("q", "z", 1), ("r", "z", 1), ("s", "a", 0)], "query string, id string, grade int")
    found = {r.query: (round(r.ndcg, 6), r.mrr) for r in metrics.relevance(ranked, grades).collect()}
    import math

    ideal = 3 + 1 / math.log2(3)
    assert found == {"q": (round(3 / math.log2(3) / ideal, 6), 0.5), "r": (0.0, 0.0), "s": (0.0, 0.0)}


def test_stored_index_answers_alike(spark, tmp_path):
    df = spark.createDataFrame([(i, i + ".md", *rest) for i, *rest in CORPUS + ROWS], SCHEMA)
    stored.build(df, str(tmp_path / "index"))
    index = stored.Index(spark, str(tmp_path / "index"))
    def rows(found, *columns):
        return [tuple(r[c] if not isinstance(r[c], float) else round(r[c], 9) for c in columns) for r in found.collect()]
    for query in ("alpha gamma", "rotat", "caf bet"):
        assert rows(index.keyword(query), "id", "score", "matched_keywords") == rows(keyword.keyword_search(df, query), "id", "score", "matched_keywords")
        assert rows(index.fuzzy(query), "id", "score", "matched_fields") == rows(fuzzy.fuzzy_search(df, query), "id", "score", "matched_fields")
    for query in ("alpha", "alpha gamma -delta", "alpha alpha beta", "-alpha", '"beta alpha" gamma', 'alpha -"alpha beta"', "graph-engine", '"x x x" token'):
        assert rows(index.bm25(query), "id", "raw_score", "score") == rows(lexical.lexical_search(df, query), "id", "raw_score", "score")
    assert rows(index.hybrid_bm25("alpha gamma"), "id", "total_score") == rows(hybrid.hybrid_lexical(df, "alpha gamma"), "id", "total_score")
    assert rows(index.hybrid_keyword("alpha"), "id", "total_score") == rows(hybrid.hybrid_keyword(df, "alpha"), "id", "total_score")
    for query in ('"alpha beta" graph', "alpha zzz"):
        told = explain.explain_lexical(df, query, "concepts/graph").drop("fields")
        assert rows(index.explain_bm25(query, "concepts/graph"), "pos", "query_token", "matched", "contribution") == rows(told.orderBy("pos"), "pos", "query_token", "matched", "contribution")
    told = rows(explain.explain_fuzzy(df, "graf tokn", "concepts/graph"), "pos", "field", "token", "similarity", "contribution")
    assert told and sorted(rows(index.explain_fuzzy("graf tokn", "concepts/graph"), "pos", "field", "token", "similarity", "contribution")) == sorted(told)


def test_near_is_similarity_from_the_threshold(spark):
    draw = random.Random(2)
    words = ["token", "to", "aaaa", "aaaaaa", "a" * 70, "a" * 63, "tökn", "té", "abc", "ab", "worthless"] + ["".join(draw.choice("abcé") for _ in range(draw.randrange(1, 9))) for _ in range(80)]
    df = spark.createDataFrame([(w,) for w in words], "t string")
    for q in words[:40]:
        for r in df.select("t", near(q, F.col("t")).alias("s")).collect():
            true = brute_similarity(q, r.t) if len(q) >= 3 or r.t.startswith(q) else 0.0
            assert abs(r.s - true) < 1e-12 if true >= 0.55 else r.s < 0.55, (q, r.t)


def test_bodies_are_searched_without_marks(spark):
    from corpusgrid.plans import stored
    from corpusgrid.plans.postings import postings

    rows = [(1, "a", "", [], "see [label](hidden/target.md) and snake_case <https://auto.link/x> *bold*"), (2, "b", "", [], "plain words and bold")]
    df = spark.createDataFrame(rows, "id long, title string, description string, keywords array<string>, body string")
    held = {r.token for r in postings(df).filter("field = 'body' AND id = 1").collect()}
    assert held == {"see", "label", "and", "snakecase", "bold"}
    assert {r.token for r in stored.lexical_postings(df).filter("id = 1 AND token <> 'a'").collect()} == held
    assert [r.id for r in lexical.lexical_search(df, "target").collect()] == [] and {r.id for r in lexical.lexical_search(df, "bold").collect()} == {1, 2}
    hit = fuzzy.fuzzy_search(df, "snakecase").collect()
    assert [(r.id, r.snippet) for r in hit] == [(1, "see label and snakecase  bold")]


def test_federation_holds_every_source(spark):
    from corpusgrid.operators import federation

    hits = spark.createDataFrame([(i, 1.0 - i / 100, s) for i, s in enumerate(["x"] * 5 + [None] * 5 + ["y"])], "id long, score double, origin string")
    found = federation.federated_by(hits, F.col("origin"), 3).collect()
    assert [(r.source, r.id) for r in found] == [("x", 0), ("x", 1), ("x", 2)]
    assert {r.source for r in federation.federated_by(hits, F.col("origin"), 11).collect()} == {"", "x", "y"}


def test_explanations_outside_the_top(spark, concepts):
    rows = explain.explain_lexical_total(concepts, "graph", "concepts/graph", 1).collect()
    assert len(rows) == 1 and rows[0]["rank"] in (0, 1) and rows[0].raw_score > 0 and "keywords" in rows[0].fields
    hits = spark.createDataFrame([(1, 0.9), (2, 0.5)], "id long, score double")
    given = spark.createDataFrame([(2, 1.0)], "id long, given_score double")
    row = explain.explain_blend(hits, given, 2, 0.75).first()
    assert (row.core_score, row.given_score, row.final_score, row.core_rank, row.final_rank) == (0.5, 1.0, 0.875, 2, 1)


def test_postings_are_gathered_within_a_row_and_shuffled_once(spark, monkeypatch):
    rows = [(i, "a title the", "the" if i % 3 else None, ["k the"], "the word w%d the" % (i % 5) if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, title string, description string, keywords array<string>, body string")
    held = stored.split(df)
    made = stored.positional(held, 6)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan
    expected = set()
    for i, title, description, _, body in rows:
        fields = {"title": title.split(), "keywords": ["k", "the"], "description": (description or "").split(), "body": (body or "").split()}
        for token in {t for words in fields.values() for t in words}:
            places = {f: tuple(n for n, t in enumerate(words) if t == token) for f, words in fields.items()}
            tf = sum(len(p) * stored.LEXICAL_WEIGHTS[f] for f, p in places.items())
            expected.add((token, i, tf, float(sum(map(len, fields.values()))), *[places[f] or None for f in stored.LEXICAL_WEIGHTS]))
    rows = made.withColumn("part", F.spark_partition_id()).collect()
    assert {(r.token, r.id, r.tf, r.tokens, *[tuple(r[f]) if r[f] else None for f in stored.LEXICAL_WEIGHTS]) for r in rows} == expected and len(rows) == len(expected)
    ranges = [[r.token for r in rows if r.part == p] for p in sorted({r.part for r in rows})]
    assert len(ranges) > 1 and all(a[-1] <= b[0] and a == sorted(a) for a, b in zip(ranges, ranges[1:]))
    # a token that fills several ranges is dealt over them
    monkeypatch.setattr(stored, "_bounds", lambda held, parts: ["a", "the", "the", "the", "word"])
    many = stored.positional(held, 6).filter("token = 'the'").groupBy(F.spark_partition_id()).count().collect()
    assert len(many) == 4 and max(r["count"] for r in many) < 100
    assert stored.positional(held.limit(0), 3).count() == 0
