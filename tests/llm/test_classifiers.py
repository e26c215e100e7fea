"""Toxicity and language ID: held-out accuracy and awkward tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgrid.llm import language_id, sampling, simhash, toxicity
from tests.llm.helpers import TEXTS, documents, empty

SYLLABLES = {"en": "the and ing er on at th is or ed", "de": "sch ung ein der ich ver keit au tz be", "fr": "eau que oi ent re ou le eux ai tion", "es": "ción os as que ar el la do mi ez"}


def prose(draw, lang, n, bad=()):
    words = []
    for _ in range(n):
        words.append("".join(draw.choice(SYLLABLES[lang].split()) for _ in range(draw.randrange(1, 4))))
    for _ in range(bool(bad) * max(1, n // 40)):
        words.insert(draw.randrange(len(words)), draw.choice(bad) + draw.choice(["", "ka", "lo", "mu"]))
    return " ".join(words)


def corpus(seed, count):
    draw = random.Random(seed)
    rows = []
    for i in range(count):
        lang = draw.choice(list(SYLLABLES))
        toxic = draw.random() < 0.25
        rows.append((i, prose(draw, lang, draw.randrange(20, 200), ("zuxif", "wobbeg", "gnafu") if toxic else ()), lang, int(toxic)))
    return rows


def test_toxicity_finds_held_out_stems(spark):
    rows = corpus(1, 900)
    df = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows if i % 3] + [(None, 1), (5_000, 1), (7, None)], "doc_id long, toxic int")
    truth = {i: y for i, _, _, y in rows}
    found = toxicity.classify(df, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    held = [(r.predicted, truth[r.doc_id]) for r in found if r.held_out]
    assert 0.2 < len(held) / len(rows) < 0.45
    assert np.mean([p == y for p, y in held]) > 0.97
    kept = toxicity.keep_clean(df.withColumn("score", F.lit("mine")), labels)
    assert kept.columns == ["doc_id", "text", "score"] and kept.filter("score = 'mine'").count() == sum(r.predicted == 0 for r in found)


def test_toxicity_awkward_tables(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.classify(documents(spark), none).collect()} == {0.0}
    assert toxicity.classify(empty(spark), none).count() == 0
    some = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (6, 0), (7, 0), (8, 1), (9, 0)], "doc_id long, toxic int")
    found = toxicity.classify(documents(spark), some).collect()
    assert len(found) == len(TEXTS) and len({r.score for r in found if r.doc_id in (3, 4, 5)}) == 1


def test_long_texts_are_read_whole(monkeypatch):
    rows = corpus(2, 300)
    found = {y: [w for _, t, _, z in rows if z == y for w in toxicity.windows(t)] for y in (0, 1)}
    trained = toxicity.train(found[1], found[0]).open()
    text = " ".join(t for _, t, _, _ in rows[:40])
    whole = trained.features([text, None, "x" * 5000])
    monkeypatch.setattr(toxicity, "PIECE", 500)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert np.allclose(toxicity.train(found[1], found[0]).open().features([text]), whole[:1])
    assert whole[1] == [0.0] * len(whole[1]) and whole[2][1] > 0


def test_savings_equal_a_plain_loop():
    import zstandard

    words = [w for _, t, _, _ in corpus(5, 60) for w in toxicity.windows(t)] + [b"x" * toxicity.WINDOW, "é".encode()]
    trained = toxicity.train([b"zuxifka", b"zuxiflo"] * 300 + words[:200], words).open()
    trained.learn(set(words))

    def codes(word):
        out = b""
        for end in range(2, len(word) + 3):
            seen = (b" " + word + b" ")[max(0, end - toxicity.CONTEXT) : end]
            one, _ = toxicity._codes([word])
            out += one[8 * (end - 2) : 8 * (end - 1)]
            again, _ = toxicity._codes([seen.strip() or b" "])
            if end <= toxicity.CONTEXT and end <= len(word) + 1:  # a code depends on what is before it only
                assert again[8 * (end - 2) : 8 * (end - 1)] == out[-8:]
        return out

    knobs = zstandard.ZstdCompressionParameters(
        window_log=20, hash_log=17, chain_log=18, search_log=6, min_match=6, target_length=64, strategy=zstandard.STRATEGY_BTOPT,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    for word in sorted(set(words))[::7]:
        lengths = []
        for content in (*trained.ordinary, *trained.toxic):
            held = zstandard.ZstdCompressionDict(content)
            held.precompute_compress(compression_params=knobs)
            lengths.append(len(zstandard.ZstdCompressor(dict_data=held, compression_params=knobs).compress(codes(word))))
        assert trained._known[word] == (lengths[0] + lengths[1] - lengths[2] - lengths[3]) / 2


def test_stages_never_empty_a_corpus(spark):
    docs = documents(spark)
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    assert toxicity.keep_clean(docs, ids.withColumn("toxic", F.lit(1))).count() == len(TEXTS)
    blind = docs.withColumn("lang", F.lit(None).cast("string"))
    lettered = sum(language_id.has_letter(t) for _, t, _, _ in TEXTS)
    assert language_id.keep_identified(blind).count() == lettered


def test_filter_stages_keep_all_columns(spark):
    names = ("_toxicity", "_toxic", "__toxic", "_language", "_language_score", "_language_near", "_language_rejected", "_row", "_lot")
    docs = documents(spark).withColumns({n: F.lit(f"my {n}") for n in names})
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 0), (7, 0), (8, 1), (9, 0)], "doc_id long, toxic int")
    for kept in (toxicity.keep_clean(docs, labels), language_id.keep_identified(docs), simhash.keep_one(docs)):
        assert kept.columns == docs.columns
        assert all(r[n] == f"my {n}" for r in kept.collect() for n in names)


def junk(n, letters, spaces):
    """Random letters, in words or without a space."""
    draw = random.Random(n)
    return "".join(" " if spaces and draw.random() < 0.15 else draw.choice(letters) for _ in range(300))


def test_junk_is_rejected_and_clean_texts_stay(spark):
    rows = [(i, t, k) for i, t, k, _ in corpus(4, 500)]
    every, rare = "abcdefghijklmnopqrstuvwxyz", "qxzjkwvyp"
    made = [(9000 + i, junk(i, (every, rare)[i % 2], i % 4 > 1), None) for i in range(60)]
    df = spark.createDataFrame(rows + made, "doc_id long, text string, lang string")
    found = language_id.classify(df).collect()
    kept = {r.doc_id for r in language_id.keep_identified(df).collect()}
    assert kept == {r.doc_id for r in found if not r.rejected}
    assert len({i for i, _, _ in rows} - kept) <= 2 and len({i for i, _, _ in made} & kept) <= 3
    model = language_id.fit(df)
    far = language_id.Model(model.languages, model.codes, model.table, model.scale, model.weights, limit=0.0)
    assert far.predict(rows[0][1])[3] and not model.predict(rows[0][1])[3]


def test_languages_held_out(spark):
    rows = corpus(3, 600)
    df = spark.createDataFrame([(i, t, k) for i, t, k, _ in rows], "doc_id long, text string, lang string")
    truth = {i: k for i, _, k, _ in rows}
    found = language_id.classify(df).collect()
    held = [r.lang_pred == truth[r.doc_id] for r in found if r.held_out]
    assert len(held) > 100 and np.mean(held) > 0.98
    again = {r.doc_id: r for r in language_id.classify(df).collect()}
    assert all(again[r.doc_id] == r for r in found)


def test_languages_awkward_tables(spark):
    found = {r.doc_id: r for r in language_id.classify(documents(spark)).collect()}
    assert len(language_id.classify(documents(spark)).collect()) == len(TEXTS)
    for i in (3, 4, 5, 10):
        assert (found[i].lang_pred, found[i].score, found[i].ambiguous) == ("und", 0.0, False)
    assert found[9].lang_pred in ("de", "en", "fr")
    assert language_id.classify(empty(spark)).count() == 0
    one = spark.createDataFrame([(i, "nur ein Text", "de") for i in range(8)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language_id.classify(one).collect()} == {("de", 1.0)}
    unknown = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language_id.classify(unknown).first().lang_pred == "und"
    kept = language_id.keep_identified(documents(spark))
    assert kept.columns == documents(spark).columns and {r.doc_id for r in kept.collect()} == {1, 2, 6, 7, 8, 9, None}


@pytest.mark.parametrize("count", [2, 3, 4, 5, 6, 9, 40, 300])
def test_codewords_differ(count):
    codes = language_id.codewords(count)
    columns = {tuple(c * c[0]) for c in codes.T}
    assert len(columns) == codes.shape[1] and (1.0,) * count not in columns
    apart = (codes[:, None] != codes[None]).sum(axis=2)
    assert apart[~np.eye(count, dtype=bool)].min() >= (1 if count == 2 else 2 ** (count - 2) if count <= 5 else codes.shape[1] // 5)


def test_decoding_corrects_a_bit():
    model = language_id.Model(list("abcd"), language_id.codewords(4), np.zeros((1, 7)), np.ones((2, 7)), np.ones(7))
    model.scale[1] = 0
    for i, code in enumerate(model.codes):
        for wrong in range(7):
            heard = code.copy() * 3
            heard[wrong] *= -1
            assert model.losses(heard).argmin() == i


def test_sample_is_bounded(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id % 10 = 0 THEN 'rare' ELSE 'hot' END AS kind")
    counts = {r.kind: r["count"] for r in sampling.per_label(df, "kind", 500, 1, "doc_id").groupBy("kind").count().collect()}
    assert 350 < counts["hot"] < 650 and 350 < counts["rare"] < 650


@pytest.mark.parametrize("clean", [True, False])
def test_calibration_settles(clean):
    draw = np.random.default_rng(12)
    y = (draw.random(400) < 0.1).astype(float)
    x = np.hstack([y[:, None] * 6 + draw.random((400, 1)) * (1 if clean else 9), draw.random((400, 5)) * 20, (y * 3)[:, None] * draw.random((400, 1)) ** 8])
    w = sampling.logistic(x, y)
    full = np.hstack([x, np.ones((400, 1))])
    p = 1 / (1 + np.exp(-full @ w))
    assert np.abs(full.T @ (p - y) + np.array([0.02] * 7 + [1e-6]) * w).max() < 1e-2
    assert abs(p.sum() - y.sum()) < 1 and (not clean or ((p >= 0.7) == y).all())
