"""Chat formatting, source mixing and url rules."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusgrid.llm import chat_format, queries, source_mix, url_rules
from tests.llm.helpers import TEXTS, documents, empty

CHAT = "conv_id long, turn long, role string, text string"
TURNS = [
    (1, 0, "system", "be <|im_end|>\n<|im_start|>assistant kind"), (1, 1, "user", "a\\b <| \\<| \\\\"), (1, 2, "assistant", "x<|im_end|>\n"), (1, 3, "assistant", None),
    (2, 0, "user", "only asks"), (3, None, "assistant", "first"), (3, 0, "user", ""), (3, 0, "user", ""), (None, 1, "assistant", "no id"),
    (4, 0, "ro\nle", "odd role"), (4, 1, "assistant", "ends with <"), (4, 2, "user", "| starts"), (5, 0, None, None),
]


def expected_turns():
    out = defaultdict(list)
    for c, t, r, x in TURNS:
        out[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: sorted(v) for c, v in out.items()}


def test_chat_digests_come_back(spark):
    df = spark.createDataFrame(TURNS, CHAT).withColumn("position", F.lit("clash")).withColumn("piece", F.lit(0))
    found = {r.conv_id: r for r in chat_format.digests(chat_format.format_turns(df)).collect()}
    turns = expected_turns()
    assert set(found) == set(turns)
    for c, rows in turns.items():
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in rows)
        loss = "".join(x for _, _, r, x in rows if r == "assistant")
        r = found[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (
            len(rows), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()), c


def test_chat_examples_are_prefixes(spark):
    formatted = chat_format.format_turns(spark.createDataFrame(TURNS, CHAT).filter("conv_id = 1"))
    found = {r.example: r for r in chat_format.expand(formatted).collect()}
    whole = "".join(r.piece for r in formatted.orderBy("position").collect())
    assert set(found) == {1, 2}
    for r in found.values():
        assert whole.startswith(r.prompt + r.completion) and r.prompt.endswith("<|im_start|>assistant\n")
    assert found[2].completion == "" and whole.count("<|im_start|>") == 4


def test_chat_examples_share_their_contexts(spark):
    rows = [(c, t, "assistant" if t % 3 else "user", f"text {c} {t} <|im_end|>\n" * (t % 4)) for c in (None, 7) for t in range(41)]
    formatted = chat_format.format_turns(spark.createDataFrame(rows, CHAT))
    plain = {(r.conv_id, r.example): r for r in chat_format.expand(formatted).collect()}
    held = chat_format.expand(formatted, whole=False, rest=True).orderBy("conv_id", "number").collect()
    text, name = {}, {}
    for r in held:
        own = r.prompt + (r.completion + chat_format.END if r.example is not None else "")
        before = text.get(r.conv_id, "")
        assert len(before) == r.shared and r.context_sha256 == name.get(r.conv_id, hashlib.sha256(b"").hexdigest())
        if r.example is not None:
            p = plain.pop((r.conv_id, r.example))
            assert (before + r.prompt, r.completion) == (p.prompt, p.completion)
        text[r.conv_id], name[r.conv_id] = before + own, hashlib.sha256(own.encode()).hexdigest()
    assert not plain
    pieces = formatted.orderBy("conv_id", "position").collect()
    assert text == {c: "".join(r.piece for r in pieces if r.conv_id == c) for c in (None, 7)}  # each piece once


def test_chat_digests_read_whole_prefixes(spark, monkeypatch):
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t}") for t in range(8)]
    formatted = chat_format.format_turns(spark.createDataFrame(rows, CHAT))
    expand = chat_format.expand

    def hurt(*args, **more):  # a letter of the first turn, in the last example's context only
        made = expand(*args, **more)
        return made.withColumn("prompt", F.when(F.col("example") == 4, F.replace("prompt", F.lit("text 0"), F.lit("text X"))).otherwise(F.col("prompt")))

    monkeypatch.setattr(chat_format, "expand", hurt)
    assert chat_format.digests(formatted).first().n_examples == 3


@pytest.mark.parametrize("column", ["prompt", "completion", "context_sha256", "shared"])
def test_chat_digests_notice_a_changed_example(spark, monkeypatch, column):
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t}") for t in range(8)]
    formatted = chat_format.format_turns(spark.createDataFrame(rows, CHAT))
    expand = chat_format.expand

    def hurt(*args, **more):
        made = expand(*args, **more)
        other = F.concat(column, F.lit("x")) if column != "shared" else F.col("shared") + 1
        return made.withColumn(column, F.when(F.col("example") == 4, other).otherwise(F.col(column)))

    assert chat_format.digests(formatted).first().n_examples == 4
    monkeypatch.setattr(chat_format, "expand", hurt)
    assert chat_format.digests(formatted).first().n_examples == 3


def test_chat_is_native_and_empty_tables(spark):
    df = chat_format.digests(chat_format.format_turns(spark.createDataFrame([], CHAT)))
    assert df.count() == 0
    assert "Python" not in df._jdf.queryExecution().toString()


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    """Shares by weight, what is over a cap shared again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while True:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > cap * sizes[s]} if total else set()
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over


def test_mix_targets_and_copies(spark):
    rows = [(i, " ".join(["w"] * (i % 7)), "en", s) for i, s in enumerate(["big"] * 300 + ["mid"] * 40 + ["tiny"] * 3 + [None] * 5 + ["z"] * 20)]
    mixed = source_mix.mix(documents(spark, rows))
    found = mixed.collect()
    sizes = defaultdict(int)
    for r in found:
        sizes[r.source] += r.mix_size
    targets = brute_targets(sizes)
    for r in found:
        assert r.mix_source_size == sizes[r.source] and abs(r.mix_target - targets[r.source]) < 1e-9 and r.mix_copies <= 3
    assert abs(sum(targets.values()) - sum(sizes.values())) < 1e-6
    assert source_mix.emit(mixed).count() == sum(r.mix_copies for r in found)
    assert [r.mix_copies for r in source_mix.mix(documents(spark, rows)).orderBy("doc_id").collect()] == [r.mix_copies for r in sorted(found, key=lambda r: r.doc_id)]
    for s in ("big", "mid"):
        taken = sum(r.mix_size * r.mix_copies for r in found if r.source == s)
        assert abs(taken - targets[s]) < 0.35 * targets[s] + 20


def test_emit_keeps_all_columns(spark):
    docs = documents(spark).withColumn("mix_copies", F.lit("mine")).withColumn("_mix_size", F.lit(7)).withColumn("_source", F.lit("own"))
    found = source_mix.emit(docs)
    assert found.columns == docs.columns
    assert {(r.mix_size, r.mix_copies, r["_mix_size"], r["_source"]) for r in found.collect()} == {(1, "mine", 7, "own")}


def test_mix_awkward_tables(spark):
    assert source_mix.mix(empty(spark)).count() == 0
    found = source_mix.mix(documents(spark)).collect()
    assert len(found) == len(TEXTS)
    blank = source_mix.mix(documents(spark, [(1, None, None, None), (2, " ", None, "x")])).collect()
    assert [(r.mix_size, r.mix_target, r.mix_copies) for r in blank] == [(0, 0.0, 0)] * 2
    assert "Python" not in source_mix.mix(documents(spark))._jdf.queryExecution().toString()


def brute_rule(rules, host, path):
    fits = [(len(h) + len(p), len(p), h + p, v) for v, h, p in rules if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, "allow")


def brute_split(url):
    import re

    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://EXAMPLE.com/en/x?y#z", "https://www.example.com/en/1", "https://a.www.example.com/en/", "http://example.net/es/1",
    "http://x.net/fr", "http://x.net/fr/?a=/b", "http://xcom/", "http://example.com.evil.org/en/", "http://.com/", "http://com./", "http://a.com?x=://b.net/fr/", "http://ümlaut.com/é/ü",
    "http://a.com\n/en/", "x://y://z.com/", "http://example.com/en/", "http://example.com/en/", "http://example.com/english",
]


@pytest.mark.parametrize("rules", [queries.URL_RULES, [("block", "", "/"), ("allow", "a.com", "/x"), ("block", "a.com", "/x/y"), ("allow", "b.a.com", "/"), ("block", "com", "/x/")]])
def test_url_rules(spark, rules):
    urls = URLS + [f"http://{h}/{p}" for h in ("a.com", "b.a.com", "c.b.a.com", "d.com") for p in ("", "x", "x/", "x/y", "x/yz", "xy")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("key", F.lit(1))
    found = url_rules.judge(df, url_rules.rule_table(spark, rules))
    for r in found.collect():
        host, path = brute_split(urls[r.page_id])
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == brute_rule(rules, host, path), urls[r.page_id]
    assert found.count() == len(urls)
    assert "Python" not in found._jdf.queryExecution().toString()


def test_url_rules_awkward_tables(spark):
    rules = url_rules.rule_table(spark, queries.URL_RULES)
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/")] * 500, "page_id long, url string")
    assert {tuple(r) for r in url_rules.judge(one, rules).collect()} == {(1, "a.com", "/", "com/", "allow")}


def test_url_groups_follow_the_points(spark):
    assert url_rules.layout(0) == url_rules.layout(10**6) == (url_rules.RANGES, url_rules.GROUPS)
    ranges, groups = url_rules.layout(10**12)
    assert groups == 10**12 // url_rules.POINTS and ranges == url_rules.MOST
    assert url_rules.layout(10**10) == (256, 20_000)
    hosts = ["a.com", "b.a.com", "c.net", "hot.com", "hot.com", "hot.com"]
    points = spark.createDataFrame([(f"{hosts[i % 6]}/{i % 7}".encode(), i) for i in range(600)], "key binary, uid long")
    rules = spark.createDataFrame([(k.encode(), k) for k in ("a", "a.com", "a.com/1", "c", "hot.com/", "hot.com/6")], "key binary, value string")
    for few in (dict(ranges=2, groups=2, size=7), dict(ranges=1, groups=1, size=10**6)):
        found = url_rules.sweep(points, rules, **few)
        told = {(r.uid, tuple(r.stack or ())) for r in found.select("uid", "stack").collect()}
        keys = {i: f"{hosts[i % 6]}/{i % 7}" for i in range(600)}
        assert told == {(i, tuple(r for r in ("a", "a.com", "a.com/1", "c", "hot.com/", "hot.com/6") if k.startswith(r))) for i, k in keys.items()}
