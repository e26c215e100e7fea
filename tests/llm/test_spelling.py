"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusgrid.llm import spelling
from tests.llm.helpers import SCHEMA, documents, empty


def apart(x, y):
    """Whether two words are exactly one edit apart."""
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def plain(counts, ratio=5):
    near = {w: sorted((-counts[o], o) for o in counts if apart(w, o)) for w in counts}
    forms = {w: x[0][1] if x and -x[0][0] >= ratio * counts[w] else None for w, x in near.items()}
    out = []
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, len(near[w]), counts[forms[w]] if forms[w] else None))
    return sorted(out)


def words_of(rows, slips):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if slips and h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def found(spark, counts, crowd=spelling.CROWD):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    return sorted(map(tuple, spelling.variants(words, crowd=crowd).select("word", "form", "root", "n", "n_near", "form_n").collect()))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=8), min_size=1, max_size=40), st.integers(0, 4))
def test_automata_number_words_and_find_near_ones(words, exact):
    words = sorted(words)
    automaton = spelling.Automaton(words)
    assert [automaton.number(w) for w in words] == list(range(len(words)))
    assert automaton.number("zz") is None
    for w in words:
        first = w[: min(exact, len(w))]
        got = [words[k] for k, _, _ in automaton.near(w, len(first), len(w))]
        assert len(got) == len(set(got))
        assert set(got) == {o for o in words if apart(w, o) and len(o) >= len(w) and o.startswith(first)}


def test_automata_share_what_words_end_with():
    words = sorted(f"{a}{b}tions" for a in "abcdefgh" for b in "abcdefgh")
    assert len(spelling.Automaton(words).edges) == 8  # a path of states, however many words


def test_words_against_all_pairs(spark):
    draw = random.Random(3)
    counts = {"".join(draw.choice("abc") for _ in range(draw.randint(6, 9))): draw.choice((5, 6, 30, 200, 1500)) for _ in range(600)}
    counts |= {"a" * k: 5**k // 1000 for k in range(6, 12)} | {"réponse": 50, "reponse": 5, "rÉponse": 9, "x" * 3000: 8, "x" * 2999: 900}
    expected = plain(counts)
    assert max(e[4] for e in expected) > 5 and any(e[1] and e[2] != e[1] for e in expected)
    assert found(spark, counts) == expected


def test_crowded_groups_are_dealt_finer_without_loss(spark):
    """A third of the words and more begin alike, or end alike."""
    draw = random.Random(5)
    tails = {"".join(draw.choice("abcd") for _ in range(draw.randint(4, 6))) for _ in range(250)}
    counts = {f"preamble{t}": draw.choice((5, 40, 300)) for t in tails} | {f"{t}postamble": draw.choice((5, 40, 300)) for t in tails}
    finest = spelling.groups(spark.createDataFrame(list(counts.items()), "word string, n long"), 30)
    assert finest.filter("least - head - tail > 1").groupBy("group").count().filter("count > 30").isEmpty()
    assert finest.filter("head > 0 AND tail > 0").count() > 100
    assert found(spark, counts, crowd=30) == plain(counts)


def test_ties_go_to_the_smallest(spark):
    counts = {"spelling": 5, "spellinz": 25, "spellina": 25, "speling": 25}
    assert [(w, f, r) for w, f, r, *_ in found(spark, counts)] == [
        ("speling", None, "speling"), ("spellina", None, "spellina"), ("spelling", "speling", "speling"), ("spellinz", None, "spellinz")]


@pytest.mark.parametrize("slips", [0, 3])
def test_occurrences_of_awkward_texts(spark, slips):
    rows = [(1, "Wörter WÖRTER wörter " * 4, None, None), (None, "Wörter ÀÉÎ×÷ßÿÀÉ " * 3, None, None), (2, "abcdefghij" * 300 + " short abcdef", None, None), (3, None, None, None)]
    df = spark.createDataFrame(rows * 3, SCHEMA)
    kept = spelling.vocabulary(spelling.occurrences(df, slips))
    assert {r.word: r.n for r in kept.collect()} == words_of(rows * 3, slips)


def test_tables_of_tests(spark):
    for df in (documents(spark), empty(spark)):
        words = spelling.vocabulary(spelling.occurrences(df, 199))
        spelling.variants(words).collect()
    assert spelling.variants(spelling.vocabulary(spelling.occurrences(empty(spark), 199))).count() == 0
