import re

import numpy as np
import pytest
import xxhash

from corpusgrid.llm import components, simhash
from tests.llm.helpers import TEXTS, documents, empty


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest id reachable for each (id, fingerprint)."""
    fps = sorted({f for _, f in prints})
    label = {f: min(i for i, g in prints if g == f) for f in fps}
    changed = True
    array = np.array(fps, np.uint64)
    near = [(f, [fps[j] for j in np.flatnonzero(np.bitwise_count(array ^ np.uint64(f)) <= 3)]) for f in fps]
    while changed:
        changed = False
        for f, others in near:
            low = min(label[o] for o in others)
            if low < label[f]:
                label[f], changed = low, True
    return {i: label[f] for i, f in prints}


TEXT = "One two  three\tfour FIVE six\nseven É x\x0by ünï a\xa0b " * 3


@pytest.mark.parametrize("text", [None, "", " \n", "A", "A b", "A b C", "ÀB c", TEXT, "x" * 99])
def test_prints(text, monkeypatch):
    assert simhash.fingerprint(text) == brute_print(text)
    monkeypatch.setattr(simhash, "PIECE", 11)
    assert simhash.fingerprint(text) == brute_print(text)


def balls():
    draw = np.random.default_rng(3)
    out = []
    for size, radius in ((400, 2), (150, 3), (60, 6)):
        centre = int(draw.integers(0, 1 << 63))
        for _ in range(size):
            x = centre
            for b in draw.choice(64, draw.integers(0, radius + 1), replace=False):
                x ^= 1 << int(b)
            out.append(x)
    chain = int(draw.integers(0, 1 << 63))
    for step in range(20):  # a chain: only neighbours link
        for b in range(3):
            chain ^= 1 << (step * 3 + b)
        out.append(chain)
    out += [int(x) for x in draw.integers(0, 1 << 63, 300)] + [0, 7, (1 << 64) - 1]
    return [(100 + i, f) for i, f in enumerate(out)]


@pytest.mark.parametrize("crowd", [16_384, 60])
def test_components_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rows = balls()
    df = spark.createDataFrame([(i, simhash._signed(f)) for i, f in rows], "doc_id long, fp long")
    found = {r.fp: r.component_id for r in simhash.components(df).collect()}
    expected = brute_components(rows)
    assert all(found[simhash._signed(f)] == expected[i] for i, f in rows)


def test_pivots_only_discard(monkeypatch):
    fps = np.array([f for _, f in balls()], np.uint64)
    fps = np.unique(fps)
    left, right = simhash._links(np.zeros(len(fps), np.int64), fps)
    label = np.arange(len(fps))
    label[left] = right
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3):
            assert label[i] == label[j]


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_table(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "BROADCAST_IDS", most)
    found = simhash.classify(documents(spark)).collect()
    assert len(found) == len(TEXTS)
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, r)
    assert all(int(by_id[i].fingerprint, 16) == brute_print(t) for i, t, _, _ in TEXTS)
    assert by_id[2].component_id == 1 and by_id[4].component_id == by_id[5].component_id == 3 and by_id[9].component_id == 9
    assert simhash.classify(empty(spark)).count() == 0
    kept = simhash.keep_one(documents(spark))
    assert kept.columns == documents(spark).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted([(False, i) for i in (1, 3, 6, 7, 8, 9, 10)] + [(True, 0)])
    assert simhash.keep_one(empty(spark)).count() == 0


def test_stars_of_chains_and_loops(spark):
    rows = [(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 502), (502, 500), (7, 7), (900, 900), (1, 0)]
    found = {r.u: r.v for r in components.stars(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 201)} | {501: 500, 502: 500}
    assert components.stars(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_are_told_apart_by_all_columns(spark):
    words = ["alpha beta gamma delta", "one two three four", "red green blue white", "north south east west"]
    rows = [(1, words[0]), (5, words[1]), (5, words[2]), (7, words[3]), (7, words[3] + " more words follow here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(df).collect())) == sorted(rows)
    equal = spark.createDataFrame([(None, words[0]), (None, words[0]), (3, words[0])], "doc_id long, text string")
    assert [tuple(r) for r in simhash.keep_one(equal).collect()] == [(3, words[0])]
    unnamed = spark.createDataFrame([(None, words[0])] * 3 + [(None, words[1])], "doc_id long, text string")
    assert sorted(r.text for r in simhash.keep_one(unnamed).collect()) == sorted(words[:2])
    held = spark.createDataFrame([(1, words[0], {"a": [1]}), (1, words[0], {"a": [2]}), (1, words[0], {"a": [1]})], "doc_id long, text string, more map<string, array<int>>")
    assert simhash.keep_one(held).count() == 1


def test_any_three_blocks_cover_links():
    masks = simhash._masks()
    assert len(masks) == 20 and all(30 <= m.bit_count() <= 34 for m in masks)
    draw = np.random.default_rng(9)
    for _ in range(300):
        x = int(draw.integers(0, 1 << 63))
        y = x
        for b in draw.choice(64, 3, replace=False):
            y ^= 1 << int(b)
        shared = [m for m in masks if x & m == y & m]
        assert shared
        for m in shared:
            inner = simhash._masks(m ^ ((1 << 64) - 1))
            assert all(n & m == 0 and (m | n).bit_count() >= 46 for n in inner) and any((x ^ y) & n == 0 for n in inner)
