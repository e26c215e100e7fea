import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgrid.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def table(spark, vectors):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in vectors], SCHEMA)
    return df.withColumn("score", F.lit("clash")).withColumn("rank", F.lit(1)).withColumn("bucket", F.lit(0))


def brute(vectors, every, k=10):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], np.float32).astype(np.float64)
    out = {}
    for q in ids[ids % every == 0]:
        score = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, score)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), score[j]) for j in order]
    return out


@pytest.mark.parametrize("kind", ["sphere", "clusters", "copies"])
def test_recall_and_exact_scores(spark, kind):
    draw = np.random.default_rng(1)
    x = draw.standard_normal((3000, 24))
    if kind == "clusters":
        x = draw.standard_normal((60, 24))[draw.integers(0, 60, 3000)] * 4 + x
    if kind == "copies":
        x[500:1700] = x[500]
    vectors = list(enumerate(x))
    expected = brute(vectors, 50)
    found = {}
    for r in ann.search(table(spark, vectors), 50).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(expected)
    true = {q: dict(v) for q, v in brute(vectors, 50, 3000).items()}
    hits = 0
    for q, rows in found.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 11))
        assert [v for _, v, _ in rows] == [v for v, _ in sorted(((v, s) for _, v, s in rows), key=lambda z: (z[1], z[0]))]
        assert all(abs(s - true[q][v]) < 1e-12 for _, v, s in rows)
        hits += len({v for _, v, _ in rows} & {v for v, _ in expected[q]})
    assert hits / sum(map(len, expected.values())) >= 0.9
    if kind == "copies":
        assert [v for v, _ in expected[500]] == [v for _, v, _ in sorted(found[500])]


def test_rows_that_take_no_part(spark):
    good = [(100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (200, [5.0, 5.0])]
    bad = [(300, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [1.0]), (9, [])]
    found = sorted(tuple(r) for r in ann.search(table(spark, good + bad), 100).collect())
    near = np.sqrt(2.0)
    assert [(q, r, v) for q, r, v, _ in found] == [(100, 1, 1), (100, 2, 2), (100, 3, 200), (200, 1, 1), (200, 2, 2), (200, 3, 100)]
    assert abs(found[0][3] - near) < 1e-12
    again = ann.search(table(spark, good + good), 100)
    assert sorted(tuple(r) for r in again.collect()) == found


def test_a_row_repeated_many_times_counts_once(spark):
    draw = np.random.default_rng(2)
    vectors = list(enumerate(draw.standard_normal((300, 4))))
    plain = sorted(tuple(r) for r in ann.search(table(spark, vectors), 100).collect())
    nearest = {q: v for q, r, v, _ in plain if r == 1}
    repeated = vectors + [vectors[v] for v in nearest.values() for _ in range(200)]
    found = sorted(tuple(r) for r in ann.search(table(spark, repeated), 100).collect())
    assert len(found) == 30 and all(len({v for q, _, v, _ in found if q == a}) == 10 for a in nearest)


def test_empty_tables(spark):
    assert ann.search(table(spark, []), 100).count() == 0
    assert ann.search(table(spark, [(1, [1.0, 2.0])]), 100).count() == 0
    assert ann.search(table(spark, [(100, [1.0, 2.0])]), 100).count() == 0


def test_lengths_are_searched_by_themselves(spark):
    draw = np.random.default_rng(4)
    short, long = draw.standard_normal((40, 3)), draw.standard_normal((60, 5))
    vectors = [(i, v) for i, v in enumerate(short)] + [(100 + i, v) for i, v in enumerate(long)]
    found = {}
    for r in ann.search(table(spark, vectors), 20).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert set(found) == {0, 20, 100, 120, 140} and all(len(v) == 10 for v in found.values())
    assert all((v < 100) == (q < 100) for q, near in found.items() for v in near)


def test_the_visited_share_falls_as_rows_grow():
    draw = np.random.default_rng(6)
    shares = []
    for rows in (2_000, 30_000):
        x = draw.standard_normal((rows, 16))
        index = ann.build(x[:2000])
        probes = x[:60]
        apart = ((probes[:, None] - x[None]) ** 2).sum(axis=2)
        near = np.argsort(apart, axis=1, kind="stable")[:, 1:11]
        ann.calibrate(index, probes, [x[n] for n in near])
        held = [ann.Shard(index, t, np.arange(rows), x, 10) for t in range(ann.TABLES)]
        seen = hits = 0
        for q in range(60, 160):
            chances = index.chances(x[q : q + 1])[0]
            visited = set(np.concatenate([h.ids[h.visited(chances[t])] for t, h in enumerate(held)]).tolist())
            true = np.argsort(((x[q] - x) ** 2).sum(axis=1), kind="stable")[1:11]
            seen, hits = seen + len(visited), hits + len(visited & set(true.tolist()))
        assert hits / 1000 >= 0.9
        shares.append(seen / 100 / rows)
    assert shares[1] < shares[0] and shares[1] < 0.2


def test_hot_buckets_are_split_into_bounded_shards():
    place, tables = ann._plan([(0, 3, 200_000), (0, 5, 10), (1, 3, 200_010)], 200_010)
    assert len(tables) == sum(p for _, p in {v for v in place.values()}) and place[0, 3][1] == -(-200_000 // int(max(ann.SHARD, 200_010 * 2 / 64)))
    assert [t for t in tables] == sorted(tables)
