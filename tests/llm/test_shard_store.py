import math
import os

import pytest

from corpusgrid.llm import queries, shard_store
from corpusgrid.llm.shard_store import Conflict, Shard, ShardStore
from tests.llm.helpers import documents, empty


def rows(df):
    return sorted(map(str, df.collect()))


def test_append_compact_read(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "store"))
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat(md5(CAST(id AS STRING)), 20) AS text")
    for part in range(6):
        store.append(docs.filter(f"doc_id % 6 = {part}").repartition(3), rows=100)
    base, schema, shards = store.manifest()
    assert base == 6 and sum(s.rows for s in shards) == 3000 and len(shards) >= 30 and max(s.rows for s in shards) <= 100
    before = rows(store.read())
    target = sum(s.size for s in shards) // 3
    version = store.compact(target)
    _, _, merged = store.manifest()
    assert version > 6 and len(merged) <= 5 and sum(s.rows for s in merged) == 3000
    assert not store.plan(merged, target)
    assert rows(store.read()) == before == rows(docs) and rows(store.read(6)) == before
    assert store.compact(target) == version
    assert store.vacuum() >= 30 and rows(store.read()) == before
    assert store.versions() == [version]


def test_tiers_hold_similar_sizes():
    assert Shard("a", 10, 1).tier() == 0
    for size in (1 << 16, 1 << 18, 3 << 18, 1 << 22):
        s = Shard("a", size, 1)
        assert shard_store.LEAST * shard_store.FANOUT ** s.tier() <= size * 1.0001
        assert size < shard_store.LEAST * shard_store.FANOUT ** (s.tier() + 1) * 1.0001


def test_commits_exclude_each_other(spark, tmp_path):
    one, two = (ShardStore(spark, str(tmp_path / "store")) for _ in range(2))
    one.append(documents(spark))
    base, schema, shards = two.manifest()
    one.append(documents(spark))
    with pytest.raises(Conflict):
        two.commit(base, schema, shards)
    assert two.versions() == [1, 2]
    two.append(documents(spark))
    assert two.versions() == [1, 2, 3] and two.read().count() == 3 * documents(spark).count()


def test_a_lost_merge_leaves_the_version(spark, tmp_path, monkeypatch):
    store = ShardStore(spark, str(tmp_path / "store"))
    for _ in range(5):
        store.append(documents(spark).coalesce(1))
    before = store.manifest()
    monkeypatch.setattr(store, "_written", lambda folder: [])
    with pytest.raises(RuntimeError):
        store.compact()
    monkeypatch.undo()
    assert store.manifest() == before and rows(store.read()) == rows(documents(spark).union(documents(spark)).union(documents(spark)).union(documents(spark)).union(documents(spark)))
    assert store.vacuum(keep=9) >= 1


def test_empty_and_clashing_columns(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "a"))
    store.append(empty(spark))
    assert store.read().count() == 0 and store.read().columns == empty(spark).columns
    store.append(documents(spark, extra=False))
    assert rows(store.read()) == rows(documents(spark, extra=False))
    store.append(documents(spark))
    assert set(documents(spark).columns) == set(store.read().columns)
    assert math.isclose(store.read().count(), 2 * documents(spark).count())


def test_a_tier_is_merged_in_bounded_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shard_store, "MOST", 10)
    store = ShardStore(spark, str(tmp_path / "store"))
    groups = store.plan([Shard(f"s{i}", 1000 + i, 1) for i in range(23)])
    assert [len(g) for g in groups] == [10, 10] and len({s.path for g in groups for s in g}) == 20
    assert store.plan([Shard("a", 100 << 20, 1)] * 9) == []


def test_vacuum_leaves_what_another_writer_has_not_committed(spark, tmp_path, monkeypatch):
    one, two = (ShardStore(spark, str(tmp_path / "store")) for _ in range(2))
    one.append(documents(spark))
    base, schema, shards = two.manifest()
    written = two._written

    def during(folder):  # Spark has written the folder, nobody has named it
        one.vacuum()
        return written(folder)

    monkeypatch.setattr(two, "_written", during)
    new = two._write(documents(spark))
    assert one.vacuum() == 0
    assert two.commit(base, schema, shards + new, new) == 2
    two._release(new)
    assert one.vacuum() == 0 and rows(one.read()) == rows(documents(spark).union(documents(spark)))


def test_a_writer_that_outlives_its_lease_does_not_commit(spark, tmp_path):
    one, two = (ShardStore(spark, str(tmp_path / "store")) for _ in range(2))
    one.append(documents(spark))
    base, schema, shards = two.manifest()
    new = two._write(documents(spark))
    assert one.vacuum(lease=-1) >= 1
    with pytest.raises(RuntimeError):
        two.commit(base, schema, shards + new, new)
    assert rows(one.read()) == rows(documents(spark)) and two.versions() == [1]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_the_query_merges_over_two_tiers(spark, monkeypatch):
    groups, made, merge = [], set(), ShardStore._merge

    def seen(self, schema, group, target):
        groups.append(({s.tier() for s in group}, len(group), any(s.path in made for s in group)))
        new = merge(self, schema, group, target)
        made.update(s.path for s in new)
        return new

    monkeypatch.setattr(shard_store, "LEAST", 1 << 13)  # tiers as small as this table's runs
    monkeypatch.setattr(ShardStore, "_merge", seen)
    found = queries.op7_shard_store(spark, "/root/testdata/sf0.001")
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert all(n >= shard_store.FANOUT for _, n, _ in groups) and len(groups) >= queries.WAVES
    assert any(again for *_, again in groups) and len({t for tiers, *_ in groups for t in tiers}) > 1  # merged runs merged again
