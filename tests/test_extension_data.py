"""Extension data in a stored collection."""

import pytest
from pyspark.sql import functions as F

from corpusgrid.errors import GridError
from corpusgrid.storage import extension_data
from corpusgrid.storage.collection import Collection
from tests.test_storage import DOCS, scan

ITEM = "extension string, id string, key string, media_type string, metadata string, content binary, sha256 string"


def items(spark, *rows):
    return spark.createDataFrame([(e, i, k, "text/plain", None, c, d) for e, i, k, c, d in rows], ITEM)


def test_data_is_listed_fetched_replaced_and_swept(spark, tmp_path):
    kept = Collection(spark, str(tmp_path), "r", indexed=False)
    kept.ingest(scan(spark, DOCS))
    extension_data.put(kept, items(spark, ("x", "a", "2", b"two", None), ("x", "a", "1", b"one", None), ("x", "b", "1", b"one", None), ("y", "a", "1", b"", None)))
    def shown(*of):
        return [(r.extension, r.id, r.key, r["size"]) for r in extension_data.listed(kept, *of).collect()]
    assert shown() == [("x", "a", "1", 3), ("x", "a", "2", 3), ("x", "b", "1", 3), ("y", "a", "1", 0)] and shown("x", "a") == shown()[:2] and shown(None, "b") == shown()[2:3]
    assert kept.read("blobs").count() == 3  # equal bytes once
    assert {(r.key, bytes(r.content)) for r in extension_data.fetched(kept, extension_data.listed(kept, "x", "a")).collect()} == {("1", b"one"), ("2", b"two")}
    extension_data.put(kept, items(spark, ("x", "a", "3", b"three", None)))
    assert shown("x", "a") == [("x", "a", "3", 5)] and shown("x", "b") == [("x", "b", "1", 3)]
    assert extension_data.collect_garbage(kept, dry=True) == 1 and extension_data.collect_garbage(kept) == 1 and extension_data.collect_garbage(kept) == 0
    kept.sync(scan(spark, {k: v for k, v in DOCS.items() if k != "b"}))  # a removed document's data goes, the others' stays
    assert shown() == [("x", "a", "3", 5), ("y", "a", "1", 0)]
    kept.ingest(scan(spark, DOCS))
    assert shown() == [("x", "a", "3", 5), ("y", "a", "1", 0)]
    lost = extension_data.fetched(kept, extension_data.listed(kept).withColumn("sha256", F.lit("0" * 64))).collect()
    assert all(r.content is None and r.warning == "bytes are missing" for r in lost) and len(lost) == 2


def test_data_that_is_refused(spark, tmp_path, monkeypatch):
    kept = Collection(spark, str(tmp_path), "r", indexed=False)
    monkeypatch.setattr(extension_data, "EACH", 100)
    for bad in ([("x", "a", "1", b"one", "0" * 64)], [("x", "a", "1", b"one", None)] * 2, [("x", "a", "1", b"z" * 101, None)]):
        with pytest.raises(GridError):
            extension_data.put(kept, items(spark, *bad))
    assert kept.versions.numbers() == []
