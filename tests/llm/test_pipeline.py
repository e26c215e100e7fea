"""The pipeline held against its parts, one by one."""

import hashlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from corpusgrid.llm import queries
from tests.llm.test_classifiers import corpus
from tests.llm.test_simhash import brute_components, brute_print


def written(spark, tmp_path):
    made = corpus(11, 400)
    rows = [(i, t, k, f"src{i % 3}") for i, t, k, _ in made]
    clean = next(r for r, m in zip(rows, made, strict=True) if not m[3])
    rows += [(1000 + i, clean[1], clean[2], "src0") for i in range(5)] + [(2000, "", "en", "src1"), (2001, None, None, None), (2002, "?!", "de", "src2")]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "CAST(length(text) AS BIGINT) AS n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, y, 1) for i, _, _, y in made if i % 2], "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder, made, clean


def test_stages(spark, tmp_path):
    folder, made, clean = written(spark, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    toxic = {i for i, _, _, y in made if y}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        after = docs.collect()
        ids = [r.doc_id for r in after]
        if name != "bpe":
            assert docs.columns == columns
        if name == "toxicity":
            gone = {r.doc_id for r in before} - set(ids)
            assert len(gone & toxic) > 0.95 * len(toxic) and len(gone - toxic) < 0.02 * len(before)
        if name == "language":
            assert {r.doc_id for r in before} - set(ids) == {2000, 2001, 2002}
        if name == "near_duplicates":
            least = brute_components([(r.doc_id, brute_print(r.text)) for r in before])
            assert sorted(ids) == sorted(set(least.values()))
            assert sum(i == clean[0] or 1000 <= i < 1005 for i in ids) == 1
        if name == "source_mix":
            assert set(ids) <= {r.doc_id for r in before} and max(ids.count(i) for i in set(ids)) <= 3
        if name == "bpe":
            library = Tokenizer.from_file(queries.tokenizer_path())
            texts = {r.doc_id: r.text for r in before}
            assert len(after) == len(before)
            for r in after:
                ids = np.array(library.encode(texts[r.doc_id], add_special_tokens=False).ids, "<u4").tobytes()
                assert r.ids == ids and r.ids_sha256 == hashlib.sha256(ids).hexdigest()


def test_run_is_repeatable(spark, tmp_path):
    folder, _, _ = written(spark, tmp_path)
    one, two = (sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, folder).collect()) for _ in range(2))
    assert one == two and one
