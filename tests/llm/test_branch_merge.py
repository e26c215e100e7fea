"""Three-way merge against a plain merge of two edited copies."""

import hashlib
import os
import zlib
from collections import Counter

import pytest

from corpusgrid.llm import branch_merge, queries
from tests.llm.helpers import SCHEMA, TEXTS, documents, empty


def code(branch, doc_id, name):
    return zlib.crc32(f"{branch}:{'' if doc_id is None else doc_id}:{name}".encode()) % 7


def edit(c, value, dropped):
    return {0: dropped, 1: value + "!", 2: value + "?"}.get(c, value)


def branch(name, doc_id, text, lang, source):
    """What a branch makes of a row: None, or columns, lines (None: dropped) and gaps."""
    if code(name, doc_id, "row") == 0:
        return None
    columns = [edit(code(name, doc_id, n), v, "") for n, v in (("lang", lang), ("source", source))]
    codes = [code(name, doc_id, i) for i in range(len(text.split("\n")))]
    return columns, [edit(c, x, None) for c, x in zip(codes, text.split("\n"))], [{3: "!", 4: "?"}.get(c) for c in codes]


def merged(rows):
    """doc_id, lang, source, hash and counts: each unit of base, left and right compared by value."""
    out = []
    for doc_id, text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        base = ([lang, source], text.split("\n"), [None] * len(text.split("\n")))
        left, right = branch("L", doc_id, text, lang, source), branch("R", doc_id, text, lang, source)
        n = Counter()
        state = right
        if left is None and right is None:
            n["clean"] = 1
        elif left is None or right is None:
            n["edit_delete" if (left or right) != base else "clean"] = 1
            state = right if right != base else None
        else:
            state = ([], [], [])
            for k in range(3):
                for b, x, y in zip(base[k], left[k], right[k]):
                    if x != b and y != b and x != y:
                        n["insert_insert" if k == 2 else "edit_delete" if None in (x, y) else "edit_edit"] += 1
                    elif x != b or y != b:
                        n["clean"] += 1
                    state[k].append(y if y != b else x)
        held = (None, None, None)
        if state is not None:
            pieces = [p for pair in zip(state[1], state[2]) for p in pair if p is not None]
            held = (*state[0], "\n".join(pieces))
        out.append((doc_id, *held, n["clean"], n["edit_edit"], n["edit_delete"], n["insert_insert"]))
        added = [{3: "!", 4: "?"}.get(code(b, doc_id, "row")) for b in "LR"]
        if any(added):
            clash = int(None not in added and added[0] != added[1])
            out.append((None if doc_id is None else -1 - doc_id, lang, source, added[1] or added[0], 1 - clash, 0, 0, clash))
    return out


def rows_of(df):
    return sorted(map(repr, map(tuple, df.select("doc_id", "lang", "source", "text", "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert").collect())))


def test_awkward_rows(spark):
    df = documents(spark)
    assert rows_of(branch_merge.merge(df)) == sorted(map(repr, merged(TEXTS)))
    assert branch_merge.merge(empty(spark)).count() == 0
    assert "Python" not in branch_merge.merge(df)._jdf.queryExecution().toString()


def test_every_case_occurs(spark):
    rows = [(i, "\n".join(f"line {i} {k}" for k in range(i % 9)) + "\n" * (i % 3), [None, "", "en"][i % 3], ["s", None][i % 2]) for i in range(900)]
    expected = merged(rows)
    gone = [r for r in expected if r[1] is None]
    assert len(gone) > 100 and all(sum(r[k] for r in expected) > 5 for k in (4, 5, 6, 7)) and any(r[3] == "" for r in expected)
    assert any(r[3] is not None and r[6] and not r[4] for r in expected)  # the left one drops what the right one changes
    assert rows_of(branch_merge.merge(spark.createDataFrame(rows, SCHEMA))) == sorted(map(repr, expected))


def test_repeated_rows_and_long_texts(spark):
    rows = [(5, "a\nb\nc", "en", "s")] * 40 + [(5, "other", "de", "t"), (17, "\n".join(f"{k}" for k in range(3000)), "en", "s"), (18, "x" * 100_000, None, None)]
    assert rows_of(branch_merge.merge(spark.createDataFrame(rows, SCHEMA))) == sorted(map(repr, merged(rows)))


def test_codes_are_a_parameter(spark):
    from pyspark.sql import functions as F

    def left_appends(name, key, unit):
        return F.when((F.lit(name) == "ours") & unit.rlike("^[0-9]+$"), 1).otherwise(6)

    found = branch_merge.merge(spark.createDataFrame([(1, "a\nb", "en", "s")], SCHEMA), left_appends, ("ours", "theirs")).collect()
    assert [(r.text, r.n_clean) for r in found] == [("a!\nb!", 2)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_the_query_equals_plain_merges(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    wanted = [(*r[:3], None if r[3] is None else hashlib.sha256(r[3].encode()).hexdigest(), *r[4:]) for r in merged([tuple(r) for r in df.collect()])]
    found = queries.op13_branch_merge(spark, "/root/testdata/sf0.001").select("doc_id", "lang", "source", "text_sha256", "n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert")
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, wanted))
