"""Three-way merge of two branches by SQL explosion.

A branch is a rule that gives each unit of a document (its row, its columns, its lines) a code; codes
say what the branch does to the unit. ``merge`` explodes the lines with their places, computes both
branches' codes, merges each line and the gap after it by CASE rules and regroups the pieces by
``collect_list``, ordered by place, with sums of what merged clean and what conflicted.

Codes: 0 drops (a column: becomes empty), 1 and 2 append ``!`` and ``?``; of a line 3 and 4 insert a line
``!`` or ``?`` after it; of a row 3 and 4 add a row of id -1-id with the text ``!`` or ``?`` and the row's columns.

Defined results: nulls are empty (of an id: in codes; the id stays null, as does its added row's); an
empty text is one empty line; rows that repeat an id are merged each by itself, and add a row each; an
added row whose id is taken stands beside it; no rows give no rows; other columns are left out. The lines of
one document meet in one task, those of a repeated id do not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("lang", "source")
#: What a code appends, and what it inserts after a line or adds as a row.
MARKS = {1: "!", 2: "?"}
ADDED = {3: "!", 4: "?"}
#: A code that does nothing.
IDLE = 6

Code = Callable[[str, Column, Column], Column]


def crc_code(branch: str, key: Column, name: Column) -> Column:
    """CRC-32 of ``branch:key:name`` modulo 7."""
    return (F.crc32(F.concat(F.lit(f"{branch}:"), key, F.lit(":"), name)) % 7).cast("int")


def _edited(code: Column, value: Column, dropped: Column) -> Column:
    return F.when(code == 0, dropped).when(code == 1, F.concat(value, F.lit(MARKS[1]))).when(code == 2, F.concat(value, F.lit(MARKS[2]))).otherwise(value)


def _inserted(code: Column) -> Column:
    return F.when(code == 3, F.lit(ADDED[3])).when(code == 4, F.lit(ADDED[4]))


def _count(condition: Column) -> Column:
    return condition.cast("long")


def _columns(docs: DataFrame) -> DataFrame:
    """Each row with its columns merged by value (``out_…``) and what that counts."""
    clean, conflict = F.lit(0).cast("long"), F.lit(0).cast("long")
    merged = {}
    for c in COLUMNS:
        base = F.col(f"base_{c}")
        left, right = (_edited(F.when(F.col(f"{b}_row") == 0, IDLE).otherwise(F.col(f"{b}_{c}")), base, F.lit("")) for b in ("l", "r"))
        clash = (left != base) & (right != base) & (left != right)
        clean = clean + _count(((left != base) | (right != base)) & ~clash)
        conflict = conflict + _count(clash)
        merged[f"out_{c}"] = F.when(right != base, right).otherwise(left)
    return docs.withColumns({**merged, "column_clean": clean, "column_conflicts": conflict})


def coded(docs: DataFrame, code: Code = crc_code, branches: tuple[str, str] = ("L", "R")) -> DataFrame:
    """doc_id, text, base columns and both branches' codes of the row and its columns."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    base = docs.select("doc_id", key.alias("key"), F.coalesce("text", F.lit("")).alias("text"), *[F.coalesce(c, F.lit("")).alias(f"base_{c}") for c in COLUMNS])
    codes = {f"{b}_{n}": code(name, F.col("key"), F.lit(n)) for b, name in zip("lr", branches, strict=True) for n in ("row", *COLUMNS)}
    return base.withColumns(codes)


def added_rows(rows: DataFrame) -> DataFrame:
    """The rows that branches add, merged by id: equal ones are one clean change, others one conflict."""
    left, right = _inserted(F.col("l_row")), _inserted(F.col("r_row"))
    clash = left.isNotNull() & right.isNotNull() & (left != right)
    none = F.lit(0).cast("long")
    return rows.filter(left.isNotNull() | right.isNotNull()).select(
        (-1 - F.col("doc_id")).alias("doc_id"), *[F.col(f"base_{c}").alias(c) for c in COLUMNS], F.coalesce(right, left).alias("text"),
        _count(~clash).alias("n_clean"), none.alias("n_edit_edit"), none.alias("n_edit_delete"), _count(clash).alias("n_insert_insert"),
    )


def line_units(rows: DataFrame, code: Code = crc_code, branches: tuple[str, str] = ("L", "R")) -> DataFrame:
    """One row for each line with what stays of it and of the gap after it, and what both count. A branch that
    drops the whole row edits no line, so the other one's state stays."""
    lines = rows.select("*", F.posexplode(F.split("text", "\n", -1)).alias("place", "line")).drop("text")
    names = zip("lr", branches, strict=True)
    lines = lines.withColumns({
        b: F.when(F.col(f"{b}_row") == 0, IDLE).otherwise(code(name, F.col("key"), F.col("place").cast("string"))) for b, name in names
    })
    left, right = F.col("l"), F.col("r")
    edits = [c <= 2 for c in (left, right)]
    inserts = [(c == 3) | (c == 4) for c in (left, right)]
    clash, gap_clash = edits[0] & edits[1] & (left != right), inserts[0] & inserts[1] & (left != right)
    line = _edited(F.when(edits[1], right).otherwise(left), F.col("line"), F.lit(None).cast("string"))
    gap = F.coalesce(_inserted(right), _inserted(left))
    # a row that R drops has no text, but the other's changes still count
    pieces = F.when(F.col("r_row") != 0, F.concat_ws("\n", line, gap))
    kept = line.isNotNull() | gap.isNotNull()
    either = (left == 0) | (right == 0)
    return lines.withColumns({
        "piece": F.when(kept, pieces),
        "line_clean": _count((edits[0] | edits[1]) & ~clash) + _count((inserts[0] | inserts[1]) & ~gap_clash),
        "edit_edit": _count(clash & ~either), "edit_delete": _count(clash & either), "insert_insert": _count(gap_clash),
    })


def merge(docs: DataFrame, code: Code = crc_code, branches: tuple[str, str] = ("L", "R")) -> DataFrame:
    """doc_id, lang, source, text (three nulls where the row is gone), n_clean, n_edit_edit, n_edit_delete and
    n_insert_insert of every id that the base or a branch holds; conflicts take the second branch's state."""
    rows = _columns(coded(docs, code, branches)).withColumn("unit", F.monotonically_increasing_id())
    units = line_units(rows, code, branches)
    # what belongs to the whole row stands in the group's key once, not in each piece
    whole = ["unit", "doc_id", "l_row", "r_row", *[f"out_{c}" for c in COLUMNS], "column_clean", "column_conflicts"]
    # places ascend, and a line without a piece has none
    grouped = units.groupBy(*whole).agg(
        F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("place", "piece")))).alias("pieces"),
        *[F.sum(c).alias(c) for c in ("line_clean", "edit_edit", "edit_delete", "insert_insert")],
    )
    left_gone, right_gone = F.col("l_row") == 0, F.col("r_row") == 0
    changes = F.col("column_clean") + F.col("line_clean") > 0  # of the one branch that keeps the row
    one_gone, any_gone = left_gone != right_gone, left_gone | right_gone
    absent = right_gone | (left_gone & ~changes)
    zero = F.lit(0).cast("long")
    merged = grouped.select(
        "doc_id", *[F.when(~absent, F.col(f"out_{c}")).alias(c) for c in COLUMNS],
        F.when(~absent, F.array_join(F.col("pieces.piece"), "\n")).alias("text"),
        F.when(~any_gone, F.col("column_clean") + F.col("line_clean")).otherwise(_count(~(one_gone & changes))).alias("n_clean"),
        F.when(~any_gone, F.col("column_conflicts") + F.col("edit_edit")).otherwise(zero).alias("n_edit_edit"),
        F.when(~any_gone, F.col("edit_delete")).otherwise(_count(one_gone & changes)).alias("n_edit_delete"),
        F.when(~any_gone, F.col("insert_insert")).otherwise(zero).alias("n_insert_insert"),
    )
    return merged.unionByName(added_rows(coded(docs.withColumn("text", F.lit("")), code, branches)))


def digests(merged: DataFrame) -> DataFrame:
    """``merge`` with the SHA-256 of each text in its place."""
    return merged.withColumn("text_sha256", F.sha2("text", 256)).drop("text")
