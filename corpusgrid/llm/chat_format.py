"""Chat formatting by prefix-target expansion (native: DataFrame functions only).

Every assistant turn becomes its own example: all preceding turns are its context and only that
reply is trainable. Each example as one string would grow with the square of a conversation's length,
so stored examples share their contexts: a row's prompt holds the turns since the example before it,
and the row names that example, whose whole text its context begins with, by the SHA-256 of what that
one adds (``context_sha256``) and by its characters (``shared``). The chain of names gives each example
its whole context. Such storage takes room in proportion to the conversation's characters; ``expand`` with whole
prompts makes the plain strings. ``digests`` makes and reads every example whole, one at a time, and checks
its context, its names and its reply.

Template: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. In texts and roles a backslash is doubled and
``<|`` becomes ``<\\|``, so no control string survives inside a text, and ``unescape`` undoes it.
A newline in a role becomes ``<|nl|>``.

Defined results: a null text or role counts as empty; a null ``turn`` sorts first; rows that tie on
``turn`` are ordered by role, then text, and repeated rows are kept as turns of their own; a null
``conv_id`` is one conversation; conversations without an assistant turn have pieces but no
example, as turns after the last reply have none; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

START, END, NEWLINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"


def _swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    """No control string is left in the result; ``unescape`` gives the text back."""
    return _swap(_swap(text, "\\", "\\\\"), "<|", "<\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, position (from 0), example (from 1, null where not trainable),
    context_turns, start, piece, loss_start, loss_end (offsets in the conversation's text)."""
    empty = F.lit("")
    rows = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), empty).alias("role"),
        F.coalesce(F.col("text").cast("string"), empty).alias("text"),
    )
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    until = order.rowsBetween(W.unboundedPreceding, 0)
    head = F.concat(F.lit(START), _swap(escape(F.col("role")), "\n", NEWLINE), F.lit("\n"))
    made = rows.select(
        "conv_id", "turn", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"),
        (F.col("role") == "assistant").alias("trainable"),
    ).withColumn("piece", F.concat("head", "body", F.lit(END)))
    placed = made.select(
        "conv_id",
        (F.row_number().over(order) - 1).cast("long").alias("position"),
        F.when(F.col("trainable"), F.sum(F.col("trainable").cast("long")).over(until)).alias("example"),
        F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0).cast("long")).alias("start"),
        "piece", F.length("head").alias("head_chars"), F.length("body").alias("body_chars"), "trainable",
    )
    loss = F.col("start") + F.col("head_chars")
    return placed.select(
        "conv_id", "position", "example", F.col("position").alias("context_turns"), "start", "piece",
        F.when(F.col("trainable"), loss).alias("loss_start"),
        F.when(F.col("trainable"), loss + F.col("body_chars")).alias("loss_end"),
    )


def expand(formatted: DataFrame, whole: bool = True, rest: bool = False) -> DataFrame:
    """One row per assistant turn: conv_id, number (from 1), example, prompt, completion, shared (characters
    that the example before covers), sha256 and context_sha256. Whole prompts repeat their context, so the
    result grows with the square of a conversation's turns: for trainers, not for storage. Otherwise a prompt
    holds what follows the example before, which ``context_sha256`` names (the first one: nothing). With
    ``rest`` the turns after the last example come too, as the prompt of a row whose ``example`` is null."""
    before = W.partitionBy("conv_id").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    numbered = formatted.withColumn("number", F.count("example").over(before) + 1)
    pieces = F.sort_array(F.collect_list(F.struct("position", "piece")))
    owned = numbered.groupBy("conv_id", "number").agg(
        F.max("example").alias("example"), F.min("start").alias("shared"), F.array_join(pieces["piece"], "").alias("own"),
        F.max("loss_start").alias("loss_start"), F.max("loss_end").alias("loss_end"),
    )
    order = W.partitionBy("conv_id").orderBy("number")
    named = owned.withColumn("sha256", F.sha2("own", 256)).withColumn("context_sha256", _before("sha256", F.sha2(F.lit(""), 256)))
    prompt = F.coalesce(F.expr("substring(own, 1, CAST(loss_start - shared AS INT))"), "own")
    if whole:
        prompt = F.concat(F.array_join(F.collect_list("own").over(order.rowsBetween(W.unboundedPreceding, -1)), ""), prompt)
    made = named.select(
        "conv_id", "number", "example", prompt.alias("prompt"),
        F.expr("substring(own, CAST(loss_start - shared AS INT) + 1, CAST(loss_end - loss_start AS INT))").alias("completion"),
        "shared", "sha256", "context_sha256",
    )
    return made if rest else made.filter("example IS NOT NULL")


def _before(value: str | Column, first: Column) -> Column:
    """A value of the example before; ``first`` for the first one."""
    return F.coalesce(F.lag(value).over(W.partitionBy("conv_id").orderBy("number")), first)


def read_back(made: DataFrame) -> DataFrame:
    """What whole examples (and the rest) say: conv_id, number, turns, loss, chars. Every example is read whole: a
    reply counts only if its context is, character by character, the whole text of the example before (both by their
    SHA-256), and what the example adds is as it was named; so turns are parsed once, where they come first.
    Whole texts leave this step as digests: no window or shuffle holds them."""
    text = F.when(F.col("example").isNull(), F.col("prompt")).otherwise(F.concat("prompt", "completion", F.lit(END)))
    read = made.withColumn("text", text).select(
        "conv_id", "number", "example", "completion", "shared", "sha256", "context_sha256",
        F.expr("substring(text, CAST(shared + 1 AS INT))").alias("own"), F.length("text").cast("long").alias("length"),
        F.sha2("text", 256).alias("whole"), F.sha2(F.expr("substring(prompt, 1, CAST(shared AS INT))"), 256).alias("context"),
    )
    nothing = F.sha2(F.lit(""), 256)
    sound = (
        (F.col("sha256") == F.sha2("own", 256)) & (F.col("context_sha256") == _before(F.sha2("own", 256), nothing))
        & (F.col("shared") == _before("length", F.lit(0).cast("long"))) & (F.col("context") == _before("whole", nothing))
    )
    parsed = F.split("own", r"<\|im_end\|>\n")

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        role = _swap(F.substr(head, F.lit(len(START) + 1)), NEWLINE, "\n")
        return F.struct(unescape(role).alias("role"), unescape(F.substr(piece, F.length(head) + 2)).alias("text"))

    return read.select(
        "conv_id", "number", F.transform(F.slice(parsed, F.lit(1), F.size(parsed) - 1), turn).alias("turns"),
        F.when(sound, unescape(F.col("completion"))).alias("loss"), F.length("own").cast("long").alias("chars"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples, all from the whole examples:
    each assistant turn with its whole prefix, so time grows with the characters of all prefixes.
    A digest of a conversation's text needs it in one row: what it says and its replies meet there, once."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read_back(expand(formatted, rest=True)).select(
        "conv_id", "number", said.alias("said"), "loss", F.size("turns").cast("long").alias("turns"), "chars"
    )
    parts = F.sort_array(F.collect_list(F.struct("number", "said", "loss")))
    whole = rows.groupBy("conv_id").agg(
        parts.alias("parts"), F.sum("turns").alias("n_turns"), F.sum(F.coalesce(F.length("loss"), F.lit(0)).cast("long")).alias("loss_chars"),
        F.sum("chars").alias("formatted_chars"), F.count("loss").alias("n_examples"),
    )
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.col("parts.said"), ""), 256).alias("turns_sha256"), "loss_chars",
        F.sha2(F.array_join(F.col("parts.loss"), ""), 256).alias("loss_sha256"), "formatted_chars", "n_examples",
    )
