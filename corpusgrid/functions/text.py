"""Tokens, rounding, snippets and Markdown stripping as built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a run of letters and numbers.
SEPARATOR = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order; null and blank texts have none."""
    found = F.filter(F.split(F.lower(text), SEPARATOR), lambda t: t != "")
    return F.coalesce(found, F.array().cast("array<string>"))


def round4(x: Column) -> Column:
    """Half away from zero at four decimals."""
    return F.round(x * 10000) / 10000


def snippet(body: Column, terms: Column) -> Column:
    """The text around the earliest of ``terms``: 40 characters before it, 120 in all, with ellipses
    where text is left out; null if no term occurs. Offsets count characters."""
    low = F.lower(body)
    places = F.filter(F.transform(terms, lambda t: F.instr(low, t)), lambda p: p > 0)
    first = F.array_min(places)
    start = F.greatest(first - 41, F.lit(0))
    whole = F.length(body)
    end = F.least(start + 120, whole)
    # with a leading ellipsis the window loses its first character
    head = F.when(start > 0, F.concat(F.lit("…"), F.substr(body, start + 2, end - start - 1))).otherwise(F.substr(body, F.lit(1), end))
    return F.when(first.isNotNull(), F.concat(head, F.when(end < whole, F.lit("…")).otherwise(F.lit(""))))


def marks(begin: str = "(?m:^)", end: str = r"\Z") -> str:
    """Markdown's marks as one pattern; its three groups are what stays of a match: the text of a fence,
    the label of a link or image, the rest of an autolink that is not closed. Alternatives are tried in
    this order at each place, so a scan from left to right needs no state."""
    return "|".join([
        rf"```[^\n]*\n((?s:.*?))(?:```(?:[^\n]*\n)?|{end})",
        rf"```[^\n]*{end}",
        r"!?\[([^\]]*)\]\([^)]*\)",
        r"<https?://[^>]*>",
        r"<(https?://)",
        begin + "#{1,6} ",
        r"[*_~`]",
    ])


_MARKS = re.compile(marks())


def plain_text(body: str) -> str:
    """Markdown without its marks: fence lines, link targets, autolinks, heading and emphasis signs go;
    fenced text, labels and everything else stay."""
    return _MARKS.sub(lambda m: "".join(filter(None, m.groups())), body)


def strip_markdown(body: Column) -> Column:
    """``plain_text`` as a built-in expression."""
    plain = F.regexp_replace(body, F.lit(marks("(?dm:^)", r"\z")), F.lit("$1$2$3"))
    return F.when(body.rlike(r"[\[<#*_~`]"), plain).otherwise(body)
