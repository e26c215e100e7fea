"""Query strings, read on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass

import regex

from corpusgrid.errors import GridError


def query_tokens(query: str) -> list[str]:
    """The query's tokens; repeats keep their places."""
    return [t.lower() for t in regex.findall(r"[\p{L}\p{N}]+", query)]


def required_tokens(query: str) -> list[str]:
    found = query_tokens(query)
    if not found:
        raise GridError("EMPTY_QUERY", "the query has no token")
    return found


@dataclass(frozen=True)
class Terms:
    """Alternatives and exclusions; each is a phrase of one token or more."""

    positive: tuple[tuple[str, ...], ...]
    negative: tuple[tuple[str, ...], ...]


_TERM = re.compile(r'(-?)("[^"]*"?|[^ \t]*)')


def parse_terms(query: str) -> Terms:
    """White space parts terms, quotes make phrases, a leading minus excludes. A bare term with
    punctuation is a phrase of its tokens; terms without a token are left out."""
    found: tuple[list, list] = ([], [])
    at, text = 0, query.strip()
    while at < len(text):
        if text[at] in " \t":
            at += 1
            continue
        match = _TERM.match(text, at)
        at = max(match.end(), at + 1)
        phrase = tuple(query_tokens(match[2]))
        if phrase:
            found[bool(match[1])].append(phrase)
    return Terms(*map(tuple, found))
