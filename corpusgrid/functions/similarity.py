"""Token similarity as built-in expressions: the larger of edit similarity and padded trigram overlap."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A short token's prefix score, the least similarity that counts, the longest ASCII
#: token whose repeated trigrams count.
PREFIX, LEAST, LONGEST = 0.75, 0.55, 62


def trigrams(token: Column) -> Column:
    """Trigrams of ``#token#`` in order, repeats included."""
    padded = F.concat(F.lit("#"), token, F.lit("#"))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3)))


def _listed(token: Column) -> Column:
    return (F.octet_length(token) == F.length(token)) & (F.length(token) <= LONGEST)


def dice(query: Column, token: Column) -> Column:
    """Overlap of trigrams: plain short tokens count the query's repeats, others are sets."""
    a, b = trigrams(query), trigrams(token)
    both = _listed(query) & _listed(token)
    a, b = F.when(both, a).otherwise(F.array_distinct(a)), F.when(both, b).otherwise(F.array_distinct(b))
    shared = F.size(F.filter(a, lambda x: F.array_contains(b, x)))
    return (shared * 2).cast("double") / (F.size(a) + F.size(b))


def edit(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return 1 - F.levenshtein(a, b).cast("double") / longest


def similarity(query: Column, token: Column) -> Column:
    """1 for equal tokens; with fewer than 3 characters on a side only a prefix counts."""
    short = (F.length(query) < 3) | (F.length(token) < 3)
    prefix = F.startswith(query, token) | F.startswith(token, query)
    return (
        F.when(query == token, F.lit(1.0))
        .when(short, F.when(prefix, F.lit(PREFIX)).otherwise(F.lit(0.0)))
        .otherwise(F.greatest(edit(query, token), dice(query, token)))
    )


def near(query: str, token: Column) -> Column:
    """``similarity`` to a known query token where it is at least ``LEAST``, something less elsewhere.

    The query's trigrams are literals, so shared ones are counted by substring tests in generated
    code; edit distances are bounded, and only tried where the lengths allow them; only tokens that
    count as sets build their trigrams.
    """
    none = F.lit(0.0)
    if len(query) < 3:  # it only matches what it begins
        return F.when(token == query, F.lit(1.0)).when(F.startswith(token, F.lit(query)), F.lit(PREFIX)).otherwise(none)
    grams = [f"#{query}#"[i : i + 3] for i in range(len(query))]

    def held(gram):  # tokens hold no "#", so a padded gram stands at an end
        if gram[0] == "#":
            return F.startswith(token, F.lit(gram[1:]))
        return F.endswith(token, F.lit(gram[:-1])) if gram[-1] == "#" else F.contains(token, F.lit(gram))

    def shared(wanted):
        return sum((held(g).cast("int") for g in wanted), F.lit(0))

    size, longest = F.length(token), int(len(query) / LEAST)
    distance = F.levenshtein(F.lit(query), token, int((1 - LEAST) * longest))
    larger = F.greatest(size, F.lit(len(query)))
    # each letter of the query that the token lacks costs an edit at least
    lacks = sum(((~F.contains(token, F.lit(c))).cast("int") * n for c, n in sorted(Counter(query).items())), F.lit(0))
    worth = (size <= longest) & (size >= int(len(query) * LEAST)) & (lacks <= larger * (1 - LEAST) + 1e-9)
    close = F.when(worth, F.when(distance >= 0, 1 - distance.cast("double") / larger).otherwise(none)).otherwise(none)
    distinct = sorted(set(grams))
    sets = (shared(distinct) * 2).cast("double") / (F.size(F.array_distinct(trigrams(token))) + len(distinct))
    sets = F.when(shared(distinct) > 0, sets).otherwise(none)
    overlap = sets
    if query.isascii() and len(query) <= LONGEST:
        overlap = F.when(_listed(token), (shared(grams) * 2).cast("double") / (size + len(grams))).otherwise(sets)
    begins = F.when(F.startswith(F.lit(query), token), F.lit(PREFIX)).otherwise(none)
    return F.when(token == query, F.lit(1.0)).when(size < 3, begins).otherwise(F.greatest(close, overlap))
