"""Privacy transforms: authenticated encryption, keyed tokens and hashes, and search over them."""

from __future__ import annotations

import base64
import hashlib
import hmac
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgrid.errors import GridError
from corpusgrid.sources.markdown import fences

#: The envelope's prefix, the prefixes of keyed names, policies.
ENVELOPE, TOKEN, HASH = "enc:v1:", "tok", "hash"
POLICIES = ("none", "encrypt", "tokenize", "hash")
_RUN = regex.compile(r"[\p{L}\p{N}]+")


def key_bytes(value: str) -> bytes:
    """32 bytes from 64 hex digits, from base64 of 32 bytes, or from SHA-256 of anything else."""
    if re.fullmatch("[0-9a-fA-F]{64}", value):
        return bytes.fromhex(value)
    try:
        raw = base64.b64decode(value, validate=True)
        if len(raw) == 32:
            return raw
    except ValueError:
        pass
    return hashlib.sha256(value.encode()).digest()


def resolve_key(key_id: str, keys: dict[str, str] | None = None) -> bytes:
    """From the keys given, then from the environment variable that carries the id's name."""
    name = re.sub("[^A-Z0-9]", "_", key_id.upper())
    value = (keys or {}).get(key_id) or os.environ.get(f"CORPUSGRID_KEY_{name}")
    if not value:
        raise GridError("KEY_UNAVAILABLE", f"privacy key unavailable: {key_id}")
    return key_bytes(value)


def check_directive(policy: str, key_id: str, provider: str = "") -> dict[str, str]:
    if policy not in POLICIES:
        raise GridError("DIRECTIVE_INVALID", f"unsupported policy {policy!r}")
    if policy != "none" and not key_id:
        raise GridError("DIRECTIVE_INVALID", "key_id is required")
    return {"policy": policy, "key_id": key_id, "provider": provider}


def encrypt(text: Column, key: bytes) -> Column:
    """AES-256-GCM with a fresh nonce, as ``enc:v1:`` and base64 of nonce, text and tag (JVM side)."""
    sealed = F.aes_encrypt(text.cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"))
    return F.concat(F.lit(ENVELOPE), F.base64(sealed))


def decrypt(text: Column, key: bytes) -> Column:
    """The text of an envelope; other texts stay, broken envelopes give null."""
    raw = F.unbase64(F.regexp_replace(F.substr(text, F.lit(len(ENVELOPE) + 1)), r"\s", ""))
    opened = F.try_aes_decrypt(raw, F.lit(key), F.lit("GCM"), F.lit("DEFAULT")).cast("string")
    return F.when(F.startswith(text, F.lit(ENVELOPE)), opened).otherwise(text)


def normal(text: str) -> str:
    """Lower-cased, white space collapsed."""
    return " ".join(text.lower().split())


def named(prefix: str, key: bytes, text: str) -> str:
    """The keyed name of a text: HMAC-SHA-256 of its normal form, in hex."""
    return prefix + hmac.new(key, normal(text).encode(), hashlib.sha256).hexdigest()


def tokenize_text(text: str, key: bytes, known: dict[str, str] | None = None) -> str:
    """Each run of letters and digits replaced by its keyed name."""
    known = {} if known is None else known

    def one(match):
        word = match[0].lower()
        if word not in known:
            known[word] = named(TOKEN, key, word)
        return known[word]

    return _RUN.sub(one, text)


def tokenized(text: Column, key: bytes) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}
        for batch in batches:
            yield batch.map(lambda t: tokenize_text(t, key, known), na_action="ignore")
            if len(known) > 200_000:
                known.clear()

    return F.pandas_udf(run, "string")(text)


def hashed(text: Column, key: bytes) -> Column:
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: named(HASH, key, t), na_action="ignore")

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(text)


def query_aliases(query: str, keys: dict[str, bytes]) -> list[str]:
    """The keyed names of a query's tokens and of the whole query, for each key, without repeats."""
    out: list[str] = []
    for key in keys.values():
        out += [named(TOKEN, key, t) for t in _RUN.findall(query.lower())]
        if normal(query):
            out.append(named(HASH, key, query))
    return list(dict.fromkeys(out))


#: The word that an inline directive begins with: ``{{private:POLICY key_id="K"}}...{{/private:POLICY}}``.
MARKER = "private"
_ATTRIBUTE = re.compile(r'\s+([a-z_]+)\s*=\s*"([^"]*)"')


#: What tags stand in: braces, or a comment of HTML (``<!-- private:POLICY key_id="K" -->...<!-- /private:POLICY -->``).
STYLES = {"braces": (r"\{\{", r"\}\}"), "comment": (r"<!--\s*", "-->")}


@lru_cache
def _tags(marker: str, style: str = "braces") -> re.Pattern:
    begin, end = STYLES[style]
    return re.compile(rf"{begin}(?P<ends>/?){re.escape(marker)}:(?P<policy>[a-z]+)(?P<attributes>(?:\s+[a-z_]+\s*=\s*\"[^\"]*\")*)\s*{end}")


def inline_spans(body: str, marker: str = MARKER, style: str = "braces") -> tuple[list[tuple[str, str, int, int]], list[str]]:
    """(policy, key_id, start, end) of the protected stretches, and warnings. Fenced lines and inline
    code are text; a directive opens and closes on one line and does not nest.

    All tags are found first; tags of one line, outside fences, are then paired: an opening one with the
    closing one that stands next after it.
    """
    blocked = iter([*fences(body, r"[^\S\n]*", "```|~~~"), (len(body) + 1,) * 2])
    begin, end = next(blocked)
    lines: dict[int, list[re.Match]] = {}
    for tag in _tags(marker, style).finditer(body):
        while tag.start() >= end:
            begin, end = next(blocked)
        if tag.start() < begin and "\n" not in tag[0]:
            lines.setdefault(body.rfind("\n", 0, tag.start()) + 1, []).append(tag)
    spans, warnings = [], []
    for line, tags in lines.items():
        done = line  # where the search for opening tags goes on
        for i, tag in enumerate(tags):
            if tag["ends"] or tag.start() < done or body.count("`", line, tag.start()) % 2:
                continue
            policy, key_id = tag["policy"], dict(_ATTRIBUTE.findall(tag["attributes"])).get("key_id")
            if policy not in POLICIES[1:] or not key_id:
                warnings.append(f"invalid directive {policy}")
                continue
            closing = next((t for t in tags[i + 1 :] if t["ends"]), None)
            if closing is None or closing["policy"] != policy:
                warnings.append(f"unclosed directive {policy}")
                continue
            done = closing.end()
            if tags[i + 1] is closing:
                spans.append((policy, key_id, tag.end(), closing.start()))
            else:
                warnings.append(f"nested directive {policy}")
    return spans, warnings


def redacted(concepts: DataFrame, policy: str = "policy", allowed: str | None = None) -> DataFrame:
    """Bodies, titles and descriptions of protected concepts withheld from extensions, but where the
    concept allows it (a boolean column)."""
    hidden = F.coalesce(F.col(policy), F.lit("none")) != "none"
    if allowed:
        hidden = hidden & ~F.coalesce(F.col(allowed), F.lit(False))
    return concepts.withColumns({c: F.when(hidden, F.lit(None)).otherwise(F.col(c)) for c in ("body", "title", "description") if c in concepts.columns})


_PIECES = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("text", "policy", "key_id")]))


def _cut_up(body: str, marker: str = MARKER, style: str = "braces") -> list[tuple[str, str, str]]:
    """The body in pieces: (text, policy, key_id), policy ``none`` outside protected stretches."""
    out, at = [], 0
    for policy, key_id, start, end in inline_spans(body, marker, style)[0]:
        out += [(body[at:start], "none", ""), (body[start:end], policy, key_id)]
        at = end
    return [*out, (body[at:], "none", "")]


def protect_inline(body: Column, keys: dict[str, bytes], marker: str = MARKER, style: str = "braces") -> Column:
    """Protected stretches replaced: names and hashes by a vectorised function, encryption on the JVM.
    Directives stay, so that ``reveal_inline`` finds the envelopes; unknown keys raise."""

    def run(batch: pd.Series) -> pd.Series:
        def one(text):
            out = []
            for piece, policy, key_id in _cut_up(text, marker, style):
                if policy != "none" and key_id not in keys:
                    raise GridError("KEY_UNAVAILABLE", f"privacy key unavailable: {key_id}")
                if policy == "tokenize":
                    piece = tokenize_text(piece, keys[key_id])
                elif policy == "hash":
                    piece = named(HASH, keys[key_id], piece)
                out.append({"text": piece, "policy": policy, "key_id": key_id})
            return out

        return batch.map(one, na_action="ignore")

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    pieces = F.pandas_udf(run, _PIECES)(body)
    held = F.create_map(*[F.lit(x) for k, v in keys.items() for x in (k, v)])

    def sealed(p: Column) -> Column:
        box = F.base64(F.aes_encrypt(p["text"].cast("binary"), held[p["key_id"]], F.lit("GCM"), F.lit("DEFAULT")))
        return F.when(p["policy"] == "encrypt", F.concat(F.lit(ENVELOPE), F.regexp_replace(box, r"\s", ""))).otherwise(p["text"])

    return F.array_join(F.transform(pieces, sealed), "")


def reveal_inline(body: Column, key: bytes) -> Column:
    """Envelopes within a text opened with ``key``; those of other keys stay."""
    pattern = F.lit(f"({ENVELOPE}[A-Za-z0-9+/=]+)")
    boxes = F.array_distinct(F.regexp_extract_all(body, pattern, F.lit(1)))
    return F.aggregate(boxes, body, lambda text, box: F.replace(text, box, F.coalesce(decrypt(box, key), box)))


def protect(concepts: DataFrame, keys: dict[str, bytes]) -> DataFrame:
    """Bodies by each concept's ``policy`` and ``key_id``: encrypted, tokenized, hashed, or inline only."""
    made = protect_inline(F.when(F.coalesce("policy", F.lit("none")) == "none", F.col("body")), keys)
    for key_id, key in keys.items():
        mine = F.col("key_id") == key_id
        made = (
            F.when(mine & (F.col("policy") == "encrypt"), encrypt(F.col("body"), key))
            .when(mine & (F.col("policy") == "tokenize"), tokenized(F.col("body"), key))
            .when(mine & (F.col("policy") == "hash"), hashed(F.col("body"), key))
            .otherwise(made)
        )
    return concepts.withColumn("body", made)
