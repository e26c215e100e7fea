"""BPE encoding and decoding with forced boundaries.

A merge can only ever make a token of the vocabulary. So where two neighbouring bytes occur side by
side inside no token, no merge crosses, and the text can be cut there for certain. ``Codec`` cuts at
the pre-tokenizer's word boundaries and at every such byte pair, encodes each fragment by itself
(lowest merge rank first, leftmost on ties) and joins the ids. Fragments and words recur, so short ones
are remembered in bounded dictionaries of each worker. In a long fragment all places of one rank
merge at once: a rule joins tokens that only rules of earlier ranks make (checked when the file is
read), so no merge opens one of an earlier rank, and the work grows with n log n.

The file must hold a byte-level BPE without a decoder, as checked when it is read. Normalization and
pre-tokenization are done here only if the file states the rules named below, and for texts in ``PLAIN``
characters, where these are simple (lower case, letters, digits, the rest); other texts go through the tokenizer
file's own normalizer and pre-tokenizer, and their words are then encoded in the same way.

Long texts are taken in pieces that end at white space, so memory is bounded by ``PIECE`` characters
and the longest run without white space.

Defined results: a null text is encoded as the empty text (no ids, empty decoded text); special
tokens written in a text become their ids, as the tokenizer does; repeated rows and ids keep their
rows; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusgrid.runtime import ship

#: Words and fragments remembered by a worker; characters taken at once.
WORDS, FRAGMENTS, PIECE = 300_000, 100_000, 1 << 20
#: Bytes of a word or fragment that is remembered at most; bytes from which merges run rank by rank.
SHORT, LONG = 64, 200

#: The characters for which ``_PLAIN_WORD`` equals the tokenizer's own rules, and the
#: contractions that its pattern takes first.
PLAIN = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e¡-įı-ſ‐-‧‰-⁞₠-₿]")
_L, _N = "a-zªµºß-öø-ſ", "0-9²³¹¼-¾"
_PLAIN_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")
_SPACE = re.compile("[\t\n\x0b\x0c\r ]")

#: The normalizer and the pattern of words for which ``PLAIN`` and ``_PLAIN_WORD`` hold.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class _Words(dict):
    """Ids of each word as packed integers, made where missing."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, word):
        if len(word) > SHORT:  # rare, and large
            return self.make(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = found = self.make(word)
        return found


class Codec:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [spec["pre_tokenizer"]])
        if model["type"] != "BPE" or model["continuing_subword_prefix"] or model["dropout"] or model["byte_fallback"] or spec["decoder"]:
            raise ValueError("not a byte-level BPE file without a decoder")
        if not any(s and s["type"] == "ByteLevel" and not s["add_prefix_space"] for s in steps):
            raise ValueError("words are not spelled in bytes")
        self.plain = (spec["normalizer"] or {}).get("normalizers") == _NORMALIZER and [s.get("pattern") for s in steps] == [_PATTERN, None]
        self.library = Tokenizer.from_file(path)
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        chars = byte_characters()
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.inner = [vocab[c] for c in chars]
        self.final = [vocab[c + suffix] for c in chars]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(vocab[a] << 20) | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in reversed([*enumerate(merges)])}
        self.rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        keys = np.array([a << 20 | b for a, b, _ in self.rules], np.int64)
        order = np.lexsort((np.arange(len(keys)), keys))
        first = np.ones(len(keys), bool)
        first[1:] = keys[order][1:] != keys[order][:-1]
        self.keys, self.rank_of = keys[order][first], order[first]
        made: dict[int, int] = {}
        for rank, (a, b, new) in enumerate(self.rules):
            made[new] = rank
        self.ordered = all(made.get(a, -1) < rank and made.get(b, -1) < rank for rank, (a, b, _) in enumerate(self.rules))
        self.joined = bytearray(1 << 16)
        for token in vocab:
            body = token.removesuffix(suffix) if suffix else token
            codes = [self.byte_of[c] for c in body]
            for a, b in zip(codes, codes[1:], strict=False):
                self.joined[a << 8 | b] = 1
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))) or r"(?!)")
        self.special_ids = {content: array("I", [i]).tobytes() for content, i in added.items()}
        names = {i: token for token, i in (vocab | added).items()}
        self.tokens = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.fragments = _Words(self._merged, FRAGMENTS)
        self.words = _Words(self._word, WORDS)
        self.spelled = _Words(lambda w: self._ids(bytes(map(self.byte_of.__getitem__, w))), FRAGMENTS)

    def cuts(self, word: bytes) -> list[int]:
        """Forced boundaries inside a word."""
        joined = self.joined
        return [i for i in range(1, len(word)) if not joined[word[i - 1] << 8 | word[i]]]

    def _merged(self, fragment: tuple[bytes, bool]) -> bytes:
        code, is_final = fragment
        ids = [self.inner[b] for b in code]
        if is_final:
            ids[-1] = self.final[code[-1]]
        if len(ids) > LONG and self.ordered:
            return self._by_rank(np.array(ids, np.int64)).astype("<u4").tobytes()
        ranks, none = self.ranks, (1 << 30, 0)
        pairs = [ranks.get(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best is none or best[0] == none[0]:
                break
            at = pairs.index(best)
            ids[at : at + 2] = [best[1]]
            del pairs[at]
            if at:
                pairs[at - 1] = ranks.get(ids[at - 1] << 20 | ids[at], none)
            if at < len(pairs):
                pairs[at] = ranks.get(ids[at] << 20 | ids[at + 1], none)
        return array("I", ids).tobytes()

    def _by_rank(self, ids: np.ndarray) -> np.ndarray:
        """The merges of one fragment, the places of each rank together and from left to right."""
        count = len(ids)
        left, right, alive = np.arange(-1, count - 1), np.arange(1, count + 1), np.ones(count, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def put(places: np.ndarray, others: np.ndarray) -> None:
            wanted = ids[places] << 20 | ids[others]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            known = self.keys[at] == wanted
            places, ranks = places[known], self.rank_of[at[known]]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            starts = np.flatnonzero(np.diff(ranks, prepend=-1))
            for rank, own in zip(ranks[starts].tolist(), np.split(places, starts[1:]), strict=True) if len(starts) else ():
                if rank not in waiting:
                    heapq.heappush(queue, rank)
                waiting.setdefault(rank, []).append(own)

        put(np.arange(count - 1), np.arange(1, count))
        while queue:
            rank = heapq.heappop(queue)
            a, b, new = self.rules[rank]
            places = np.unique(np.concatenate(waiting.pop(rank)))
            places = places[alive[places] & (ids[places] == a) & (right[places] < count)]
            places = places[ids[right[places]] == b]
            if a == b:  # a run of one token: every second place
                kept, taken = [], -1
                for place, other in zip(places.tolist(), right[places].tolist(), strict=True):
                    if place != taken:
                        kept.append(place)
                        taken = other
                places = np.array(kept, np.int64)
            others = right[places]
            after = right[others]
            ids[places], alive[others], right[places] = new, False, after
            inner = after < count
            left[after[inner]] = places[inner]
            before = left[places]
            put(before[before >= 0], places[before >= 0])
            put(places[inner], after[inner])
        return ids[alive]

    def _ids(self, word: bytes) -> bytes:
        edges = [0, *self.cuts(word), len(word)]
        parts = [(word[a:b], b == len(word)) for a, b in zip(edges, edges[1:], strict=False)]
        return b"".join([self.fragments[p] if len(p[0]) <= SHORT else self._merged(p) for p in parts])

    def _word(self, word: str) -> bytes:
        return self._ids(word.encode())

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, _PLAIN_WORD.findall(text.lower())))

    def _other(self, text: str) -> bytes:
        normal = self.library.normalizer.normalize_str(text)
        return b"".join([self.spelled[w] for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)])

    def pieces(self, text: str) -> Iterator[str]:
        """``text`` in pieces that end at white space, of ``PIECE`` characters or somewhat more."""
        at = 0
        while len(text) - at > PIECE:
            space = _SPACE.search(text, at + PIECE)
            end = space.end() if space else len(text)
            yield text[at:end]
            at = end
        if at < len(text):
            yield text[at:] if at else text

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as packed 32-bit integers, a chunk for each piece between special tokens."""
        for piece in self.pieces(text):
            at = 0
            for found in [*self.special.finditer(piece), None]:
                part = piece[at : found.start()] if found else piece[at:]
                if part:
                    yield self._plain(part) if self.plain and not PLAIN.search(part) else self._other(part)
                if found:
                    yield self.special_ids[found[0]]
                    at = found.end()

    def decode(self, ids: bytes) -> bytes:
        """The tokens' strings with a space between, in UTF-8: the file names no decoder."""
        return b" ".join(map(self.tokens.__getitem__, array("I", ids)))

    def text_of(self, ids: bytes) -> str:
        """The normalized text that the ids spell: words with a space after each."""
        joined = b"".join(map(self.tokens.__getitem__, array("I", ids))).decode()
        return bytes(b for part in joined.split("</w>") for b in [*map(self.byte_of.__getitem__, part), 32]).decode(errors="replace").strip()


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a tokenizer file, once for each worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, unless left out, ids (packed little-endian
    unsigned 32-bit integers) of whole texts; the decoded text is decoded from the ids."""
    ship(docs.sparkSession)
    kind = docs.select("doc_id").schema[0].dataType.simpleString()

    def run(batches):
        own = codec(path)
        for batch in batches:
            n, one, two, ids = [], [], [], []
            for value in batch.column(1):
                count, first, second, kept = 0, hashlib.sha256(), hashlib.sha256(), []
                for chunk in own.encode(value.as_py() or ""):
                    if chunk:
                        first.update(chunk)
                        if count:
                            second.update(b" ")
                        second.update(own.decode(chunk))
                        count += len(chunk) // 4
                        if keep_ids:
                            kept.append(chunk)
                n.append(count)
                one.append(first.hexdigest())
                two.append(second.hexdigest())
                ids.append(b"".join(kept))
            made = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": one, "decoded_sha256": two}
            yield pa.RecordBatch.from_pydict(made | ({"ids": pa.array(ids, pa.binary())} if keep_ids else {}))

    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, schema)
