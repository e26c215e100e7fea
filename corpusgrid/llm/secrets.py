"""Secret scans: patterns, and novelty against dictionaries.

Three patterns give the base spans: assignments to sensitive names, access key ids, long hexadecimal runs.
Beyond them a candidate is a run of key characters that follows a sensitive word on its line. Its novelty is
what it adds to the compressed size of its surroundings, in bytes for each of its own, under zstandard primed
with identifiers: names that code is made of and the most frequent words of the corpus, each in three cases. Names,
paths and words are made of what the compressor holds already and add little; keys add about a byte for
each character, so candidates from LEAST on are reported as kind ``novel``.

Defined results: null is an empty text and has no span; spans count code points, ends are exclusive; a candidate that
overlaps a base span is left to it; repeated rows are scanned each; a candidate that stands several times
near itself is measured without its copies; no rows give no rows. Other columns are left out, a null id stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgrid.runtime import cut, release, ship

#: Fixed patterns of the base spans, in order; of an assignment the second group has its least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A shorter run fails, and a run of this length or more is found whole where it begins.
HEX = re.compile("[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")
ASSIGNED, ACCESSED = 12, 18

#: Words after which a line is sensitive.
SENSITIVE = re.compile(
    "passw(?:or)?d|passphrase|pwd|secret|token|credential|authorization|bearer|signature|(?:api|access|private|client|session|auth)[_-]?(?:key|id|token)",
    re.ASCII | re.IGNORECASE,
)
SHORTEST = 12
CANDIDATE = re.compile(f"[A-Za-z0-9+/_=-]{{{SHORTEST},}}", re.ASCII)
#: Characters after a sensitive word in which a candidate begins, and characters of surroundings on each side.
REACH, AROUND = 48, 256
#: Added bytes for each byte from which a candidate is novel: of made keys of 14 to 40 characters 99 of 100 lie
#: above it, of names of two or three words 99 of 100 below.
LEAST = 0.85
#: Frequent words of the corpus in the dictionary.
FREQUENT = 2000
#: What names in code are made of.
PARTS = """access account address admin alias application argument array auth authentication authorization base bearer boolean bucket buffer
cache catalog certificate channel class client cluster code column command common config configuration connection console constant
container content context controller cookie count create credential current data database date default delete deploy description device
directory document domain driver element email encoding encrypt endpoint engine environment error event example exception expire export
factory field file filter final folder format function gateway generate global group handler hash header host identifier image import index
input instance integer interface item key language length level library limit link list listener load local location logger login manager
message metadata method model module monitor name namespace network node number object offset option order output owner package page
parameter parent password path pattern payload permission pipeline platform plugin policy port private process production profile project
property provider proxy public query queue""".split()

SPANS = "doc_id long, spans array<struct<kind: string, start: int, end: int, novelty: double>>"


def frequent_words(docs: DataFrame, most: int = FREQUENT) -> list[str]:
    """The ``most`` most frequent words of 4 to 16 letters, over all texts; ties go to the smaller."""
    # runs of letters with the short and the long ones among them are cut by the length, not in the pattern
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-zÀ-ÿ]{4,}"), F.lit(0))).alias("word")).filter(F.length("word") <= 16)
    counted = cut(words.groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n")))
    # counts by eighths of doublings are a few hundred numbers: they tell from which count on ``most`` words lie, so no
    # task offers more than its share of these
    grade = F.floor(F.log2("n") * 8).cast("int")
    held, least = 0, 0
    for r in sorted(counted.groupBy(grade.alias("g")).count().collect(), key=lambda r: -r["g"]):
        held, least = held + r["count"], r["g"]
        if held >= most:
            break
    return [r["word"] for r in counted.filter(grade >= least).orderBy(F.desc("n"), "word").limit(most).collect()]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, leftmost and without overlap within a kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGNED]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESSED]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


class Novelty:
    """Added compressed bytes, with dictionaries of names and frequent words."""

    def __init__(self, words: list[str]):
        import zstandard

        # the most frequent words last: near ones cost less
        names = [*reversed(words), *PARTS]
        held = "\n".join(x for n in names for x in (n.upper(), n.title(), n)).encode()
        primed = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        bare = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
        settings = zstandard.ZstdCompressionParameters.from_level(9, min_match=3, **bare)
        self.compressor = zstandard.ZstdCompressor(dict_data=primed, compression_params=settings)
        #: A stretch of the dictionary before each text: a block that saves little would be stored as it is, and
        #: a name in it would cost as much as a key.
        self.saved = held[: len(held) // 2][-400:]

    def added(self, candidate: str, before: str, after: str) -> float:
        """Bytes that the candidate adds to its surroundings, for each of its own bytes."""
        around = self.saved + f"{before}\n{after}".replace(candidate, " ").encode() + b"\n"
        alone = len(self.compressor.compress(around))
        return (len(self.compressor.compress(around + candidate.encode())) - alone) / len(candidate)

    def spans(self, text: str, base: list[tuple[str, int, int]], least: float) -> list[tuple[str, int, int, float]]:
        """The candidates of a text that are novel and overlap no base span."""
        taken: list[list[int]] = []  # base spans, those that overlap joined
        for start, end in sorted((start, end) for _, start, end in base):
            if taken and start < taken[-1][1]:
                taken[-1][1] = max(end, taken[-1][1])
            else:
                taken.append([start, end])
        found, seen, i = [], 0, 0
        for word in SENSITIVE.finditer(text):
            line = text.find("\n", word.end(), word.end() + REACH)
            until = line if line >= 0 else word.end() + REACH
            at = max(word.end(), seen)
            while begin := CANDIDATE.search(text, at, max(at, until + SHORTEST)):
                m = CANDIDATE.match(text, begin.start())
                at = seen = m.end()
                while i < len(taken) and taken[i][1] <= m.start():
                    i += 1
                if i < len(taken) and taken[i][0] < m.end():
                    continue
                novelty = self.added(m[0], text[max(0, word.start() - AROUND) : m.start()], text[m.end() : m.end() + AROUND])
                if novelty >= least:
                    found.append(("novel", m.start(), m.end(), novelty))
        return found


def scan(docs: DataFrame, words: list[str] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id and all spans of each text, by start, kind and end; base ones have no novelty. ``words`` are those of
    the dictionary, the corpus's own if none are given."""
    ship(docs.sparkSession)
    known = frequent_words(docs) if words is None else words
    places = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        measure = Novelty(known)
        for batch in batches:
            spans = []
            for text in batch["text"]:
                text = text or ""
                base = base_spans(text)
                both = [(*b, None) for b in base] + measure.spans(text, base, least)
                spans.append([dict(zip(("kind", "start", "end", "novelty"), s, strict=True)) for s in sorted(both, key=lambda s: (s[1], places[s[0]], s[2]))])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": spans})
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, SPANS)


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, the digest of all base spans, and all spans as kind:start:end."""
    base = F.filter("spans", lambda s: s["kind"] != "novel")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
