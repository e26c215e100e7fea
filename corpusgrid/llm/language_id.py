"""Language ID by error-correcting output codes.

Each language has a codeword of bits; one binary n-gram classifier predicts each bit, and the
language whose codeword loses least over all predicted bits wins. Bits weigh by how well they do on
the training sample, and a near second place flags the text as ambiguous.

* Codewords: for up to 7 languages the exhaustive code (all different splits of the languages in
  two); beyond that hashed bits, ``BITS`` for each doubling of the languages, without constant
  columns and without columns that split alike; of several draws the one whose codewords lie
  farthest apart.
* Bit classifier: log-odds of hashed byte trigrams of the lower-cased letters, estimated from
  the sample, averaged over a text and set on a logistic scale.
* Decoding: the loss of a codeword is the weighted sum of ``log(1 + exp(-bit * margin))``; the score
  is the winner's share of ``exp(-loss)``.
* Rejection: a text without a letter, or one whose winner loses more than a limit that the fit
  sets: what random letters of the sample's alphabet lose at least (all but ``MISSED`` of ``MADE`` made
  texts), or all but ``CLEAN`` of the sample's texts at most, whichever is more.

Every language of the labels is learned. The fit takes about ``SAMPLE`` documents of each, and fewer
(at least ``LEAST``) where there are more than ``TOTAL / SAMPLE`` languages. Trigrams are counted by
the executors; the driver gets one row of log-odds for each slot and one of margins for each sampled
document. Prediction takes whole texts, in pieces.

Defined results: null texts, empty texts and texts without a letter are ``und`` with score 0 (not
ambiguous); without training rows every text is ``und``, and only texts without a letter are
rejected; with one language all texts with letters are of it, with score 1; equal losses go to the
smaller language name; repeated documents keep their rows; extra columns are kept by
``keep_identified``, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgrid.llm.sampling import fold, fresh, logistic, per_label
from corpusgrid.runtime import cut, release, ship, spread

#: Documents of a language, at least of a language, and of all languages, that the fit takes.
SAMPLE, LEAST, TOTAL = 500, 20, 100_000
#: Hashed trigrams; code bits for each doubling of the languages; characters taken at once.
SLOTS, BITS, PIECE = 1 << 16, 12, 1 << 18
#: A second language with this share of the winner's likelihood makes a text ambiguous.
NEAR = 0.5
#: Texts of random letters, and their letters; the share of them that may pass; the share of the sample's own
#: texts that may lose more than the limit, where random letters lose less than they do.
MADE, LETTERS, MISSED, CLEAN = 200, 300, 0.01, 0.002
#: Languages up to which the code is exhaustive; draws of hashed codes; the share of a trigram that
#: none of the sample's texts has; units of a document's share of a trigram.
EXHAUSTIVE, DRAWS, FLOOR, UNIT = 7, 8, 2e-6, 1 << 40
UNKNOWN = "und"

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def trigrams(text: str) -> np.ndarray:
    """Slots of the byte trigrams of words with a space around each."""
    raw = b" " + b" ".join(text.lower().encode().translate(_LETTERS).split()) + b" "
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.empty(0, np.uint32)
    return ((a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761)) >> np.uint32(16)


def _drawn(count: int, draw: int) -> np.ndarray:
    """One draw of hashed columns: none constant, no two alike or opposite."""
    wanted, found, b = BITS * int(np.ceil(np.log2(count))), {}, 0
    while len(found) < wanted:
        column = np.array([hashlib.sha256(f"{draw}|{i}|{b}".encode()).digest()[0] & 1 for i in range(count)])
        b += 1
        if 0 < column.sum() < count:
            found.setdefault(bytes((column ^ column[0]).astype(np.uint8)), column)
    return np.array([*found.values()]).T * 2.0 - 1


def codewords(count: int) -> np.ndarray:
    """A row of +1 and -1 for each language; columns differ and split the languages."""
    if count < 2:
        return np.ones((count, 0))
    if count <= EXHAUSTIVE:
        zeros = [s for n in range(1, count) for s in combinations(range(1, count), n)]
        return np.array([[-1.0 if i in s else 1.0 for s in zeros] for i in range(count)])
    draws = [_drawn(count, d) for d in range(DRAWS)]
    return max(draws, key=lambda codes: -(codes @ codes.T - 2 * codes.shape[1] * np.eye(count)).max())


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    table: np.ndarray  # log-odds: slot by bit
    scale: np.ndarray  # slope and constant of each bit's margin
    weights: np.ndarray
    limit: float = np.inf  # the loss above which a winner is rejected

    def means(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.codes.shape[1]), 0
        for at in range(0, len(text), PIECE):
            slots = trigrams(text[max(0, at - 2) : at + PIECE])
            total += self.table[slots].sum(axis=0, dtype=np.float64)
            n += len(slots)
        return total / max(n, 1)

    def losses(self, means: np.ndarray) -> np.ndarray:
        margins = self.scale[0] * means + self.scale[1]
        return (self.weights * np.logaddexp(0, -self.codes * margins)).sum(axis=1)

    def predict(self, text: str | None) -> tuple[str, float, bool, bool]:
        """Language, score, whether another is near, whether the text is rejected."""
        if not has_letter(text):
            return UNKNOWN, 0.0, False, True
        if not self.languages:
            return UNKNOWN, 0.0, False, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False, False
        losses = self.losses(self.means(text))
        likely = np.exp(losses.min() - losses)
        order = np.argsort(losses, kind="stable")
        near = bool(likely[order[1]] >= NEAR)
        return self.languages[order[0]], float(1 / likely.sum()), near, bool(losses[order[0]] > self.limit)


def _scaled(means: np.ndarray, bits: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and constant of a logistic curve over one bit's means."""
    size = np.abs(means).mean() or 1.0
    slope, constant = logistic((means / size)[:, None], (bits > 0).astype(float), len(means) * ridge, len(means) * ridge)
    return slope / size, constant


def _table(rows: DataFrame, languages: list[str], codes: np.ndarray) -> np.ndarray:
    """Log-odds of each slot and bit, from the sampled ``rows`` (lang, text)."""

    def count(batches):
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.bincount(trigrams(text.as_py()), minlength=SLOTS)
                own = sums.setdefault(lang, np.zeros(SLOTS, np.int64))
                own += (found * (UNIT / max(1, found.sum()))).astype(np.int64)
            for lang, own in sums.items():
                slots = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slots), pa.string()), pa.array(slots, pa.int32()), pa.array(own[slots])], names=["lang", "slot", "n"])

    counts = cut(rows.mapInArrow(count, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")))
    totals = dict(counts.groupBy("lang").agg(F.sum("n")).collect())
    place = {k: i for i, k in enumerate(languages)}
    size = np.array([max(1, totals.get(k, 0)) for k in languages], float)
    ones = np.maximum((codes > 0).sum(axis=0), 1), np.maximum((codes < 0).sum(axis=0), 1)

    def odds(batches):
        for batch in batches:
            made = []
            for held in batch.column(1).to_pylist():
                shares = np.zeros(len(languages))
                for entry in held:
                    shares[place[entry["lang"]]] = entry["n"] / size[place[entry["lang"]]]
                one, zero = shares @ (codes > 0) / ones[0], shares @ (codes < 0) / ones[1]
                made.append(np.log((one + FLOOR) / (zero + FLOOR)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["slot", "odds"])

    gathered = counts.groupBy("slot").agg(F.collect_list(F.struct("lang", "n")).alias("held"))
    table = np.zeros((SLOTS, codes.shape[1]), np.float32)
    for slot, found in gathered.mapInArrow(odds, "slot int, odds binary").collect():
        table[slot] = np.frombuffer(bytes(found), np.float32)
    return table


def fit(docs: DataFrame, sample: int = SAMPLE, total: int = TOTAL) -> Model:
    """The model from a bounded sample of ``docs`` (doc_id, text, lang)."""
    spark = docs.sparkSession
    ship(spark)
    labelled = docs.select("doc_id", docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text"))
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    kinds = labelled.select("lang").distinct().count()
    each = min(sample, max(LEAST, total // max(1, kinds)))
    rows = spread(cut(per_label(labelled, "lang", each, 11, "doc_id", "text").select("lang", "text")))
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
    codes = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, codes, np.zeros((0, 0)), np.zeros((2, 0)), np.zeros(0))
    model = Model(languages, codes, _table(rows, languages, codes), np.ones((2, codes.shape[1])), np.ones(codes.shape[1]))
    sent = spark.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            found = [sent.value.means(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["lang", "means"])

    seen = sorted((r[0], bytes(r[1])) for r in rows.mapInArrow(measure, "lang string, means binary").collect())
    means = np.array([np.frombuffer(m) for _, m in seen])
    own = np.array([languages.index(k) for k, _ in seen])
    for b in range(codes.shape[1]):
        bits = codes[own, b]
        model.scale[:, b] = _scaled(means[:, b], bits)
        wrong = ((model.scale[0, b] * means[:, b] + model.scale[1, b]) * bits <= 0).mean()
        wrong = min(max(wrong, 1e-3), 0.49)
        model.weights[b] = np.log((1 - wrong) / wrong)
    model.weights /= model.weights.mean()
    model.limit = _limit(model, means)
    return model


def _limit(model: Model, means: np.ndarray) -> float:
    """The loss above which a text is no more like any language than random letters are."""
    draw = np.random.default_rng(7)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    made = []
    for i in range(MADE):
        drawn = draw.choice(letters, LETTERS)
        if i % 2:  # every other one in words
            drawn[draw.random(LETTERS) < 0.15] = " "
        made.append(float(model.losses(model.means("".join(drawn))).min()))
    return float(max(np.quantile(made, MISSED), np.quantile([model.losses(m).min() for m in means], 1 - CLEAN)))


def identify(docs: DataFrame, model: Model, names: tuple[str, ...] = ("lang_pred", "score", "ambiguous", "rejected")) -> DataFrame:
    """``docs`` with the language, its score, whether another is near, and whether the text is rejected."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop(*names)
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        own = sent.value
        for batch in batches:
            found = [own.predict(v.as_py()) for v in batch.column(at).cast(pa.string())]
            kinds = pa.string(), pa.float64(), pa.bool_(), pa.bool_()
            made = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])
        release()

    kinds = T.StringType(), T.DoubleType(), T.BooleanType(), T.BooleanType()
    added = [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous, rejected: fitted on the rows outside fold 2 of 4."""
    model = fit(docs.filter(fold(F.col("doc_id"), 4) != 2))
    found = identify(docs.select("doc_id", docs["text"].cast("string").alias("text")), model)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, with their own columns."""
    model = fit(docs.filter(fold(F.col("doc_id"), 4) != 2))
    names = fresh(docs, "language", "language_score", "language_near", "language_rejected")
    return identify(docs, model, names).filter(~F.col(names[3])).select(*docs.columns)
