"""Toxicity by compression distance.

Two zstandard dictionaries are trained with zstandard's own trainer, one on ordinary text and one on
toxic text. Every window of a text (a word with its spaces; longer words are cut every ``WINDOW``
bytes) is compressed with each, and the difference of the two lengths is the window's saving.
Thresholds are calibrated: a logistic curve over a document's largest saving, its number of windows and
its numbers of windows that save at least 6, 10, ... bytes, as such and against its length, fitted on
labelled rows whose half of the sample the dictionaries did not see.

What makes small windows tell:

* A window is compressed as a sequence of 8-byte codes, one for each of its bytes: a hash of up to
  ``CONTEXT`` bytes that end there, back to the space before the word. A stem that only toxic text
  has then costs whole literals with the ordinary dictionary and one match with the toxic one.
* The ordinary dictionary is the larger one (``SIZES``). What is common in both kinds of text is in
  both and saves nothing; what the toxic one alone holds is common there and rare elsewhere.
* The trainer takes its segments from stretches of its input, so the windows are shuffled first:
  large groups of copies would otherwise fill whole stretches. What it picks still hangs on the order,
  so ``PAIRS`` pairs are trained on different orders, and a window's saving is their mean.

The fit takes at most about ``SAMPLE`` labelled documents of either class and about ``BYTES`` bytes
of their windows, drawn by hashes; only these windows and the sample's features reach the driver.
Scoring takes whole texts.

Defined results: null and empty texts have one (low) score like any text without a saving; if either
class has no labelled row, the score is the share of toxic rows (0 without rows), and ``keep_clean``
then keeps every row; a document that is labelled more than once counts as toxic if any label says
so; a labelled id that repeats in ``docs`` is learned with its smallest text; repeated documents keep
their rows; extra columns are kept, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgrid.llm.sampling import fold, fresh, logistic, per_label
from corpusgrid.runtime import cut, release, ship, spread

#: Labelled documents of each class in the fit, and bytes of their windows.
SAMPLE, BYTES = 2400, 4 << 20
#: Bytes of the ordinary and the toxic dictionary; bytes of the segments that training picks.
SIZES, SEGMENT = (80 << 10, 12 << 10), 16
#: Pairs of dictionaries.
PAIRS = 2
#: Bytes of a window at most, and bytes that a code looks back on.
WINDOW, CONTEXT = 48, 8
#: Savings (bytes) from which windows are counted as features; windows of a generation that a
#: worker remembers.
LARGE, KNOWN = (6, 10, 16, 24, 32, 40), 200_000
#: Score from which a document counts as toxic; bytes of text taken at once; windows compressed at once.
THRESHOLD, PIECE, BLOCK = 0.7, 1 << 20, 20_000

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ODD = (np.arange(1, CONTEXT + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def windows(text: str) -> list[bytes]:
    """The lower-cased words of a text, long ones in parts."""
    found = text.lower().encode().translate(_LETTERS).split()
    if max(map(len, found), default=0) <= WINDOW:
        return found
    return [w[i : i + WINDOW] for w in found for i in range(0, len(w), WINDOW)]


def _codes(found: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The codes of each window, one after another, and the bytes of each window's codes."""
    a = np.frombuffer(b" " + b" ".join(found) + b" ", np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    inside = np.arange(1, len(a)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # bytes since the space before
    h = a[1:] * _ODD[0]
    for k in range(1, CONTEXT):
        h[k - 1 :] += np.where(inside[k - 1 :] >= k, (a[:-k] + np.uint64(1)) * _ODD[k], np.uint64(0))
        h ^= h >> np.uint64(31)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))).astype("<u8").tobytes(), sizes * 8


def _trained(found: list[bytes], size: int) -> bytes:
    """A dictionary of about ``size`` bytes for these windows."""
    import zstandard as zs

    if not found:
        return b" " * 8
    samples = []
    for at in range(0, len(found), BLOCK):
        codes, sizes = _codes(found[at : at + BLOCK])
        ends = np.cumsum(sizes)
        samples += [codes[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
    try:
        return zs.train_dictionary(size, samples, k=SEGMENT, d=8).as_bytes()
    except zs.ZstdError:  # too little text to train on: the text itself
        return b"".join(samples)[-size:].rjust(8)


def _compressor(content: bytes):
    import zstandard as zs

    knobs = zs.ZstdCompressionParameters(
        window_log=20, hash_log=17, chain_log=18, search_log=6, min_match=6, target_length=64, strategy=zs.STRATEGY_BTOPT,
        format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    trained = zs.ZstdCompressionDict(content)
    trained.precompute_compress(compression_params=knobs)
    return zs.ZstdCompressor(dict_data=trained, compression_params=knobs)


@dataclass
class Dictionaries:
    """The trained dictionaries of each pair."""

    ordinary: list[bytes]
    toxic: list[bytes]

    def open(self) -> Dictionaries:
        self._compressors = [_compressor(d) for d in self.ordinary], [_compressor(d) for d in self.toxic]
        self._known: dict[bytes, float] = {}
        self._older: dict[bytes, float] = {}
        return self

    def learn(self, found: set[bytes]) -> None:
        """Compresses the windows that are not remembered with both dictionaries. Of two generations the
        older one goes when the younger is full, so windows that recur stay."""
        import zstandard as zs

        if len(self._known) + len(found) > KNOWN:
            self._older, self._known = self._known, {}
        missing = found - self._known.keys()
        again = missing & self._older.keys()
        self._known.update({window: self._older[window] for window in again})
        missing = sorted(missing - again)
        for at in range(0, len(missing), BLOCK):
            block = missing[at : at + BLOCK]
            codes, sizes = _codes(block)
            ends = np.cumsum(sizes)
            places = np.stack([ends - sizes, sizes], axis=1).astype(np.uint64).tobytes()
            one, two = (
                sum(np.fromiter(map(len, c.multi_compress_to_buffer(zs.BufferWithSegments(codes, places), threads=1)), np.int64, len(block)) for c in kind)
                for kind in self._compressors
            )
            self._known.update(zip(block, ((one - two) / len(self.toxic)).tolist(), strict=True))

    def features(self, texts: list[str | None]) -> list[list[float]]:
        """Each text's features; the windows of all texts are compressed together."""
        counted, waiting, out, held = [], set(), [], 0
        sums = [[0.0, 0, *[0] * len(LARGE)] for _ in texts]

        def settle() -> None:
            self.learn(waiting)
            for i, found in counted:
                own = sums[i]
                for window, times in found.items():
                    saved = self._known[window]
                    own[1] += times
                    if saved > 0:
                        own[0] = max(own[0], saved)
                        for j, least in enumerate(LARGE):
                            if saved < least:
                                break
                            own[2 + j] += times
            counted.clear()
            waiting.clear()

        for i, text in enumerate(texts):
            for piece in _pieces(text or ""):
                found = Counter(windows(piece))
                counted.append((i, found))
                waiting.update(found)
                held += len(found)
                if len(waiting) >= BLOCK or held >= 4 * BLOCK:  # texts that share their windows are held too
                    settle()
                    held = 0
        settle()
        for most, count, *large in sums:
            dense = (np.array(large) / np.sqrt(count + 20)).tolist()
            out.append([most / 10, float(np.log1p(count)) / 3, *np.log1p(large).tolist(), *dense])
        return out


def _pieces(text: str):
    """A long text in pieces that end at a space, so that no word is cut; a longer word is."""
    at = 0
    while len(text) - at > PIECE:
        space = text.rfind(" ", at, at + PIECE)
        end = space + 1 if space >= at else at + PIECE
        yield text[at:end]
        at = end
    yield text[at:]


def train(toxic: list[bytes], ordinary: list[bytes]) -> Dictionaries:
    """The dictionaries from windows of either class."""

    def trained(found: list[bytes], size: int) -> list[bytes]:
        orders = (np.random.default_rng(3 + pair).permutation(len(found)).tolist() for pair in range(PAIRS))
        return [_trained([found[i] for i in order], size) for order in orders]

    return Dictionaries(trained(ordinary, SIZES[0]), trained(toxic, SIZES[1]))


@dataclass
class Model:
    dictionaries: Dictionaries | None
    weights: np.ndarray | None
    share: float

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.dictionaries is None:
            return [self.share] * len(texts)
        found = self.dictionaries.features(texts)
        if not found:
            return []
        at = np.array(found) @ self.weights[:-1] + self.weights[-1]
        return (1 / (1 + np.exp(-np.clip(at, -30, 30)))).tolist()


#: Weights where the sample is too small to calibrate.
_PLAIN = np.array([2.0, 0.0, *[0.0] * (2 * len(LARGE)), -3.0])


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """toxic, half, doc_id, text of the sampled documents, written once."""
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max(F.col("toxic").cast("int")) != 0).cast("int").alias("mark"))
    # at most sample * 2 * 1.2 rows, so a broadcast is bounded
    chosen = per_label(marks, "mark", sample, 5, "doc_id")
    joined = docs.select("doc_id", F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    half = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(2)).cast("int")
    return cut(joined.groupBy("doc_id").agg(F.max("mark").alias("mark"), F.min("text").alias("text")).select("mark", half.alias("half"), F.col("doc_id").cast("string").alias("doc_id"), "text"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from ``labels`` (doc_id, toxic) and the texts of a bounded sample of them."""
    spark = docs.sparkSession
    ship(spark)
    rows = _labelled(docs, labels, sample)
    sizes = dict(rows.groupBy("mark").agg(F.sum(F.octet_length("text"))).collect())
    if len(sizes) < 2:
        return Model(None, None, float(sizes.keys() == {1}))
    shares = {mark: min(1.0, BYTES / max(1, size)) for mark, size in sizes.items()}
    rows = spread(rows)

    def draw(batches):
        for batch in batches:
            kept = []
            for mark, name, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                found = windows(text.as_py())
                lots = np.random.default_rng(zlib.crc32(name.encode())).random(len(found))
                kept.append(b" ".join([found[i] for i in np.flatnonzero(lots < shares[mark]).tolist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(kept, pa.binary())], names=["mark", "half", "doc_id", "windows"])

    drawn = sorted(tuple(r) for r in rows.mapInArrow(draw, "mark int, half int, doc_id string, windows binary").collect())
    parts = {(m, h): [w for mark, half, _, found in drawn if (mark, half) == (m, h) for w in bytes(found).split()] for m in (0, 1) for h in (0, 1)}
    whole = train(parts[1, 0] + parts[1, 1], parts[0, 0] + parts[0, 1])
    if not all(any(r[:2] == key for r in drawn) for key in parts):
        return Model(whole, _PLAIN, 0.0)
    others = spark.sparkContext.broadcast([train(parts[1, 1 - half], parts[0, 1 - half]) for half in (0, 1)])

    def judge(batches):
        opened = [d.open() for d in others.value]
        for batch in batches:
            halves = np.array(batch.column(1))
            for half in (0, 1):
                part = batch.filter(pa.array(halves == half))
                found = opened[half].features(part.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(found, pa.list_(pa.float64()))], names=["mark", "doc_id", "found"])

    seen = sorted((r[1], r[0], r[2]) for r in rows.mapInArrow(judge, "mark int, doc_id string, found array<double>").collect())
    return Model(whole, logistic(np.array([r[2] for r in seen]), np.array([float(r[1]) for r in seen])), 0.0)


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with a score and the prediction."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop(*names)
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        own = sent.value
        if own.dictionaries is not None:  # opened for each task, so that its memory ends with it
            own = Model(Dictionaries(own.dictionaries.ordinary, own.dictionaries.toxic).open(), own.weights, own.share)
        for batch in batches:
            scores = own.scores(batch.column(at).cast(pa.string()).to_pylist())
            made = [pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])
        del own
        release()

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: fitted on the labels outside fold 1 of 3."""
    model = fit(docs, labels.filter(fold(F.col("doc_id"), 3) != 1))
    scored = score(docs.select("doc_id", docs["text"].cast("string").alias("text")), model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their own columns; all rows where the
    labels do not tell two classes apart."""
    model = fit(docs, labels.filter(fold(F.col("doc_id"), 3) != 1))
    if model.dictionaries is None:
        return docs
    names = fresh(docs, "toxicity", "toxic")
    return score(docs, model, names).filter(F.col(names[1]) == 0).select(*docs.columns)
