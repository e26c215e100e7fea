"""Media columns: GIF.

``decode`` reads any GIF: it unpacks the LZW code stream (variable widths, clear codes, deferred
clears), de-interlaces, applies local or global palettes, and ``render`` composes timed frames by
their disposal and transparency rules. ``frame_table`` stores frames with their times and colour
histograms as columns. ``encode`` writes a payload losslessly as 8-bit samples: frames of ``WIDTH``
columns and at most ``ROWS`` rows over a grey palette.

LZW is decoded without a loop over codes. After a clear code the width of the j-th code is known, so
codes unpack at once; the string of table entry k is the output from the k-th code's place on, one
sample longer than that code's own string. So each sample points at an earlier one, and following
pointers in doubling steps leads every sample to a literal.

Defined results: a null text counts as empty; the payload is padded with byte 32 to a positive
multiple of 192; equal texts give equal values; repeated rows keep their rows; an empty table gives
an empty result; extra columns are ignored; a broken GIF raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusgrid.runtime import ship

#: Samples in a row, rows in a frame at most, hundredths of a second for each frame.
WIDTH, ROWS, DELAY = 192, 256, 4
#: Fixed values of the format: codes for clear and end with 8-bit samples, entries of a full table.
CLEAR, STOP, FULL = 256, 257, 4096
#: Bins of a histogram for each colour channel.
BINS = 4

_GREYS = bytes(v for i in range(256) for v in (i, i, i))


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    transparent: int | None
    palette: np.ndarray
    samples: np.ndarray


def _widths(count: int, least: int, free: int) -> np.ndarray:
    """Bits of the j-th code after a clear code; ``free`` is the first entry of the table."""
    known = np.arange(free - 1, free - 1 + count)
    return np.clip(np.frexp(np.maximum(known, 1).astype(np.float64))[1], least + 1, 12)


_WIDTHS = _widths(FULL, 8, 258)
_STARTS = np.concatenate([[0], np.cumsum(_WIDTHS)])


def lzw_encode(data: bytes) -> bytes:
    """The code stream of 8-bit samples; the table is cleared when full."""
    runs, codes, table, free = [], [], {}, 258
    add, get = codes.append, table.get
    rest = iter(data)
    prefix = next(rest, None)
    if prefix is not None:
        for sample in rest:
            key = prefix << 8 | sample
            known = get(key)
            if known is not None:
                prefix = known
                continue
            add(prefix)
            table[key] = free
            free += 1
            prefix = sample
            if free == FULL:
                add(CLEAR)
                runs.append(codes)
                codes, table, free = [], {}, 258
                add, get = codes.append, table.get
        add(prefix)
    add(STOP)
    runs.append(codes)
    bits = [((CLEAR >> np.arange(9)) & 1).astype(np.uint8)]
    for run in runs:
        values, widths = np.array(run, np.uint16), _WIDTHS[: len(run)]
        places = np.arange(12)
        bits.append(((values[:, None] >> places) & 1).astype(np.uint8)[places < widths[:, None]])
    return np.packbits(np.concatenate(bits), bitorder="little").tobytes()


def _strings(codes: np.ndarray, clear: int) -> np.ndarray:
    """The samples of the codes between two clear codes."""
    count = len(codes)
    if not count:
        return np.empty(0, np.uint8)
    own, literal = np.arange(count), codes < clear
    entry = codes - (clear + 2)
    if (~literal & ((entry >= own) | (entry < 0))).any():
        raise ValueError("a code before its entry")
    parent = np.where(literal, own, entry)
    lengths, at = (~literal).astype(np.int64), parent
    while not literal[at].all():
        lengths = lengths + lengths[at]
        at = at[at]
    lengths += 1
    starts = np.cumsum(lengths) - lengths
    total = int(starts[-1] + lengths[-1])
    source = np.arange(total) + np.repeat(np.where(literal, 0, starts[parent] - starts), lengths)
    values, fixed = np.zeros(total, np.uint8), np.zeros(total, bool)
    values[starts[literal]] = codes[literal]
    fixed[starts[literal]] = True
    while not fixed[source].all():
        source = source[source]
    return values[source]


def lzw_decode(data: bytes, least: int) -> np.ndarray:
    """All samples of a code stream with ``least`` bits a sample."""
    clear, out, at = 1 << least, [], 0
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    bits = len(data) * 8
    while at + least + 1 <= bits:
        codes = []
        first, ended = 0, False
        while True:
            count = min(FULL, (bits - at) // (least + 1) + 1)
            if first == 0:
                widths = _WIDTHS[:count] if least == 8 else _widths(count, least, clear + 2)
                starts = at + (_STARTS[: count + 1] if least == 8 else np.concatenate([[0], np.cumsum(widths)]))
            else:
                widths = np.full(count, 12)
                starts = at + 12 * np.arange(count + 1)
            whole = int(np.searchsorted(starts[1:], bits, side="right"))
            places, widths = starts[:whole], widths[:whole]
            byte = places >> 3
            window = raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16
            found = (window >> (places & 7).astype(np.uint32)).astype(np.int64) & ((1 << widths) - 1)
            marks = np.flatnonzero((found == clear) | (found == clear + 1))
            if len(marks):
                mark = int(marks[0])
                codes.append(found[:mark])
                ended, at = found[mark] == clear + 1, int(starts[mark + 1])
                break
            codes.append(found)
            first, at = first + whole, int(starts[whole])
            if whole < count or whole == 0:
                ended = True
                break
        out.append(_strings(np.concatenate(codes), clear))
        if ended:
            break
    return np.concatenate(out) if out else np.empty(0, np.uint8)


def encode(payload: bytes) -> bytes:
    """``payload`` (a multiple of ``WIDTH`` bytes) as a GIF of grey 8-bit samples."""
    rows = len(payload) // WIDTH
    parts = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), _GREYS]
    for top in range(0, rows, ROWS):
        height = min(ROWS, rows - top)
        stream = lzw_encode(payload[top * WIDTH : (top + height) * WIDTH])
        parts.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, DELAY, 0, 0))
        parts.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, height, 0) + b"\x08")
        parts += [bytes([len(block)]) + block for block in (stream[i : i + 255] for i in range(0, len(stream), 255))]
        parts.append(b"\0")
    parts.append(b"\x3b")
    return b"".join(parts)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _rows_in_order(height: int) -> np.ndarray:
    return np.concatenate([np.arange(first, height, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes) -> tuple[int, int, Iterator[Frame]]:
    """Width and height of the canvas, and the frames one by one."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    at, shared = 13, np.empty((0, 3), np.uint8)
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        shared, at = np.frombuffer(data[at : at + size], np.uint8).reshape(-1, 3), at + size

    def frames(at: int) -> Iterator[Frame]:
        delay, disposal, transparent = 0, 0, None
        while at < len(data) and data[at] != 0x3B:
            if data[at] == 0x21:
                label = data[at + 1]
                block, at = _blocks(data, at + 2)
                if label == 0xF9:
                    packed, delay, index = struct.unpack("<BHB", block[:4])
                    disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
                continue
            if data[at] != 0x2C:
                raise ValueError("unknown block")
            left, top, w, h, packed = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at, palette = at + 10, shared
            if packed & 0x80:
                size = 3 << ((packed & 7) + 1)
                palette, at = np.frombuffer(data[at : at + size], np.uint8).reshape(-1, 3), at + size
            least = data[at]
            stream, at = _blocks(data, at + 1)
            samples = lzw_decode(stream, least)
            if len(samples) < w * h:
                raise ValueError("too few samples")
            samples = samples[: w * h].reshape(h, w)
            if packed & 0x40:
                ordered = np.empty_like(samples)
                ordered[_rows_in_order(h)] = samples
                samples = ordered
            yield Frame(left, top, w, h, delay, disposal, transparent, palette, samples)
            delay, disposal, transparent = 0, 0, None

    return width, height, frames(at)


def render(width: int, height: int, frames: Iterator[Frame]) -> Iterator[tuple[int, np.ndarray]]:
    """(delay, RGBA canvas) after each frame is drawn, by disposal and transparency."""
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        box = np.s_[f.top : f.top + f.height, f.left : f.left + f.width]
        kept = canvas.copy() if f.disposal == 3 else None
        drawn = canvas[box]
        samples = f.samples[: drawn.shape[0], : drawn.shape[1]]
        palette = np.zeros((256, 4), np.uint8)
        palette[: len(f.palette), :3] = f.palette
        palette[:, 3] = 255
        seen = np.ones(samples.shape, bool) if f.transparent is None else samples != f.transparent
        drawn[seen] = palette[samples[seen]]
        yield f.delay, canvas.copy()
        if f.disposal == 2:
            canvas[box] = 0
        elif kept is not None:
            canvas = kept


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Counts of the opaque pixels in ``BINS`` bins for each of red, green and blue."""
    seen = rgba[rgba[..., 3] > 0]
    counts = [np.bincount(seen[:, c], minlength=256).reshape(BINS, -1).sum(axis=1) for c in range(3)]
    return np.concatenate(counts)


def timed_frames(media: bytes, each=lambda frame: None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, delay, RGBA canvas, histogram) of each rendered frame; ``each`` sees the stored frames."""

    def read() -> Iterator[Frame]:
        for frame in frames:
            each(frame)
            yield frame

    width, height, frames = decode(media)
    start = 0
    for delay, canvas in render(width, height, read()):
        yield start, delay, canvas, histogram(canvas)
        start += delay


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b" ")


def digest(text: str | None) -> tuple:
    """Stores one text and reads it back; the values of ``media_digests`` but the id."""
    n_bytes, payload = payload_of(text)
    media = encode(payload)
    size, sha, tail = 0, hashlib.sha256(), b""

    def read(frame: Frame) -> None:
        nonlocal size, tail
        stored = frame.samples.tobytes()
        size, tail = size + len(stored), (tail + stored)[-16:]
        sha.update(stored)

    frames = [(start, delay, seen.tolist()) for start, delay, _, seen in timed_frames(media, read)]
    colours = [sum(column) for column in zip(*(seen for _, _, seen in frames), strict=True)]
    feature = f"frames={len(frames)};centiseconds={sum(d for _, d, _ in frames)};rgb{BINS}=" + ",".join(map(str, colours))
    told = [dict(zip(("start_cs", "delay_cs", "histogram"), f, strict=True)) for f in frames]
    return n_bytes, size, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature, told


def media_digests(docs: DataFrame) -> DataFrame:
    """Each document's text stored as GIF and read back, as digests, and its rendered frames' times and
    histograms; the feature sums them up."""
    ship(docs.sparkSession)
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames"]
    frame = pa.struct([("start_cs", pa.int64()), ("delay_cs", pa.int32()), ("histogram", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            rows = [digest(value.as_py()) for value in batch.column(1)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(frame)]
            made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", *names])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, frames array<struct<start_cs: bigint, delay_cs: int, histogram: array<bigint>>>"
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, schema)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the GIF of each text."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            rows = [(n, encode(p)) for n, p in (payload_of(v.as_py()) for v in batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


def frame_table(media: DataFrame, key: str, column: str = "media") -> DataFrame:
    """One row per rendered frame: key, frame, start_cs, delay_cs, width, height, rgba, histogram.
    Null media have no frames."""
    ship(media.sparkSession)

    def run(batches):
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not value.is_valid:
                    continue
                for i, (start, delay, canvas, seen) in enumerate(timed_frames(value.as_py())):
                    row = {key: k, "frame": i, "start_cs": start, "delay_cs": delay, "width": canvas.shape[1], "height": canvas.shape[0],
                           "rgba": canvas.tobytes(), "histogram": seen.tolist()}
                    yield pa.RecordBatch.from_pylist([row], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql import types as T

    fields = [media.select(key).schema[0], T.StructField("frame", T.IntegerType()), T.StructField("start_cs", T.LongType()),
              T.StructField("delay_cs", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
              T.StructField("rgba", T.BinaryType()), T.StructField("histogram", T.ArrayType(T.LongType()))]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)
    return media.select(key, column).mapInArrow(run, schema)
