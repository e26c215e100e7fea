import os
import struct

import numpy as np
import pytest

from corpusgrid.llm import gif
from tests.llm.helpers import TEXTS, documents, empty


def slow_decode(data, least):
    """LZW as the format describes it, code by code."""
    clear, bits, at = 1 << least, "".join(f"{b:08b}"[::-1] for b in data), 0
    out, width, table, last = b"", least + 1, {}, None

    def fresh():
        return {i: bytes([i]) for i in range(clear)} | {clear: b"", clear + 1: b""}

    table = fresh()
    while at + width <= len(bits):
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == clear:
            table, width, last = fresh(), least + 1, None
            continue
        if code == clear + 1:
            break
        entry = table[code] if code in table else last + last[:1]
        out += entry
        if last is not None and len(table) < 4096:
            table[len(table)] = last + entry[:1]
        if len(table) == 1 << width and width < 12:
            width += 1
        last = entry
    return out


@pytest.mark.parametrize("data", [b"", b"a", b"aaaa" * 999, bytes(range(256)) * 60, os.urandom(30000), "Déjà vu. ".encode() * 700])
def test_code_streams(data):
    stream = gif.lzw_encode(data)
    assert gif.lzw_decode(stream, 8).tobytes() == data == slow_decode(stream, 8)


def packed(codes, least):
    """Codes with the widths that the format gives them, without a clear when the table is full."""
    bits, width, free = "", least + 1, (1 << least) + 2
    first = True
    for c in codes:
        bits += f"{c:0{width}b}"[::-1]
        if c == 1 << least:
            width, free, first = least + 1, (1 << least) + 2, True
            continue
        if not first and free < 4096:
            free += 1
        first = False
        if free == 1 << width and width < 12:
            width += 1
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))


def test_deferred_clear_and_small_palettes():
    codes = [4] + [i % 4 for i in range(6000)] + [5]
    stream = packed(codes, 2)
    assert gif.lzw_decode(stream, 2).tobytes() == slow_decode(stream, 2) == bytes(i % 4 for i in range(6000))


def made(frames, width=4, height=2, palette=bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])):
    out = b"GIF89a" + struct.pack("<HHBBB", width, height, 0x81, 0, 0) + palette
    for samples, box, delay, disposal, transparent, interlaced in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (transparent is not None), delay, transparent or 0, 0)
        out += b"\x2c" + struct.pack("<HHHHB", *box, 0x40 * interlaced) + b"\x02"
        stream = packed([4, *samples, 5], 2)
        out += bytes([len(stream)]) + stream + b"\0"
    return out + b"\x3b"


def test_disposal_and_transparency():
    data = made([
        ([1] * 8, (0, 0, 4, 2), 5, 1, None, False),
        ([2, 0, 2, 0], (0, 0, 2, 2), 7, 2, 0, False),
        ([3, 3], (2, 0, 2, 1), 9, 3, None, False),
        ([2], (3, 1, 1, 1), 1, 0, None, False),
    ])
    width, height, frames = gif.decode(data)
    shown = list(gif.render(width, height, frames))
    assert [d for d, _ in shown] == [5, 7, 9, 1]
    red, green, blue, clear = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    as_rows = [[[tuple(int(v) for v in p) for p in row] for row in canvas] for _, canvas in shown]
    assert as_rows[0] == [[red] * 4] * 2
    assert as_rows[1] == [[green, red, red, red], [green, red, red, red]]
    assert as_rows[2] == [[clear, clear, blue, blue], [clear, clear, red, red]]
    assert as_rows[3] == [[clear, clear, red, red], [clear, clear, red, green]]
    assert gif.histogram(shown[2][1]).tolist() == [2, 0, 0, 2, 4, 0, 0, 0, 2, 0, 0, 2]


def test_interlaced_rows():
    rows = list(range(10))
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    samples = [r % 4 for r in order for _ in range(4)]
    data = made([(samples, (0, 0, 4, 10), 1, 0, None, True)], height=10)
    _, _, frames = gif.decode(data)
    assert next(frames).samples[:, 0].tolist() == [r % 4 for r in rows]


def test_broken_files():
    with pytest.raises(ValueError):
        gif.decode(b"PNG")
    with pytest.raises(ValueError):
        list(gif.decode(made([([1], (0, 0, 4, 2), 1, 0, None, False)]))[2])


def test_table(spark):
    found = gif.media_digests(documents(spark)).collect()
    assert len(found) == len(TEXTS)
    import hashlib
    import zlib

    for r, (_, text, _, _) in zip(sorted(found, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_bytes)), sorted(TEXTS, key=lambda t: (t[0] is None, t[0] or 0)), strict=True):
        raw = (text or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert gif.media_digests(empty(spark)).count() == 0
    frames = gif.frame_table(gif.store(documents(spark)), "doc_id").collect()
    many = [f for f in frames if f.doc_id == 9]
    assert {f.start_cs for f in many} == {0} and all(sum(f.histogram) == 3 * f.width * f.height for f in frames)


def test_long_texts_take_several_frames():
    n, payload = gif.payload_of("x" * 100_000)
    _, _, frames = gif.decode(gif.encode(payload))
    found = list(frames)
    assert len(found) == 3 and b"".join(f.samples.tobytes() for f in found) == payload


def test_features_come_from_rendered_frames():
    text = "abc é " * 15_000
    _, payload = gif.payload_of(text)
    told = gif.digest(text)
    rows = len(payload) // gif.WIDTH
    canvas, expected = np.zeros((gif.ROWS, gif.WIDTH), int), []
    for top in range(0, rows, gif.ROWS):  # a shorter last frame leaves what the frame before drew
        part = np.frombuffer(payload[top * gif.WIDTH : (top + gif.ROWS) * gif.WIDTH], np.uint8).reshape(-1, gif.WIDTH)
        canvas[: len(part)] = part
        expected.append(np.bincount(canvas.ravel() // 64, minlength=4).tolist() * 3)
    assert [f["histogram"] for f in told[-1]] == expected and [f["start_cs"] for f in told[-1]] == [4 * i for i in range(len(expected))]
    assert told[-2].endswith(",".join(str(sum(c)) for c in zip(*expected, strict=True)))
