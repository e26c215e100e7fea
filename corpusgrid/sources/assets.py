"""Files other than Markdown: media types, text decisions and codecs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgrid.errors import GridError
from corpusgrid.runtime import ship
from corpusgrid.sources import bundle

#: Bytes of one file and of all files at most; the share of printable characters of a text; bytes that
#: tell a file's type.
LARGEST, TOTAL, PRINTABLE, TELLING = 32 << 20, 1 << 30, 0.9, 512
#: Media types by extension.
EXTENSIONS = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "pdf": "application/pdf",
    "txt": "text/plain", "log": "text/plain", "md": "text/plain", "ini": "text/plain", "csv": "text/csv", "json": "application/json", "xml": "application/xml",
    "yaml": "application/x-yaml", "yml": "application/x-yaml", "toml": "application/toml", "html": "text/html", "htm": "text/html", "css": "text/css",
    "js": "application/javascript", "jsx": "text/jsx", "ts": "text/x-typescript", "tsx": "text/x-typescript", "go": "text/x-go", "py": "text/x-python",
    "rs": "text/x-rust", "c": "text/x-c", "h": "text/x-c", "cc": "text/x-c++", "cpp": "text/x-c++", "cxx": "text/x-c++", "hpp": "text/x-c++", "hh": "text/x-c++",
    "hxx": "text/x-c++", "java": "text/x-java", "scala": "text/x-scala", "sc": "text/x-scala", "dart": "text/x-dart", "zig": "text/x-zig",
    "sh": "text/x-shellscript", "sql": "text/x-sql",
}
#: Types beside ``text/`` that are text.
TEXT_LIKE = ("application/json", "application/xml", "application/javascript", "application/x-yaml", "application/toml")
#: Fixed values of the public MIME sniffing standard: tags that begin HTML, first bytes of formats (a dot
#: stands for any byte), and the bytes that no text holds.
TAGS = (
    b"<!doctype html", b"<html", b"<head", b"<script", b"<iframe", b"<h1", b"<div", b"<font", b"<table", b"<a", b"<style", b"<title", b"<b", b"<body", b"<br", b"<p", b"<!--",
)
MAGIC = [
    (rb"%PDF-", "application/pdf"), (rb"%!PS-Adobe-", "application/postscript"), (rb"\xfe\xff..|\xff\xfe..|\xef\xbb\xbf.", "text/plain"),
    (rb"\x00\x00\x01\x00|\x00\x00\x02\x00", "image/x-icon"), (rb"BM", "image/bmp"), (rb"GIF87a|GIF89a", "image/gif"), (rb"RIFF....WEBPVP", "image/webp"),
    (rb"\x89PNG\r\n\x1a\n", "image/png"), (rb"\xff\xd8\xff", "image/jpeg"), (rb"FORM....AIFF", "audio/aiff"), (rb"ID3", "audio/mpeg"),
    (rb"OggS\x00", "application/ogg"), (rb"MThd\x00\x00\x00\x06", "audio/midi"), (rb"RIFF....AVI ", "video/avi"), (rb"RIFF....WAVE", "audio/wave"),
    (rb"....ftypmp4", "video/mp4"), (rb"\x1a\x45\xdf\xa3", "video/webm"), (rb"\x00\x01\x00\x00", "font/ttf"), (rb"OTTO", "font/otf"), (rb"ttcf", "font/collection"),
    (rb"wOFF", "font/woff"), (rb"wOF2", "font/woff2"), (rb"\x1f\x8b\x08", "application/x-gzip"), (rb"PK\x03\x04", "application/zip"),
    (rb"Rar!\x1a\x07\x00|Rar!\x1a\x07\x01\x00", "application/x-rar-compressed"), (rb"\x00asm", "application/wasm"),
]
_MAGIC = [(re.compile(first, re.DOTALL), kind) for first, kind in MAGIC]
_HTML = re.compile(rb"(?i)[\t\n\x0c\r ]*(?:" + b"|".join(map(re.escape, TAGS)) + rb")[ >]|[\t\n\x0c\r ]*<!--")
_XML = re.compile(rb"[\t\n\x0c\r ]*<\?xml")
_BINARY = re.compile(rb"[\x00-\x08\x0b\x0e-\x1a\x1c-\x1f]")
UNKNOWN = "application/octet-stream"


def text_like(media_type: str) -> bool:
    return media_type.startswith("text/") or media_type in TEXT_LIKE


def _decoded(data: bytes) -> str | None:
    """UTF-8 without a zero byte, or None."""
    try:
        return None if b"\0" in data else data.decode()
    except UnicodeDecodeError:
        return None


def is_text(media_type: str, data: bytes) -> bool:
    """Valid UTF-8 without a zero byte, of a text-like type or nearly all printable."""
    text = _decoded(data)
    if text is None:
        return False
    return text_like(media_type) or sum(c >= " " or c in "\t\n\r" for c in text) >= PRINTABLE * len(text)


def sniffed(data: bytes) -> str:
    """The type that the first bytes tell."""
    head = data[:TELLING]
    if _HTML.match(head):
        return "text/html"
    if _XML.match(head):
        return "text/xml"
    kind = next((kind for first, kind in _MAGIC if first.match(head)), None)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        kind = "image/webp"
    if kind is None:
        kind = UNKNOWN if _BINARY.search(head) else "text/plain"
    try:
        return kind if kind != "text/plain" or data.decode() is not None else kind
    except UnicodeDecodeError:
        return UNKNOWN


def detect(path: str, data: bytes) -> tuple[str, str | None]:
    """(media type, warning): a text-like extension wins for texts; else what the bytes tell, with a
    warning where the extension names another type; else the extension."""
    name = path.rpartition("/")[2]
    named = EXTENSIONS.get(name.rpartition(".")[2].lower()) if "." in name else None
    textual = named is not None and text_like(named)
    if textual and _decoded(data) is not None:
        return named, None
    seen = sniffed(data)
    if named is None or textual:
        return seen, None
    if seen in (UNKNOWN, named):
        return named, None
    return seen, f"media type mismatch: {named} named, {seen} found"


def media_filter(media_type: Column, wanted) -> Column:
    """Exact types and ``type/*``; all if none are named."""
    exact = [w for w in wanted if not w.endswith("/*")]
    found = media_type.isin(*exact) if exact else F.lit(not wanted)
    for w in wanted:
        if w.endswith("/*"):
            found = found | F.startswith(media_type, F.lit(w[:-1]))
    return found


BLOB = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("media_type", T.StringType()), T.StructField("is_text", T.BooleanType()),
    T.StructField("size", T.LongType()), T.StructField("content_hash", T.StringType()), T.StructField("body", T.StringType()), T.StructField("content", T.BinaryType()),
    T.StructField("warning", T.StringType()),
])


def scan(spark: SparkSession, root: str, wanted=()) -> DataFrame:
    """Files that are not Markdown, of the media types wanted; too large ones carry a warning and no content.
    A collection whose files pass ``TOTAL`` bytes raises."""
    ship(spark)
    def asked(files):
        return files.filter(~F.col("path").rlike(r"(?i)\.(md|tmp|swp)$") & ~F.endswith("path", F.lit("~")))
    listed = asked(bundle.listed(spark, root))
    found = bundle.contents(listed, root) if bundle.in_tasks(spark, root) else asked(bundle.files(spark, root))
    whole = listed.filter(F.col("length") <= LARGEST).agg(F.sum("length")).first()[0] or 0  # from the listing
    if whole > TOTAL:
        raise GridError("BUNDLE_TOO_LARGE", f"assets hold {whole} bytes, more than {TOTAL}")
    sized = found.select("path", F.col("length").cast("long").alias("size"), F.when(F.col("length") <= LARGEST, F.col("content")).alias("content"), F.sha2("content", 256).alias("content_hash"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, size, content, digest in zip(batch["path"], batch["size"], batch["content"], batch["content_hash"], strict=True):
                if content is None:
                    rows.append((path, path, None, False, size, digest, None, None, "file is too large"))
                    continue
                data = bytes(content)
                kind, warning = detect(path, data)
                text = is_text(kind, data)
                rows.append((path, path, kind, text, size, digest, data.decode() if text else None, data, warning))
            yield pd.DataFrame(rows, columns=BLOB.fieldNames())

    return sized.mapInPandas(run, BLOB).filter(F.col("media_type").isNull() | media_filter(F.col("media_type"), tuple(wanted)))


def detect_files(files: DataFrame) -> DataFrame:
    """path, media_type, is_text, warning of rows (path, name, content), whatever listed them."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, name, content in zip(batch["path"], batch["name"], batch["content"], strict=True):
                kind, warning = detect(name, bytes(content))
                rows.append((path, kind, is_text(kind, bytes(content)), warning))
            yield pd.DataFrame(rows, columns=["path", "media_type", "is_text", "warning"])

    return files.select("path", "name", "content").mapInPandas(run, "path string, media_type string, is_text boolean, warning string")


# -- codecs ---------------------------------------------------------------------------------------


def _zstd_pack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _zstd_unpack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def _gzip_pack(data: bytes) -> bytes:
    import gzip

    return gzip.compress(data, mtime=0)


def _gzip_unpack(data: bytes) -> bytes:
    import gzip

    return gzip.decompress(data)


#: Codecs by name: (pack, unpack); ``register_codec`` adds to them.
CODECS: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "none": (bytes, bytes), "zstd": (_zstd_pack, _zstd_unpack), "gzip": (_gzip_pack, _gzip_unpack),
}


def register_codec(name: str, pack: Callable[[bytes], bytes], unpack: Callable[[bytes], bytes]) -> None:
    CODECS[name] = (pack, unpack)


def encode(blobs: DataFrame, codec: str = "zstd") -> DataFrame:
    """``blobs`` with body_codec, stored_size and packed content; texts are stored as they are."""
    if codec not in CODECS:
        raise GridError("CODEC_MISSING", f"body codec {codec} is not installed")
    pack = CODECS[codec][0]

    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda c: pack(bytes(c)), na_action="ignore")

    run.__annotations__ = {"content": pd.Series, "return": pd.Series}
    packed = F.pandas_udf(run, T.BinaryType())
    stored = blobs.withColumn("content", F.when(F.col("is_text"), F.col("content")).otherwise(packed("content")))
    return stored.withColumn("body_codec", F.when(~F.col("is_text"), F.lit(codec))).withColumn("stored_size", F.octet_length("content").cast("long"))


def decode(stored: DataFrame) -> DataFrame:
    """The contents again; unknown codecs and broken contents give null and a warning, the row stays."""
    codecs = dict(CODECS)

    def run(content: pd.Series, codec: pd.Series) -> pd.Series:
        def one(c, name):
            try:
                return None if c is None else codecs[name or "none"][1](bytes(c))
            except Exception:
                return None

        return pd.Series([one(c, n) for c, n in zip(content, codec, strict=True)])

    run.__annotations__ = {"content": pd.Series, "codec": pd.Series, "return": pd.Series}
    opened = stored.withColumn("_open", F.pandas_udf(run, T.BinaryType())("content", "body_codec"))
    broken = F.col("content").isNotNull() & F.col("_open").isNull()
    return opened.withColumn("warning", F.when(broken, F.lit("BODY_DECODE_FAILED"))).withColumn("content", F.col("_open")).drop("_open")
