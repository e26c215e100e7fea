"""SimHash near-duplicates with pivot distance tables.

Fingerprints: XXH64 (seed 42) of each 3-word shingle; a bit is set if over half the hashes set it.
Two fingerprints link if at most ``RADIUS`` bits differ. Documents are first gathered by equal
fingerprint, so copies cost one row each and no pair.

Candidates: 64 bits are cut in 6 blocks, and at most 3 differing bits leave at least 3 blocks equal,
so linked fingerprints share one of the 20 keys of 3 blocks (about 32 bits each). Rows are dealt and
sorted by key; within a key the pivot distance table decides: distances to ``PIVOTS`` reference
fingerprints are computed once for each row, and since a distance is a metric, a pair whose
coordinates differ by more than ``RADIUS`` anywhere is discarded; survivors are verified on all bits.
A batch of sorted rows passes on at most one link for each row (to the smallest fingerprint that it
is connected to there), never all pairs.

A key shared by more than ``CROWD`` fingerprints does not go to one task. What its fingerprints do not
share, about 32 bits, is cut in 6 blocks once more, and they are dealt by the key and 3 of these blocks,
on the same argument. Such a group shares 46 bits at least, so it has at most ``2 ** 18`` fingerprints,
and goes the same way over the pivot table.

Defined results: texts with one or two words have one shingle, their words; null, empty and blank
texts have fingerprint zero and link like any other; repeated documents keep their rows; documents
without an id take the smallest id of their component (null if it has none); an empty table gives an
empty result; extra columns are ignored by ``classify`` and kept by ``keep_one``, which tells rows
apart by all their columns: ids may be null or repeat.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgrid.llm.components import stars
from corpusgrid.llm.sampling import fresh
from corpusgrid.runtime import cut, release, ship

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Reference fingerprints; fingerprints of one key that a task takes; bytes of text taken at once.
PIVOTS, CROWD, PIECE = 8, 16_384, 1 << 20
#: Row keys that may be broadcast; beyond that documents and keys meet in a shuffle join.
BROADCAST_IDS = 500_000
#: Neighbours compared at once for small keys; rows, and pairs, compared at once for larger ones.
NEAR, ROWS, CELLS = 16, 128, 1 << 22

def _masks(bits: int = (1 << 64) - 1) -> list[int]:
    """Three of six blocks of the bits set in ``bits``, each way."""
    places = [i for i in range(64) if bits >> i & 1]
    size, over = divmod(len(places), 6)
    blocks, at = [], 0
    for n in range(6):
        end = at + size + (n < over)
        blocks.append(sum(1 << i for i in places[at:end]))
        at = end
    return [a | b | c for a, b, c in combinations(blocks, 3)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _pivots() -> np.ndarray:
    """Reference fingerprints: multiples of an odd constant, mixed."""
    x = np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def _pieces(raw: bytes):
    """Words in runs, each run with the last two words of the one before."""
    at, carried = 0, []
    while at < len(raw) or not at:
        end = len(raw)
        if end - at > PIECE:
            end = at + PIECE
            while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
                end += 1
        found = carried + raw[at:end].split()
        yield found
        carried, at = found[1 - SHINGLE :], max(end, at + 1)


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned number."""
    from xxhash import xxh64_digest

    ones, total, few = np.zeros(64, np.int64), 0, []
    for words in _pieces((text or "").encode().lower()):
        if len(words) < SHINGLE:
            few = words
            continue
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: 1 - SHINGLE].tolist()
        hashes = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)])
        bits = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
        for i in range(0, len(bits), 1 << 14):
            ones += np.unpackbits(bits[i : i + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
        total += len(bits)
    if not total:
        return int.from_bytes(xxh64_digest(b" ".join(few), SEED), "big") if few else 0
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, *names: Column) -> DataFrame:
    """``names`` (doc_id if none are given) and fp, the fingerprint of the whole text as a signed number."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            found = [fingerprint(v.as_py()) for v in batch.column(batch.num_columns - 1)]
            own = [*batch.columns[:-1], pa.array(np.array(found, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(own, names=[*batch.schema.names[:-1], "fp"])
        release()

    read = docs.select(*(names or ["doc_id"]), docs["text"].cast("string").alias("text"))
    return read.mapInArrow(run, T.StructType([*read.schema.fields[:-1], T.StructField("fp", T.LongType())]))


def _settle(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest connected row of each row."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _near(fps: np.ndarray, table: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that the pivot table leaves and the bits confirm."""
    for p in range(table.shape[1]):
        keep = np.abs(table[left, p] - table[right, p]) <= RADIUS
        left, right = left[keep], right[keep]
    keep = np.bitwise_count(fps[left] ^ fps[right]) <= RADIUS
    return left[keep], right[keep]


def _links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key: (row, smallest connected row) for rows of one key, for rows that have one."""
    count = len(fps)
    table = np.bitwise_count(fps[:, None] ^ _pivots()[None]).astype(np.int16)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if count else np.empty(0, np.int64)
    sizes = np.diff(np.append(first, count))
    found = []
    small = np.repeat(sizes <= NEAR, sizes)
    for step in range(1, min(NEAR, count)):
        left = np.flatnonzero((keys[step:] == keys[:-step]) & small[step:])
        if not len(left):
            break
        found.append(_near(fps, table, left, left + step))
    for start, size in zip(first[sizes > NEAR].tolist(), sizes[sizes > NEAR].tolist(), strict=True):
        order = start + np.argsort(table[start : start + size, 0], kind="stable")
        coordinate = table[order, 0]
        label = np.arange(size)
        step = max(8, min(ROWS, CELLS // size))
        for at in range(0, size, step):
            rows = order[at : at + step]
            end = int(np.searchsorted(coordinate, coordinate[min(at + step, size) - 1] + RADIUS, side="right"))
            others = order[at:end]
            apart = np.abs(table[rows, 1][:, None] - table[others, 1][None]) <= RADIUS
            for p in range(2, PIVOTS):
                apart &= np.abs(table[rows, p][:, None] - table[others, p][None]) <= RADIUS
            i, j = np.nonzero(apart)
            keep = (j > i) & (np.bitwise_count(fps[rows[i]] ^ fps[others[j]]) <= RADIUS)
            i, j = i[keep] + at, j[keep] + at
            if len(i):
                # links so far are carried as (row, label), so a block adds to a forest
                rest = np.flatnonzero(label != np.arange(size))
                label = _settle(size, np.concatenate([i, rest]), np.concatenate([j, label[rest]]))
        rest = np.flatnonzero(label != np.arange(size))
        found.append((order[rest], order[label[rest]]))
    left = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
    right = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int64)
    label = _settle(count, left, right)
    rest = np.flatnonzero(label != np.arange(count))
    return rest, label[rest]


def _swept(rows: DataFrame) -> DataFrame:
    """Links (a, b) within each key of ``rows`` (part, key, fp), dealt and sorted by key here."""

    def run(batches):
        part, key, fps = (np.empty(0, t) for t in (np.int64, np.int64, np.uint64))
        for batch in batches:
            part = np.concatenate([part, batch.column(0).to_numpy(zero_copy_only=False)])
            key = np.concatenate([key, batch.column(1).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)])
            last = np.flatnonzero((part != part[-1]) | (key != key[-1]))
            whole = int(last[-1]) + 1 if len(last) else 0
            if whole:
                yield out(part[:whole], key[:whole], fps[:whole])
                part, key, fps = part[whole:], key[whole:], fps[whole:]
        if len(fps):
            yield out(part, key, fps)

    def out(part, key, fps):
        group = np.cumsum(np.concatenate([[0], (part[1:] != part[:-1]) | (key[1:] != key[:-1])]))
        left, right = _links(group, fps)
        return pa.RecordBatch.from_arrays([pa.array(fps[left].view(np.int64)), pa.array(fps[right].view(np.int64))], names=["a", "b"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "part", "key").sortWithinPartitions("part", "key", "fp")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect just the fingerprints within RADIUS of each other; ``nodes``: distinct fp."""
    masks = _masks()

    def dealt(part: int, mask: int) -> Column:
        return F.struct(F.lit(part).cast("bigint").alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"))

    keys = F.array(*[dealt(i, m) for i, m in enumerate(masks)])
    rows = nodes.select(F.explode(keys).alias("k"), "fp").select("k.part", "k.key", "fp")
    crowds = cut(rows.groupBy("part", "key").count().filter(F.col("count") > CROWD).select("part", "key"))
    if crowds.isEmpty():
        return _swept(rows)
    crowded = rows.join(crowds, ["part", "key"], "left_semi").select("part", "fp")
    again = F.lit(None)
    for i, m in enumerate(masks):
        inner = [dealt((i + 1) * len(masks) + n, m | x) for n, x in enumerate(_masks(m ^ ((1 << 64) - 1)))]
        again = F.when(F.col("part") == i, F.array(*inner)).otherwise(again)
    finer = crowded.select(F.explode(again).alias("k"), "fp").select("k.part", "k.key", "fp")
    return _swept(rows.join(crowds, ["part", "key"], "left_anti").unionByName(finer))


def components(prints: DataFrame, name: str = "doc_id") -> DataFrame:
    """fp and component_id (the smallest ``name``) of each distinct fingerprint of ``prints``."""
    nodes = cut(prints.groupBy("fp").agg(F.min(name).alias("least")))
    found = stars(links(nodes.select("fp")))
    member = nodes.join(found.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left")
    rooted = member.withColumn("root", F.coalesce("root", "fp"))
    heads = found.select(F.col("v").alias("root")).distinct()
    least = rooted.join(heads, "root", "left_semi").groupBy("root").agg(F.min("least").alias("component"))
    return rooted.join(least, "root", "left").select("fp", F.coalesce("component", "least").alias("component_id"))


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of ``docs``."""
    prints = cut(fingerprints(docs))
    return prints.join(components(prints), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_name(docs: DataFrame) -> Column:
    """What tells a row from others: its id (nulls last) and 128 bits of hash over all its columns."""
    parts = []
    for field in docs.schema.fields:
        value = F.col(f"`{field.name}`")
        plain = isinstance(field.dataType, T.AtomicType)
        parts += [value.isNull(), value if plain else F.to_json(F.struct(value))]
    return F.struct(
        F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"),
        F.xxhash64(F.lit(1), *parts).alias("one"), F.xxhash64(F.lit(2), *parts).alias("two"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``: the one with the smallest id, rows without an id last,
    ties by a hash over all columns. Rows equal in every column are one row."""
    (name,) = fresh(docs, "row")
    hashes = [F.col(f"name.{c}").alias(c) for c in ("one", "two")]
    prints = cut(fingerprints(docs, row_name(docs).alias("name")))
    classes = cut(prints.join(components(prints, "name"), "fp").select("name", F.col("component_id").alias("first")))
    gone = cut(classes.filter("name <> first").select(*hashes).distinct())
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    named = docs.withColumn(name, row_name(docs))
    kept = named.join(F.broadcast(gone) if few else gone, [named[name][c] == gone[c] for c in ("one", "two")], "left_anti")
    again = cut(classes.filter("name = first").groupBy("name").count().filter("count > 1").select(*hashes))
    if again.isEmpty():
        return kept.select(*docs.columns)
    both = [kept[name][c] == again[c] for c in ("one", "two")]
    repeated = kept.join(again, both, "left_semi").dropDuplicates([name])
    return kept.join(again, both, "left_anti").unionByName(repeated).select(*docs.columns)
