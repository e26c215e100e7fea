"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of ``TABLES`` tables hashes a vector to ``floor((a . v + b) / w)`` for several Gaussian
directions ``a``; the cells of one table's directions make its bucket. A query visits buckets in
falling order of estimated success, the probability that a neighbour at the typical distance falls in
the bucket's cells (a product of normal integrals), until that falls under a threshold. The tables'
candidates are merged and ranked by exact Euclidean distance in double precision.

Fit: the cell width comes from a sample of about ``SAMPLE`` vectors. ``PROBES`` of them are searched
exactly against all rows, in one pass; the typical distance is their neighbours' median, and the
threshold is the largest that finds ``AIM`` of these neighbours. Every row is indexed. A query that finds
fewer than ``k`` rows above the threshold is asked again without one.

Dealing: the cells of a table's first ``LEADING`` directions, clipped to -3..3, make a coarse bucket,
so the driver knows at most ``7 ** LEADING`` row counts a table, whatever the data. Coarse buckets are
packed into shards of about equal rows; a hot one is split over several by the hash of its rows' ids. A
shard gets the queries whose success may reach the threshold in one of its coarse buckets, holds at
most about ``LARGEST`` rows, and takes its queries as a stream, so a hot bucket that all queries ask
for needs no more memory. Inside a shard the other directions' cells narrow the buckets down step by
step. Equal vectors beyond the ``k + 1`` smallest ids cannot be among anyone's nearest and go.

Vectors without structure have far neighbours, and the visited share is then large on small tables;
it falls as rows grow, as neighbours come nearer while cells do not widen.

Defined results: vectors that are null, all zero, or hold null or non-finite components take no part,
neither do rows with a null id; vectors of different lengths have no distance, so each length is
searched by itself; a query id that repeats asks with its smallest vector; rows that repeat an id
count once for each query, with the nearest; ties go to the smaller id; fewer candidates than asked
for are all returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from corpusgrid.runtime import cut, ship

TABLES, SAMPLE, PROBES, AIM, SEED = 2, 2000, 100, 0.96, 17
#: Directions of a table at most, those that make coarse buckets, cell width in standard deviations of
#: the projections, outermost cells of coarse buckets and of buckets.
DIRECTIONS, LEADING, CELL, COARSE, EDGE = 24, 5, 1.6, 3, 15
#: Rows of a shard at least and at most; queries taken at once; directions that narrow at once.
SHARD, LARGEST, BLOCK, STEP = 8192, 65_536, 64, 7


@dataclass
class Index:
    directions: np.ndarray  # table, direction, dimension
    offsets: np.ndarray
    width: float
    distance: float = 1.0
    least: float = -math.inf  # log of the success under which buckets are not visited

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Projections in cells: row, table, direction."""
        tables, count, dim = self.directions.shape
        return (x @ self.directions.reshape(-1, dim).T).reshape(-1, tables, count) / self.width + self.offsets

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Cells from 0 to 2 * EDGE: row, table, direction."""
        return np.clip(np.floor(self.projected(x)), -EDGE, EDGE).astype(np.int64) + EDGE

    def coarse(self, cells: np.ndarray) -> np.ndarray:
        """Numbers of the coarse buckets of cells."""
        leading = np.clip(cells[..., :LEADING] - EDGE, -COARSE, COARSE) + COARSE
        return leading @ (2 * COARSE + 1) ** np.arange(leading.shape[-1])

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Logs of the chance that a neighbour is in a cell: row, table, direction, cell."""
        edges = (np.arange(-EDGE, EDGE + 2) - self.projected(x)[..., None]) * (self.width / self.distance)
        below = 0.5 * (1 + _erf(edges / math.sqrt(2)))
        below[..., 0], below[..., -1] = 0, 1  # the outer cells are open
        return np.log(np.maximum(np.diff(below, axis=-1), 1e-12))

    def bounds(self, chances: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """For a row's chances in one table: the most that a bucket inside each coarse bucket can have."""
        size = 2 * COARSE + 1
        held = min(LEADING, len(chances))
        total = np.full(len(numbers), chances[held:].max(axis=1).sum())
        for i in range(held):
            inner = chances[i, EDGE - COARSE : EDGE + COARSE + 1].copy()
            inner[0], inner[-1] = chances[i, : EDGE - COARSE + 1].max(), chances[i, EDGE + COARSE :].max()
            total += inner[numbers // size**i % size]
        return total


class Shard:
    """Rows of one table's coarse buckets."""

    def __init__(self, index: Index, table: int, ids: np.ndarray, x: np.ndarray, k: int):
        self.index, self.table, self.k = index, table, k
        numbers = index.coarse(index.cells(x)[:, table])
        same = np.unique(x.view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_inverse=True)[1].ravel()
        order = np.lexsort((ids, same))
        own, group = ids[order], same[order]
        first = np.ones(len(own), bool)
        first[1:] = (own[1:] != own[:-1]) | (group[1:] != group[:-1])  # repeated rows count once
        order, group = order[first], group[first]
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        order = order[np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group)))) <= k]
        order = order[np.argsort(numbers[order], kind="stable")]
        self.ids, self.x, numbers = ids[order], x[order], numbers[order]
        self.cells = np.ascontiguousarray(index.cells(self.x)[:, table].T)
        self.repeats = len(np.unique(self.ids)) < len(self.ids)
        self.numbers, self.starts = np.unique(numbers, return_index=True)
        self.ends = np.append(self.starts[1:], len(numbers))

    def visited(self, chances: np.ndarray) -> np.ndarray:
        """Places of the rows in buckets whose estimated success reaches the threshold."""
        least = self.index.least
        asked = np.flatnonzero(self.index.bounds(chances, self.numbers) >= least)
        if not len(asked):
            return asked
        rows = np.concatenate([np.arange(self.starts[g], self.ends[g]) for g in asked.tolist()])
        rest = np.append(np.cumsum(chances.max(axis=1)[::-1])[::-1], 0.0)
        total = np.zeros(len(rows))
        for at in range(0, len(chances), STEP):
            for i in range(at, min(at + STEP, len(chances))):
                total += chances[i][self.cells[i, rows]]
            keep = total + rest[min(at + STEP, len(chances))] >= least
            rows, total = rows[keep], total[keep]
        return rows

    def nearest(self, query: int, vector: np.ndarray, chances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest visited ids and their distances, at most k."""
        rows = self.visited(chances)
        rows = rows[self.ids[rows] != query]
        apart = self.x[rows] - vector
        square = np.einsum("nd,nd->n", apart, apart)
        if len(rows) > self.k and not self.repeats:
            keep = square <= np.partition(square, self.k - 1)[self.k - 1]
            rows, square = rows[keep], square[keep]
        best = np.lexsort((self.ids[rows], square))
        found, square = self.ids[rows[best]], square[best]
        if self.repeats and len(found):
            first = np.sort(np.unique(found, return_index=True)[1])
            found, square = found[first], square[first]
        return found[: self.k], np.sqrt(square[: self.k])


def _erf(x: np.ndarray) -> np.ndarray:
    """The error function (Abramowitz and Stegun 7.1.26, absolute error under 2e-7)."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - series * np.exp(-x * x))


def build(sample: np.ndarray) -> Index:
    """Directions and cells for vectors like those of ``sample``."""
    rng = np.random.default_rng(SEED)
    dim = sample.shape[1]
    count = max(1, min(DIRECTIONS, dim))
    turned = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-TABLES * count // dim))]
    directions = np.concatenate(turned)[: TABLES * count].reshape(TABLES, count, dim) * math.sqrt(dim)
    centre = sample.mean(axis=0)
    spread = float(((sample - centre) @ directions.reshape(-1, dim).T).std()) or 1.0
    index = Index(directions, np.zeros((TABLES, count)), CELL * spread)
    index.offsets = rng.random((TABLES, count)) - index.projected(centre[None])[0]
    return index


def calibrate(index: Index, queries: np.ndarray, neighbours: list[np.ndarray], aim: float = AIM) -> Index:
    """Sets the typical distance and the threshold by the queries' true neighbours."""
    pairs = [(i, v) for i, found in enumerate(neighbours) for v in found]
    if not pairs:
        return index
    asked, held = np.array([i for i, _ in pairs]), np.array([v for _, v in pairs])
    index.distance = max(float(np.median(np.linalg.norm(queries[asked] - held, axis=1))), 1e-6 * index.width)
    chances, cells = index.chances(queries), index.cells(held)
    tables, directions = np.ogrid[: cells.shape[1], : cells.shape[2]]
    found = np.array([chances[i][tables, directions, c].sum(axis=1).max() for i, c in zip(asked.tolist(), cells, strict=True)])
    index.least = float(np.sort(found)[int((1 - aim) * len(found))]) - 1e-9
    return index


def _valid(embeddings: DataFrame, key: str, column: str) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    vectors = embeddings.select(F.col(key).cast("bigint").alias("vec_id"), F.col(column).cast("array<double>").alias("vector")).dropna()
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    return vectors.filter(F.coalesce(finite, F.lit(False)) & F.coalesce(some, F.lit(False)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(-1, dim)


def _exact(valid: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """The true neighbours of a few queries: each task keeps its nearest, and these are merged."""
    sent = valid.sparkSession.sparkContext.broadcast((ids, queries))
    dim = queries.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asked = sent.value
        square, held = np.empty((len(own), 0)), np.empty((len(own), 0, dim))
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            apart = np.maximum((asked**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * asked @ x.T, 0)
            apart[own[:, None] == batch.column(0).to_numpy(zero_copy_only=False)[None]] = np.inf
            near = np.argsort(apart, axis=1, kind="stable")[:, :k]
            square, held = np.hstack([square, np.take_along_axis(apart, near, 1)]), np.concatenate([held, x[near]], axis=1)
            near = np.argsort(square, axis=1, kind="stable")[:, :k]
            square, held = np.take_along_axis(square, near, 1), np.take_along_axis(held, near[..., None], 1)
        query, place = np.nonzero(np.isfinite(square))
        vectors = pa.array(list(held[query, place]), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(square[query, place]), vectors], names=["query", "square", "vector"])

    found = valid.mapInArrow(scan, "query bigint, square double, vector array<double>")
    best = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("square", "vector"))).filter(F.col("rank") <= k)
    out: list[list] = [[] for _ in ids]
    for r in best.collect():
        out[r["query"]].append(r["vector"])
    return [np.array(v, np.float64).reshape(-1, dim) for v in out]


def _plan(counts: list, rows: int) -> tuple[dict[tuple[int, int], tuple[int, int]], list[int]]:
    """The first shard and the number of shards of each (table, coarse bucket); each shard's table."""
    target = int(min(LARGEST, max(SHARD, rows * TABLES / 64)))
    place: dict[tuple[int, int], tuple[int, int]] = {}
    tables: list[int] = []
    filled, table = target, -1
    for tab, bucket, count in sorted(map(tuple, counts)):
        pieces = -(-count // target)
        if pieces > 1 or tab != table or filled + count > target:
            place[tab, bucket] = len(tables), pieces
            tables += [tab] * pieces
            filled = target if pieces > 1 else 0
        else:
            place[tab, bucket] = len(tables) - 1, 1
        filled, table = filled + count, tab
    return place, tables


def search(embeddings: DataFrame, every: int, k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each row whose key is divisible by ``every``."""
    spark = embeddings.sparkSession
    ship(spark)
    valid = _valid(embeddings, key, column)
    kind = embeddings.schema[column].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    sizes = sorted(map(tuple, valid.groupBy(F.size("vector")).count().collect()))
    found = spark.createDataFrame([], "query_id bigint, vec_id bigint, score double")
    for dim, rows in sizes:
        found = found.unionByName(_searched(valid.filter(F.size("vector") == dim), dim, rows, every, k, "<f4" if single else "<f8"))
    merged = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = merged.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def fit(valid: DataFrame, dim: int, rows: int, k: int) -> Index:
    """The index for ``valid`` (vec_id, vector), fitted on a sample drawn by a hash."""
    lot = F.pmod(F.xxhash64(F.lit(SEED), "vec_id", "vector"), F.lit(rows))
    drawn = valid.withColumn("lot", lot).filter(F.col("lot") < SAMPLE).orderBy("lot", "vec_id", "vector").limit(SAMPLE).collect()
    sample = np.array([r["vector"] for r in drawn], np.float64).reshape(-1, dim)
    ids = np.array([r["vec_id"] for r in drawn], np.int64)
    return calibrate(build(sample), sample[:PROBES], _exact(valid, ids[:PROBES], sample[:PROBES], k))


def _searched(valid: DataFrame, dim: int, rows: int, every: int, k: int, kind: str) -> DataFrame:
    """Each query's nearest in the shards that it asks: query_id, vec_id, score."""
    index = fit(valid, dim, rows, k)
    queries = valid.filter(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    found = cut(_asked(valid, queries, index, dim, rows, k, kind))
    enough = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).filter(F.col("n") >= k)
    short = cut(queries.join(enough, queries["vec_id"] == enough["query_id"], "left_anti"))
    if short.isEmpty():
        return found
    return found.unionByName(_asked(valid, short, replace(index, least=-math.inf), dim, rows, k, kind))


def _asked(valid: DataFrame, queries: DataFrame, index: Index, dim: int, rows: int, k: int, kind: str) -> DataFrame:
    """Each shard's nearest for its ``queries``."""
    context = valid.sparkSession.sparkContext
    sent = context.broadcast(index)

    def number(batches):
        for batch in batches:
            found = sent.value.coarse(sent.value.cells(_matrix(batch.column(1), dim)))
            tabs = np.broadcast_to(np.arange(TABLES, dtype=np.int32), found.shape)
            yield pa.RecordBatch.from_arrays([pa.array(tabs.ravel()), pa.array(found.ravel())], names=["tab", "bucket"])

    # at most TABLES * 7 ** LEADING rows
    counts = valid.mapInArrow(number, "tab int, bucket bigint").groupBy("tab", "bucket").count().collect()
    place, tables = _plan(counts, rows)
    plan = context.broadcast((place, tables))

    def packed(shards: list[int], asks: bool, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        vectors = [v.tobytes() for v in x.astype(kind)]
        columns = [pa.array(shards, pa.int32()), pa.array([asks] * len(shards)), pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "asks", "id", "vector"])

    def deal(batches):
        where, _ = plan.value
        for batch in batches:
            ids, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), dim)
            mixed = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).tolist()
            numbers = sent.value.coarse(sent.value.cells(x))
            for t in range(TABLES):
                found = [where[t, b] for b in numbers[:, t].tolist()]
                yield packed([first + m % pieces for (first, pieces), m in zip(found, mixed, strict=True)], False, ids, x)

    def ask(batches):
        where, _ = plan.value
        index = sent.value
        own = [np.array(sorted(b for tab, b in where if tab == t), np.int64) for t in range(TABLES)]
        reached = [[range(where[t, b][0], sum(where[t, b])) for b in own[t].tolist()] for t in range(TABLES)]
        for batch in batches:
            ids, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1), dim)
            for at in range(0, len(ids), BLOCK):
                for i, chances in enumerate(index.chances(x[at : at + BLOCK]), at):
                    asked = set()
                    for t in range(TABLES):
                        for b in np.flatnonzero(index.bounds(chances[t], own[t]) >= index.least).tolist():
                            asked.update(reached[t][b])
                    if asked:
                        yield packed(sorted(asked), True, np.full(len(asked), ids[i]), np.repeat(x[i : i + 1], len(asked), axis=0))

    def near(batches):
        _, tab = plan.value
        now, held, opened = -1, [], None
        for batch in batches:
            shards, asks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            ids = batch.column(2).to_numpy(zero_copy_only=False)
            x = np.frombuffer(b"".join(batch.column(3).to_pylist()), kind).astype(np.float64).reshape(-1, dim)
            edges = np.flatnonzero((np.diff(shards) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)], strict=True):
                if a == b:
                    continue
                if shards[a] != now:
                    now, held, opened = int(shards[a]), [], None
                if not asks[a]:
                    held.append((ids[a:b], x[a:b]))
                    continue
                if opened is None and held:
                    opened = Shard(sent.value, tab[now], np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), k)
                    held = []
                if opened is None:  # a split bucket's piece without rows
                    continue
                for at in range(a, b, BLOCK):
                    end = min(b, at + BLOCK)
                    chances = sent.value.chances(x[at:end])[:, tab[now]]
                    found = [opened.nearest(int(ids[i]), x[i], chances[i - at]) for i in range(at, end)]
                    query = np.repeat(ids[at:end], [len(f) for f, _ in found])
                    made = [pa.array(query), *(pa.array(np.concatenate([f[j] for f in found])) for j in (0, 1))]
                    yield pa.RecordBatch.from_arrays(made, names=["query_id", "vec_id", "score"])

    schema = "shard int, asks boolean, id bigint, vector binary"
    dealt = valid.mapInArrow(deal, schema).unionByName(queries.mapInArrow(ask, schema))
    parts = dealt.repartition(2 * max(1, len(tables)), "shard").sortWithinPartitions("shard", "asks", "id")
    return parts.mapInArrow(near, "query_id bigint, vec_id bigint, score double")
