"""Approximate nearest neighbours: one forest of random-projection trees over the whole table.

1. Equal vectors are one point; of its ids the k + 1 smallest are kept, as no result needs more. So a vector that a third of
   all rows have is one point, and no leaf is large because of it.
2. The forest is fitted on a bounded sample of points, chosen by a hash: each node splits its points at the median of their
   projections on the line through two of them. It is the only thing that goes to all tasks; its size is bounded by
   ``TREES`` x 2^``DEPTH`` nodes. Every point is then routed to its leaf in each tree.
3. A query walks all trees at once through one priority queue, ordered by the summed squared margins of the splits that a
   path lies on the far side of, until the leaves it was given hold ``WANTED`` x n^``GROWTH`` points (n: all points; a point
   counts once a tree). The share of points that a query looks at thus falls as the table grows.
4. Queries and points meet by leaf: a shuffle on the leaf's number, with large leaves and leaves of many queries cut into
   cells. Each cell ranks its points by exact distance; the best of all cells are the result.

The forest, the leaves and so the result depend on the vectors alone, not on how the table is partitioned.

Defined cases: rows without an id or with a null vector, an empty one, an all-zero one, null or non-finite components
take no part; vectors are compared with those of their own length only, by a forest of their own; a vec_id that repeats
counts once, with its smallest distance, and is never its own candidate; tables of up to ``LEAF`` points are one leaf;
with fewer candidates than k all are returned; distances that leave double precision are infinite and tie by id; an
empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from veridock.llm.common import arrow_map, discard, table, written
from veridock.llm.vectors import usable

K = 10
#: Trees, points of a leaf that depth aims at, deepest level, and points that the forest is fitted on.
TREES, LEAF, DEPTH, SAMPLE = 8, 256, 11, 16_384
#: Points that the leaves given to a query hold: WANTED * n ** GROWTH. On points spread evenly over a sphere of 64 dimensions,
#: the hardest case, recall is 0.97 at 2,000, 10,000 and 51,000 points.
WANTED, GROWTH = 7.5, 0.8
#: Points and queries of a cell: a matrix of at most 32 MB.
CELL_POINTS, CELL_QUERIES = 4096, 1024
#: Leaves that a query is to look into, about, however large the table is: with the points it looks at, leaves grow.
LOOKED_INTO = 64

_ROUTED = "dim int, ids array<long>, v binary, leaves array<int>"
_WALKED = "dim int, query_id long, v binary, leaves array<int>"
_FOUND = "query_id long, vec_id long, score double"


class Forest:
    """Trees over points of one length. Leaves are numbered through all trees."""

    def __init__(self, points: np.ndarray, n: int, seed: int = 7):
        """``points``: the sample; ``n``: how many there are in all."""
        dim = points.shape[1]
        rng = np.random.default_rng(seed)
        leaf = max(LEAF, WANTED * n**GROWTH / LOOKED_INTO)
        self.n, self.depth = n, min(DEPTH, max(0, math.ceil(math.log2(max(1, n) / leaf))))
        self.inner = (1 << self.depth) - 1
        self.normals, self.offsets = np.zeros((TREES, self.inner, dim)), np.zeros((TREES, self.inner))
        for t in range(TREES):
            level = [np.arange(len(points))]
            for d in range(self.depth):
                below = []
                for k, own in enumerate(level):
                    a, b = rng.choice(own, 2, replace=False) if len(own) > 1 else rng.choice(len(points), 2)
                    normal = points[a] - points[b]
                    normal /= np.linalg.norm(normal) or 1.0
                    along = points[own] @ normal
                    node = (1 << d) - 1 + k
                    self.normals[t, node], self.offsets[t, node] = normal, np.median(along) if len(own) else 0.0
                    far = along > self.offsets[t, node]
                    below += [own[~far], own[far]]
                level = below

    def route(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point in each tree: points x trees."""
        out = np.zeros((len(points), TREES), np.int32)
        for t in range(TREES):
            node = np.zeros(len(points), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", points, self.normals[t][node]) > self.offsets[t][node])
            out[:, t] = t * (1 << self.depth) + node - self.inner
        return out

    def walk(self, query: np.ndarray, size: np.ndarray) -> list[int]:
        """The leaves that the queue gives out first; ``size``: how many points each leaf has."""
        margins = (self.normals @ query - self.offsets).tolist()
        queue: list[tuple[float, int, int]] = [(0.0, t, 0) for t in range(TREES)]
        given, points, wanted = [], 0, WANTED * self.n**GROWTH
        while queue and points < wanted:
            away, t, node = heapq.heappop(queue)
            if node >= self.inner:
                leaf = t * (1 << self.depth) + node - self.inner
                if size[leaf]:
                    given.append(leaf)
                    points += int(size[leaf])
                continue
            margin = margins[t][node]
            near, far = (2 * node + 2, 2 * node + 1) if margin > 0 else (2 * node + 1, 2 * node + 2)
            heapq.heappush(queue, (away, t, near))
            heapq.heappush(queue, (away + margin * margin, t, far))
        return given


def _by_length(vectors: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) for each length of a list column."""
    size, flat = np.diff(vectors.offsets.to_numpy()), vectors.flatten().to_numpy()
    first = np.concatenate([[0], np.cumsum(size)])
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield int(dim), rows, flat[(first[rows][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)


class _Route:
    """Points to their leaves."""

    def __init__(self, forests: dict[int, Forest], kind: str):
        self.forests, self.kind = forests, kind

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, points in _by_length(batch.column("v")):
                leaves = self.forests[dim].route(points)
                ids = batch.column("ids").take(pa.array(rows))
                columns = [pa.array(np.full(len(rows), dim, np.int32)), ids, pa.array([p.tobytes() for p in points.astype(self.kind)], pa.binary()), pa.array(leaves.tolist(), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["dim", "ids", "v", "leaves"])


class _Walk:
    """Queries to the leaves that they look into."""

    def __init__(self, forests: dict[int, Forest], sizes: dict[int, np.ndarray], kind: str):
        self.forests, self.sizes, self.kind = forests, sizes, kind

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, queries in _by_length(batch.column("v")):
                leaves = [self.forests[dim].walk(q, self.sizes[dim]) for q in queries]
                columns = [pa.array(np.full(len(rows), dim, np.int32)), batch.column("vec_id").take(pa.array(rows)), pa.array([q.tobytes() for q in queries.astype(self.kind)], pa.binary()), pa.array(leaves, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["dim", "query_id", "v", "leaves"])


class Cell:
    """Queries and points of a cell to the k nearest ids of each query."""

    def __init__(self, k: int = K, kind: str = "<f8"):
        self.k, self.kind = k, kind

    def __call__(self, queries: pa.Table, points: pa.Table) -> pa.Table:
        asked, ids = queries.column("query_id").to_pylist(), points.column("ids").to_pylist()
        found: list[tuple[int, int, float]] = []
        if asked and ids:
            q, p = (np.frombuffer(b"".join(t.column("v").to_pylist()), self.kind).reshape(len(t), -1).astype(np.float64) for t in (queries, points))
            found = [(a, i, s) for a, near in zip(asked, self.nearest(asked, q, ids, p), strict=True) for s, i in near]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score"), columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    def nearest(self, asked: list[int], q: np.ndarray, ids: list[list[int]], p: np.ndarray) -> Iterator[list[tuple[float, int]]]:
        first = np.array([i[0] for i in ids])
        most = self.k + 1
        with np.errstate(over="ignore", invalid="ignore"):
            square = (p * p).sum(axis=1)
            for a, x in zip(asked, q, strict=True):
                rough = square - 2 * (p @ x) + x @ x
                close = np.arange(len(p))
                if len(p) > most and np.isfinite(rough).all():  # rounding cannot hide one of the k + 1 nearest
                    slack = 1e-12 * p.shape[1] * (float(square.max()) + float(x @ x))
                    close = np.flatnonzero(rough <= np.partition(rough, most - 1)[most - 1] + slack)
                distance = np.sqrt(((p[close] - x) ** 2).sum(axis=1))
                order = np.lexsort((first[close], distance))[:most]
                every = sorted((float(distance[o]), i) for o in order for i in ids[close[o]] if i != a)
                yield every[: self.k]


def _fitted(points: DataFrame) -> dict[int, Forest]:
    """A forest for each length of vector, on a sample chosen by a hash: at most SAMPLE points of each length come to the
    driver. Lengths are meant to be few."""
    counts = {r["dim"]: r["n"] for r in points.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    forests = {}
    for dim, n in counts.items():
        # a threshold on the hash leaves little more than the sample to rank, whatever the table's size
        low = F.pmod(F.xxhash64(F.lit(3), "v"), F.lit(1 << 40))
        few = points.select("v", low.alias("low")).where((F.size("v") == dim) & (F.col("low") < math.ceil((1 << 40) * min(1.0, 1.25 * SAMPLE / n))))
        sample = few.orderBy("low", "v").limit(SAMPLE).select("v").toArrow()
        for _, _, matrix in _by_length(sample.column("v").combine_chunks()):
            order = np.lexsort(matrix.T[::-1])  # rows arrive in any order
            forests[dim] = Forest(matrix[order], n)
    return forests


def nearest(embeddings: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance): the k nearest rows found for each query but itself.
    ``is_query`` is a condition on ``vec_id``."""
    rows = usable(embeddings, id_col, vector_col, zero_too=False)
    held = embeddings.schema[vector_col].dataType
    kind = "<f4" if isinstance(held, T.ArrayType) and isinstance(held.elementType, T.FloatType) else "<f8"  # vectors travel as they are held
    place = F.dense_rank().over(W.partitionBy("v").orderBy("vec_id"))
    points = written(rows.withColumn("n", place).where(F.col("n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")), "points")
    forests = _fitted(points)
    routed = written(arrow_map(points.select("ids", "v"), _Route(forests, kind), _ROUTED), "routed")
    sizes = {d: np.zeros(TREES << f.depth, np.int64) for d, f in forests.items()}
    for r in routed.select("dim", F.explode("leaves").alias("leaf")).groupBy("dim", "leaf").agg(F.count("*").alias("n")).collect():
        sizes[r["dim"]][r["leaf"]] = r["n"]
    walked = written(arrow_map(rows.where(is_query), _Walk(forests, sizes, kind), _WALKED), "walked")
    discard(points)

    # cells: a leaf's points in so many parts, its queries in so many
    each = lambda t: t.select("dim", F.explode("leaves").alias("leaf")).groupBy("dim", "leaf").agg(F.count("*").alias("n"))
    parts = each(walked).select("dim", "leaf", F.ceil(F.col("n") / CELL_QUERIES).cast("int").alias("qs"))
    parts = parts.join(each(routed).select("dim", "leaf", F.ceil(F.col("n") / CELL_POINTS).cast("int").alias("ps")), ["dim", "leaf"])
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = ["dim", "leaf", "p", "q"]
    x = routed.select("dim", "ids", "v", F.explode("leaves").alias("leaf")).join(parts, ["dim", "leaf"])
    x = x.select("dim", "leaf", F.pmod(F.xxhash64("v"), "ps").cast("int").alias("p"), upto("qs").alias("q"), "ids", "v")
    y = walked.select("dim", "query_id", "v", F.explode("leaves").alias("leaf")).join(parts, ["dim", "leaf"])
    y = y.select("dim", "leaf", F.pmod(F.xxhash64("query_id"), "qs").cast("int").alias("q"), upto("ps").alias("p"), "query_id", "v")
    work = Cell(k, kind)

    def run(queries: pa.Table, points: pa.Table) -> pa.Table:
        return work(queries, points)

    found = y.groupBy(*cell).cogroup(x.groupBy(*cell)).applyInArrow(run, _FOUND)
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op10_nearest_neighbours": op10_nearest_neighbours}
SQL: dict[str, str] = {}
