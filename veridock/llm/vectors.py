"""Usable rows of a vector table, blocks of them, and pairs of query blocks with these.

A search compares a stated set of queries with all rows. Rows and queries are packed into blocks of bounded size, both
are stored in the shared folder, and each pair of blocks is one row of work: no pair of vectors is ever a row, no side is
collected, and Spark broadcasts the query blocks only if their stored size is below its own threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veridock.llm.common import arrow_batches, written

#: Rows of a block, queries of a block, and bytes of either: longer vectors come in smaller blocks.
ROWS, QUERIES, BYTES = 8192, 2048, 8 << 20
#: Parquet looks at a row group's size after 100 rows only, which may be 800 MB of blocks; so it looks after each.
FINE = {"parquet.block.size": 32 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}

BLOCK = "dim int, n int, ids binary, vectors binary"


def usable(embeddings: DataFrame, id_col: str, vector_col: str, zero_too: bool) -> DataFrame:
    """(vec_id, v): rows with an id and a non-empty vector without null or non-finite components, all-zero vectors only if
    ``zero_too``."""
    v = F.col("v")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if not zero_too:
        fine = fine & F.exists(v, lambda x: x != 0)
    return embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


class Pack:
    """(vec_id, v) rows to blocks of one dimension each, ids and row-major vectors of the given type as bytes."""

    def __init__(self, rows: int, kind: str, prepare: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None):
        self.rows, self.kind, self.prepare = rows, kind, prepare

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            ids, lists = batch.column("vec_id").to_numpy(), batch.column("v")
            size, flat, at = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), 0
            first = np.concatenate([[0], np.cumsum(size)])
            for dim in np.unique(size):
                chosen = np.flatnonzero(size == dim)
                vectors = flat[(first[chosen][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)
                part = held.setdefault(int(dim), [])
                part.append((ids[chosen], vectors))
                if sum(len(i) for i, _ in part) >= self.size(int(dim)):
                    yield from self.cut(int(dim), part, self.size(int(dim)))
        for dim, part in held.items():
            if part:  # nothing is left of rows that filled their blocks
                yield from self.cut(dim, part, 1)

    def size(self, dim: int) -> int:
        return max(1, min(self.rows, BYTES // (dim * np.dtype(self.kind).itemsize)))

    def cut(self, dim: int, part: list, least: int) -> Iterator[pa.RecordBatch]:
        rows = self.size(dim)
        ids, vectors = np.concatenate([i for i, _ in part]), np.concatenate([v for _, v in part])
        part.clear()
        while len(ids) >= max(1, least):
            i, v = ids[:rows], vectors[:rows].astype(self.kind)
            ids, vectors = ids[rows:], vectors[rows:]
            if self.prepare:
                i, v = self.prepare(i, v)
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(i)], pa.int32()), pa.array([i.astype("<i8").tobytes()]), pa.array([v.tobytes()])], names=["dim", "n", "ids", "vectors"])
        if len(ids):
            part.append((ids, vectors))


def blocks(rows: DataFrame, size: int, kind: str, name: str, prepare: Callable | None = None) -> DataFrame:
    arrow_batches(rows.sparkSession)
    work = Pack(size, kind, prepare)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(batches)

    return written(rows.mapInArrow(run, BLOCK), name, **FINE)


def query_blocks(rows: DataFrame, is_query: Column, kind: str) -> DataFrame:
    """Blocks of the rows that are queries, dealt out so that each block is about full and few partitions need a second one."""
    asked = rows.where(is_query)
    n = asked.count()
    return blocks(asked.repartition(max(1, -(-n * 8 // (QUERIES * 7))), "vec_id"), QUERIES, kind, "queries")


def searched(rows: DataFrame, queries: DataFrame, search: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], k: int) -> DataFrame:
    """The k highest scores of what ``search`` finds in each pair of blocks: query_id, rank, vec_id, score. Ties go to the
    smaller vec_id; a vec_id that repeats counts once, with its best score."""
    asked = queries.select(F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    # a stated set of queries against all rows, block by block. An equality would be a join on one key, the length, with both sides in
    # one partition; as a difference it stays a condition on pairs of blocks, which Spark deals out by pairs of partitions (or
    # takes from a broadcast, where the query blocks are below its limit)
    pairs = rows.crossJoin(asked).where("dim - q_dim = 0").select("dim", "ids", "vectors", "q_ids", "q_vectors")
    arrow_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return search(batches)

    found = pairs.mapInArrow(run, "query_id long, vec_id long, beyond int, score long")
    best = found.groupBy("query_id", "vec_id").agg(F.max(F.struct("beyond", "score")).alias("s"))
    order = W.partitionBy("query_id").orderBy(F.desc("s"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    score = F.when(F.col("s.beyond") == 0, F.col("s.score")).otherwise(F.raise_error(F.lit("OverflowError: a score leaves 64 bits")).cast("long"))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))


def opened(ids: bytes, vectors: bytes, dim: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(vectors, kind).reshape(-1, dim)


def results(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(query, ids, scores) as rows; a score that leaves 64 bits keeps its side only."""
    query = np.concatenate([np.zeros(0, np.int64), *(np.full(len(i), q) for q, i, _ in rows)])
    ids = np.concatenate([np.zeros(0, np.int64), *(i for _, i, _ in rows)])
    scores = [int(x) for _, _, s in rows for x in s.tolist()]
    beyond = [(x >= 1 << 63) - (x < -(1 << 63)) for x in scores]
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array(beyond, pa.int32()), pa.array([0 if o else x for o, x in zip(beyond, scores, strict=True)], pa.int64())], names=["query_id", "vec_id", "beyond", "score"])
