"""Exact top-k search by inner product with block-at-a-time pruning.

A component is a term and its integer value the term's weight. Rows are kept in ranges; each range has, for every term,
the largest and smallest weight in it and its rows as a forward index. For a query a range is bounded by its summed
term maxima (the larger of query weight times maximum and times minimum, summed over terms). The range of its highest bound
is scored first, then, range by range and for all queries of a block at once, those whose bound does not fall below the
k-th best score so far. Bounds that equal the k-th best are still scored, as ties go to smaller ids. The result is exact.

Scores are exact integers whatever the components' size: a pair of blocks is scored in single precision if none of its sums
can leave 24 bits, in double if none can leave 53, in 64-bit integers if none can leave 63, and in Python's integers otherwise.

How much is pruned depends on the vectors: ranges of vectors that point into one direction are passed over as a whole, while
vectors spread evenly over a sphere of many dimensions have no range whose maxima fall below a k-th best score.

Defined cases: rows without an id or with a null vector, an empty one, null or non-finite components take no part; vectors
are compared with those of their own length only; a vec_id that repeats is one row with its best score and is never its
own candidate; with fewer candidates than k all are returned; a score among the k best that leaves 64 bits, which the
result could not hold, is an OverflowError; an empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridock.llm.common import table
from veridock.llm.vectors import ROWS, blocks, opened, query_blocks, results, searched, usable

K = 5
SCALE = 256
#: Rows of a range within a block, and query blocks whose best a task holds.
RANGE, HELD = 256, 64


def gathered(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are alike next to each other, so that the maxima of a range are tight: by the halves of their span that
    the components that vary most are in."""
    chosen = np.argsort(-np.minimum(np.ptp(vectors / 4, axis=0), 1e300), kind="stable")[:16]
    middle = vectors.max(axis=0) / 2 + vectors.min(axis=0) / 2
    order = np.lexsort([ids, *(vectors[:, c] > middle[c] for c in chosen[::-1])])
    return ids[order], vectors[order]


def merge(held: tuple[np.ndarray, np.ndarray], ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of both, best first, ties by id, each id once; scores are Python's integers."""
    i, s = np.concatenate([held[0], ids]), np.concatenate([held[1], scores])
    order = np.array(sorted(range(len(s)), key=lambda j: (-s[j], i[j])), np.int64)
    i, s = i[order], s[order]
    _, first = np.unique(i, return_index=True)
    if len(first) < len(i):
        first.sort()
        i, s = i[first], s[first]
    return i[:k], s[:k]


class Best:
    """The k best of each query of a block, best first, ties by id, each id once; scores are of one of numpy's types."""

    def __init__(self, held: list, k: int, kind: np.dtype):
        self.held, self.k = held, k
        self.n = np.array([len(s) for _, s in held], np.int64)
        # places that are not taken hold less than any score
        self.ids, self.scores = np.zeros((len(held), k), np.int64), np.full((len(held), k), -np.inf if kind.kind == "f" else np.iinfo(kind).min, kind)
        self.changed = np.zeros(len(held), bool)
        for j in np.flatnonzero(self.n):
            self.ids[j, : self.n[j]], self.scores[j, : self.n[j]] = held[j]

    def passed(self, bounds: np.ndarray) -> np.ndarray:
        """Which queries' bounds are not below their k-th best."""
        return bounds >= self.scores[:, -1]

    def add(self, asked: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, unique: bool) -> None:
        """``scores``: a row for each query of ``asked``, a column for each of ``ids``; ``unique``: no id repeats."""
        hit = np.flatnonzero(scores.max(axis=1) >= self.scores[asked, -1])
        if not len(hit):
            return
        asked, scores, last = asked[hit], scores[hit], self.scores[asked[hit], -1]
        fit = scores >= last[:, None]
        if unique and scores.shape[1] > self.k + 1 and np.count_nonzero(fit) > 4 * self.k * len(asked):
            # of one range, with the query itself, the k + 1 best are enough, and what equals the last of them
            fit &= scores >= np.partition(scores, -self.k - 1, axis=1)[:, -self.k - 1, None]
        row, c = np.divmod(np.flatnonzero(fit), len(ids))
        i, s = ids[c], scores[row, c]
        new = (i != q_ids[asked[row]]) & ((s > last[row]) | (i <= self.ids[asked[row], -1]))
        if not new.any():
            return
        j, i, s = asked[row[new]], i[new], s[new]
        touched = np.unique(j)
        at, place = np.divmod(np.flatnonzero(np.arange(self.k) < self.n[touched][:, None]), self.k)
        at = touched[at]
        j, i, s = np.concatenate([at, j]), np.concatenate([self.ids[at, place], i]), np.concatenate([self.scores[at, place], s])
        order = np.lexsort((i, -s, j))
        j, i, s = j[order], i[order], s[order]
        by_id = np.lexsort((i, j))  # equal ones stay in their order, best first
        first = np.ones(len(j), bool)
        first[by_id[1:]] = (j[by_id[1:]] != j[by_id[:-1]]) | (i[by_id[1:]] != i[by_id[:-1]])
        j, i, s = j[first], i[first], s[first]
        rank = np.arange(len(j)) - np.searchsorted(j, j)
        j, i, s, rank = (x[rank < self.k] for x in (j, i, s, rank))
        self.ids[j, rank], self.scores[j, rank], self.changed[touched] = i, s, True
        self.n[touched] = np.bincount(np.searchsorted(touched, j), minlength=len(touched))

    def store(self) -> None:
        for j in np.flatnonzero(self.changed):
            self.held[j] = (self.ids[j, : self.n[j]].copy(), self.scores[j, : self.n[j]].copy())


class BestOfAnySize:
    """The same for Python's integers."""

    def __init__(self, held: list, k: int, kind: np.dtype):
        self.held, self.k = held, k
        self.floor = np.array([s[k - 1] if len(s) >= k else -math.inf for _, s in held], dtype=object)

    def passed(self, bounds: np.ndarray) -> np.ndarray:
        return (bounds >= self.floor).astype(bool)

    def add(self, asked: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, unique: bool) -> None:
        for j, found in zip(asked, scores, strict=True):
            fit = np.flatnonzero((found >= self.floor[j]).astype(bool) & (ids != q_ids[j]))
            if len(fit):
                self.held[j] = merge(self.held[j], ids[fit], found[fit], self.k)
                if len(self.held[j][1]) >= self.k:
                    self.floor[j] = self.held[j][1][self.k - 1]

    def store(self) -> None:
        """They are in ``held`` already."""


def scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles, which hold it exactly, or Python integers if a product leaves the doubles."""
    with np.errstate(over="ignore"):
        out = np.floor(vectors * scale)
    if np.isfinite(out).all():
        return out
    whole = [int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale) for x in vectors.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(vectors.shape)


#: Types of scores, from the narrowest.
KINDS = (np.float32, np.float64, np.int64, object)


def exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """The type in which all inner products of rows of ``a`` and ``b`` are exact."""
    most = [int(max(abs(x.max()), abs(x.min()))) if x.size else 0 for x in (a, b)]
    largest = most[0] * most[1] * a.shape[1]
    return np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64 if largest < 1 << 63 and max(most) < 1 << 62 else object


def converted(x: np.ndarray, kind: type) -> np.ndarray:
    if kind is object and x.dtype != object:
        return np.array([int(c) for c in x.ravel().tolist()], dtype=object).reshape(x.shape)
    return x.astype(kind)


class Ranges:
    """A block's ranges: bounds and forward index."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: int = RANGE):
        self.ids = [ids[a : a + rows] for a in range(0, len(ids), rows)]
        self.forward = [vectors[a : a + rows] for a in range(0, len(ids), rows)]
        self.most = np.stack([f.max(axis=0) for f in self.forward])
        self.least = np.stack([f.min(axis=0) for f in self.forward])
        self.unique = [len(np.unique(i)) == len(i) for i in self.ids]

    def search(self, q_ids: np.ndarray, q: np.ndarray, held: list, k: int) -> int:
        """Bring the best of each query up to date; returns how many (query, range) were scored."""
        if not len(q):
            return 0
        zero = q.dtype.type(0) if q.dtype != object else 0
        bound = np.maximum(q, zero) @ self.most.T + np.minimum(q, zero) @ self.least.T
        best = (Best if q.dtype != object else BestOfAnySize)(held, k, q.dtype)
        highest, scored = bound.argmax(axis=1), 0
        room = np.empty(len(q) * max(map(len, self.forward)), q.dtype)  # for scores; a new array each time takes longer than they do
        for wanted in (True, False):  # the range of its highest bound first, then the others
            for r in np.argsort(-bound.max(axis=0), kind="stable"):
                asked = np.flatnonzero(((highest == r) == wanted) & best.passed(bound[:, r]))
                if len(asked):
                    scored += len(asked)
                    scores = room[: len(asked) * len(self.ids[r])].reshape(len(asked), -1)
                    best.add(asked, q_ids, self.ids[r], np.matmul(q[asked], self.forward[r].T, out=scores), self.unique[r])
        best.store()
        return scored


class Search:
    """Pairs of blocks to the best of each query. The best of the last ``HELD`` query blocks are held, so that later blocks of a
    task are pruned by what earlier ones gave; those of a block that falls out are given out as they are, and the final
    ranking brings all parts together."""

    def __init__(self, k: int = K, scale: int = SCALE):
        self.k, self.scale = k, scale

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[np.ndarray, list]] = {}
        raw: tuple = (None, None)
        block: tuple = (None, None)
        for batch in batches:
            for dim, ids, vectors, q_ids, q_vectors in zip(*(batch.column(c).to_pylist() for c in ("dim", "ids", "vectors", "q_ids", "q_vectors")), strict=True):
                asked, q = opened(q_ids, q_vectors, dim, "<f8")
                if raw[0] != (ids, vectors):
                    i, v = opened(ids, vectors, dim, "<f8")
                    raw, block = ((ids, vectors), (i, scaled(v, self.scale))), (None, None)
                i, v = raw[1]
                q = scaled(q, self.scale)
                key = hashlib.sha256(q_ids + q_vectors).digest()
                best = held.pop(key, None) or (asked, [(np.zeros(0, np.int64), np.zeros(0, KINDS[0])) for _ in asked], KINDS[0])
                kind = max(exact_type(v, q), best[2], key=KINDS.index)
                if block[0] is not kind:
                    block = (kind, Ranges(i, converted(v, kind)))
                if kind is not best[2]:
                    best = (asked, [(a, converted(s, kind)) for a, s in best[1]], kind)
                held[key] = best
                block[1].search(asked, converted(q, kind), best[1], self.k)
                if len(held) > HELD:
                    yield self.given(held.pop(next(iter(held))))
        for best in held.values():
            yield self.given(best)

    @staticmethod
    def given(best: tuple[np.ndarray, list, type]) -> pa.RecordBatch:
        return results([(a, i, s) for a, (i, s) in zip(*best[:2], strict=True)])


def top_k(embeddings: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of highest integer inner product for each query but itself.
    ``is_query`` is a condition on ``vec_id``."""
    rows = usable(embeddings, id_col, vector_col, zero_too=True)
    return searched(blocks(rows, ROWS, "<f8", "rows", gathered), query_blocks(rows, is_query, "<f8"), Search(k, scale), k)


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op4_exact_topk": op4_exact_topk}
SQL = {
    "op4_exact_topk": """
    WITH fine AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
                  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
               FROM fine q JOIN fine c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
    ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
}
