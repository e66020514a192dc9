"""Near-duplicate classes: ProbMinHash signatures, banding, exact verification, connected components.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is at least the threshold (0.8). A
class is a connected component of links. Candidates come from weighted signatures, in which a shingle's weight grows
slowly with its count (1 + ln(count) / 4): a text that repeats one phrase is not taken for another that does so too.

1. Texts with the same words are one exact group, found by a 128-bit digest; only the smallest id of each goes on.
2. Signatures of 192 registers in 32 bands of 6: a pair of similarity 0.8 shares no band with probability 6e-5.
3. Pairs whose numbers of shingles rule the threshold out are never compared. No bucket is paired with itself: each names
   leaders, first the members that share most buckets with others, which in a group of copies with different changes are
   those closest to the original. Every member is compared with the first leader, and in the second round with the
   further leaders, but only across components that are still apart and never twice. So a large group of near copies,
   whose members need one link each, joins after few comparisons a member, and a bucket with one member more than
   leaders is compared in full.
4. A larger bucket that still spans several components is settled in full, but its pairs are never rows: the texts of all
   such buckets are dealt into blocks, and each two blocks with a bucket in common are a cell. A cell gets both blocks'
   texts once, finds its pairs that share a bucket, lie in different components and fit in size, compares them by a
   product of incidence matrices, and gives out links only.
5. Links are verified on whole texts; components are found by star contraction.

Defined cases: null or wordless texts have no shingles and are classes of their own, never linked; texts of one to four
words have one shingle; rows that repeat a doc_id are one document and one result row; rows without a doc_id come back
as a class of their own with null ids; an empty table gives an empty result. Other columns are ignored, whatever their
names; ``representatives`` carries them along, and of rows that repeat an id keeps the one whose text comes first in
order (null before all), then the one that is first when the whole row is written as JSON.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veridock.llm import shingles as sh
from veridock.llm.common import arrow_map, discard, id_and_text, table, tidy, written
from veridock.llm.graph import components

THRESHOLD = 0.8
BANDS, ROWS = 32, 6
#: Leaders of a bucket that the rounds use up; larger buckets are settled afterwards.
ROUNDS = ((0, 1), (1, 15))
#: Texts and characters of a block, on average.
BLOCK_TEXTS, BLOCK_CHARS = 512, 2 << 20

_SIGNATURE = "doc_id long, c1 long, c2 long, size long, bands array<long>"
_PAIR = "a long, b long"
_LINK = "a long, b long, probability double, jaccard double, linked boolean"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def normal(text: str | None) -> str:
    """The words with one blank between them; digests, sizes, signatures and verification all read this form."""
    return " ".join((text or "").lower().split())


class Signatures:
    """Batches of texts to content digest and band keys; equal texts of a batch are signed once."""

    def __init__(self, n_bands: int = BANDS, rows: int = ROWS):
        self.n_bands, self.rows = n_bands, rows

    def keys(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of distinct shingles, band keys) of each text"""
        doc, element, count = sh.shingles(texts)
        return np.bincount(doc, minlength=len(texts)), sh.bands(sh.prob_minhash(doc, element, sh.weights(count), len(texts), self.n_bands * self.rows), self.n_bands)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = part.column("doc_id").to_pylist()
                digests, unique = [], {}
                for i, text in zip(ids, part.column("text").to_pylist(), strict=True):
                    plain = normal(text)
                    d = xxhash.xxh3_128_intdigest(plain.encode("utf-8", "replace")) if plain else None
                    digests.append((i, -1) if d is None else (_signed(d >> 64), _signed(d & ((1 << 64) - 1))))
                    if d is not None:
                        unique.setdefault(digests[-1], (len(unique), plain))
                sizes, keys = self.keys([t for _, t in unique.values()]) if unique else ((), ())
                found = [keys[unique[d][0]] if d in unique else [] for d in digests]
                size = [int(sizes[unique[d][0]]) if d in unique else 0 for d in digests]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array(size, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                    names=["doc_id", "c1", "c2", "size", "bands"],
                )


class Verify:
    """Pairs with both texts to their similarities; neighbouring pairs share a leader, whose shingles are kept."""

    def __init__(self, threshold: float = THRESHOLD):
        self.threshold = threshold

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, int], tuple] = {}

        def parsed(i: int, text: str) -> tuple:
            key = (i, hash(text))
            if key not in kept:
                if len(kept) >= 64:
                    kept.pop(next(iter(kept)))
                _, element, count = sh.shingles([normal(text)])
                kept[key] = (element, sh.weights(count))
            return kept[key]

        for batch in batches:
            a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))
            both = [sh.similarity(parsed(x, s), parsed(y, t)) for x, y, s, t in zip(a, b, ta, tb, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array([p for p, _ in both], pa.float64()), pa.array([j for _, j in both], pa.float64()), pa.array([j >= self.threshold for _, j in both], pa.bool_())],
                names=["a", "b", "probability", "jaccard", "linked"],
            )


def intersections(x: list[np.ndarray], y: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of ``x`` with all of ``y``, as products of incidence matrices."""
    shared = np.intersect1d(np.concatenate(x), np.concatenate(y))
    out = np.zeros((len(x), len(y)))
    if not len(shared):
        return out

    def placed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        owner, element = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        column = np.minimum(np.searchsorted(shared, element), len(shared) - 1)
        fit = shared[column] == element
        order = np.argsort(column[fit], kind="stable")
        return owner[fit][order], column[fit][order]

    sides = [(len(s), *placed(s)) for s in (x, y)]
    for low in range(0, len(shared), columns):
        dense = []
        for n, owner, column in sides:
            a, b = np.searchsorted(column, [low, low + columns])
            dense.append(np.zeros((n, min(columns, len(shared) - low)), np.float32))
            dense[-1][owner[a:b], column[a:b] - low] = 1
        out += dense[0] @ dense[1].T
    return out


class Cell:
    """Two blocks of open texts (d, text, size, label, keys) to the pairs between them that are linked."""

    def __init__(self, threshold: float = THRESHOLD):
        self.threshold = threshold

    def __call__(self, left: pa.Table, right: pa.Table) -> pa.Table:
        linked = self.linked(left, right) if len(left) and len(right) else []
        return pa.table({"a": pa.array([a for a, _ in linked], pa.int64()), "b": pa.array([b for _, b in linked], pa.int64())})

    def candidates(self, left: pa.Table, right: pa.Table) -> np.ndarray:
        """Which pairs share a bucket, lie in different components and are near enough in size; each pair once."""
        out = np.zeros((len(left), len(right)), bool)
        where: list[dict[int, list[int]]] = [{}, {}]
        for side, rows in zip(where, (left, right), strict=True):
            for i, keys in enumerate(rows.column("keys").to_pylist()):
                for key in keys:
                    side.setdefault(key, []).append(i)
        for key in where[0].keys() & where[1].keys():
            out[np.ix_(where[0][key], where[1][key])] = True
        (d, e), (m, n), (x, y) = ([t.column(c).to_numpy() for t in (left, right)] for c in ("d", "size", "label"))
        out &= (x[:, None] != y[None, :]) & (np.minimum(m[:, None], n[None, :]) >= self.threshold * np.maximum(m[:, None], n[None, :]))
        if left.column("block")[0] == right.column("block")[0]:
            out &= d[:, None] < e[None, :]
        return out

    def linked(self, left: pa.Table, right: pa.Table) -> list[tuple[int, int]]:
        wanted = self.candidates(left, right)
        rows, columns = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
        if not len(rows):
            return []
        wanted = wanted[np.ix_(rows, columns)]
        sets = [[sh.shingles([normal(t)])[1] for t in side.column("text").take(pa.array(chosen)).to_pylist()] for side, chosen in ((left, rows), (right, columns))]
        size = [np.array([len(s) for s in side]) for side in sets]
        if np.count_nonzero(wanted) <= 4 * (len(rows) + len(columns)):
            common = np.zeros(wanted.shape)
            for i, j in zip(*np.nonzero(wanted), strict=True):
                common[i, j] = len(np.intersect1d(sets[0][i], sets[1][j], assume_unique=True))
        else:
            common = intersections(*sets)
        close = wanted & (common >= self.threshold * (size[0][:, None] + size[1][None, :] - common))
        d, e = (t.column("d").to_numpy()[chosen] for t, chosen in ((left, rows), (right, columns)))
        return sorted({(int(min(d[i], e[j])), int(max(d[i], e[j]))) for i, j in zip(*np.nonzero(close), strict=True)})


def settled(known: DataFrame, texts: DataFrame, threshold: float) -> DataFrame | None:
    """The links (a, b) across components in buckets that the leaders did not exhaust; none if there is no such bucket.
    ``known``: key, d, size, label."""
    spans = known.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    spans = spans.where((F.col("n") > ROUNDS[-1][1] + 1) & (F.col("low") != F.col("high"))).select("key")
    left = known.join(spans, "key").groupBy("d").agg(F.first("size").alias("size"), F.first("label").alias("label"), F.collect_set("key").alias("keys"))
    involved = written(texts.join(left.withColumnRenamed("d", "doc_id"), "doc_id").select(F.col("doc_id").alias("d"), "text", "size", "label", "keys"), "open")
    volume = involved.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    if not volume["n"]:
        discard(involved)
        return None
    blocks = max(1, -(-volume["n"] // BLOCK_TEXTS), -(-(volume["chars"] or 0) // BLOCK_CHARS))
    rows = involved.withColumn("block", F.pmod(F.xxhash64("d", F.lit(7)), F.lit(blocks)))
    at = rows.select("block", F.explode("keys").alias("key")).distinct()
    cells = at.select("key", F.col("block").alias("x")).join(at.select("key", F.col("block").alias("y")), "key").where("x <= y").select("x", "y").distinct()
    cells = written(cells, "cells")
    left = cells.join(rows, F.col("x") == F.col("block"))
    other = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # columns of its own, as a cogroup needs them
    right = cells.select(F.col("x").alias("u"), F.col("y").alias("v")).join(other, F.col("v") == F.col("block"))
    work = Cell(threshold)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return work(left, right)

    found = written(left.groupBy("x", "y").cogroup(right.groupBy("u", "v")).applyInArrow(run, _PAIR).distinct(), "links")
    discard(involved, cells)
    return found


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), exact_id (smallest doc_id with the same words), n_links (verified
    links of its exact group to other texts) and kept (it is its class's representative), one row per document."""
    rows = id_and_text(docs, id_col, text_col)
    keyed = rows.where("doc_id is not null")
    signed = written(arrow_map(keyed, Signatures(), _SIGNATURE), "signatures")
    groups = written(signed.groupBy("c1", "c2").agg(F.min("doc_id").alias("exact_id"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.count("*").alias("n")), "groups")

    spread = groups.select(F.col("exact_id").alias("d"), "size", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(spread.join(shared, "key"), "members")
    company = members.groupBy("d").agg(F.sum("n").alias("company"))
    order = W.partitionBy("key").orderBy(F.desc("company"), "d")
    ranked = members.join(company, "d").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ROUNDS[-1][1])
    leaders = written(ranked.select("key", "d", "rank"), "leaders")
    texts = written(keyed.join(members.select(F.col("d").alias("doc_id")).distinct(), "doc_id").dropDuplicates(["doc_id", "text"]), "texts")

    labels: DataFrame | None = None
    links: DataFrame | None = None
    compared: DataFrame | None = None
    used: list[DataFrame] = [members, leaders, texts]

    def labelled() -> DataFrame:
        known = members if labels is None else members.join(labels.select(F.col("id").alias("d"), "label"), "d", "left")
        return known.select("key", "d", "size", (F.col("d") if labels is None else F.coalesce("label", "d")).alias("label"))

    for low, high in ROUNDS:
        known = labelled()
        led = known.join(leaders.where(F.col("rank").between(low + 1, high)).select("key", "d"), ["key", "d"])
        led = led.groupBy("key").agg(F.collect_list(F.struct("d", "size", "label")).alias("led"))
        # sets whose sizes differ by more than the threshold cannot be that similar
        fit = lambda x: (x["label"] != F.col("label")) & (F.least(x["size"], F.col("size")) >= threshold * F.greatest(x["size"], F.col("size")))
        pairs = known.join(led, "key").select("d", F.explode(F.filter("led", fit)).alias("leader")).select("d", "leader.d").toDF("d", "leader")
        pairs = pairs.select(F.least("d", "leader").alias("a"), F.greatest("d", "leader").alias("b")).distinct()
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        used.append(pairs)
        compared = pairs if compared is None else compared.unionByName(pairs)
        text = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"t{c}"))
        checked = arrow_map(pairs.join(text("b"), "b").join(text("a"), "a").select("a", "b", "ta", "tb"), Verify(threshold), _LINK)
        new = written(checked.where("linked").select("a", "b").distinct(), "links")
        links = new if links is None else links.unionByName(new)
        if labels is None or not new.isEmpty():
            labels = components(links)
    rest = settled(labelled(), texts, threshold)
    if rest is not None and not rest.isEmpty():
        links = links.unionByName(rest).distinct()
        labels = components(links)
    discard(*used)
    tidy(docs.sparkSession)

    degree = links.select(F.col("a").alias("exact_id")).unionByName(links.select(F.col("b").alias("exact_id"))).groupBy("exact_id").agg(F.count("*").alias("n_links"))
    facts = groups.where("n > 1").select("c1", "c2", "exact_id")
    own = signed.select("doc_id", "c1", "c2").join(facts, ["c1", "c2"], "left").select("doc_id", F.coalesce("exact_id", "doc_id").alias("exact_id"))
    own = own.join(labels.select(F.col("id").alias("exact_id"), "label"), "exact_id", "left").join(degree, "exact_id", "left")
    found = own.groupBy("doc_id").agg(F.min(F.coalesce("label", "exact_id")).alias("class_id"), F.min("exact_id").alias("exact_id"), F.max(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"))
    found = found.select("doc_id", "class_id", "exact_id", "n_links", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    none = F.lit(None).cast("long")
    return found.unionByName(rows.where("doc_id is null").select("doc_id", none.alias("class_id"), none.alias("exact_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept")))


def representatives(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class, all columns as they are; rows without an id stay, of rows that repeat an id
    one does."""
    verdict = classes(docs, threshold, id_col, text_col).where("doc_id is not null")
    gone = written(verdict.where("not kept").select(F.col("doc_id").alias("gone")), "gone")
    # the rows' own columns are one struct, so that no name can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kept = rows.join(gone, F.col("id") == F.col("gone"), "left_anti")
    repeated = rows.where("id is not null").groupBy("id").count().where("count > 1").limit(1).count()
    if repeated:
        order = W.partitionBy("id").orderBy(F.asc_nulls_first("text"), F.to_json("row"))
        rest = kept.where("id is not null").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
        kept = rest.unionByName(kept.where("id is null"))
    return kept.select("row.*")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


QUERIES = {"op3_near_duplicates": op3_near_duplicates}
SQL: dict[str, str] = {}
