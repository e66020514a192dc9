"""URL filter on a sorted digest array.

Rules and listed hosts are (host, path) entries. Their 64-bit xxhash keys form a sorted array; a batch of URLs is probed with
one vectorised binary search of a memory-mapped file, and each hit is confirmed against the stored strings, so that equal
digests of different strings cannot decide. An entry fits its host and all subdomains if the URL's path starts with the
entry's path; of the entries that fit, the longest wins (equal lengths: the longer host).

Lists of up to ``MAPPED`` entries are one array, shipped with ``SparkContext.addFile``: one copy for each node whatever its
number of workers, one pass over the pages, no shuffle. Longer lists, given as tables, never reach the driver: Spark
computes the keys, their leading bits deal the entries out to shards, and each shard is sorted and stored as an array of
its own. The distinct strings that the pages' URLs ask for are dealt out alike, each shard's are probed in its mapped
array, and what is found is joined back. Both ways give the same verdicts.

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule, and is allowed; an empty path
starts with no rule's path, but a listed host fits it; hosts are compared after A-Z are lower-cased, paths as they are;
repeated rows are judged alike; of a repeated entry the one given first (smallest ``ord`` in a table) counts; null entries
and entries without a path are errors in a list and passed over in a table; an empty list allows everything; an empty
table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import math
import os
import pathlib
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridock.llm.common import arrow_map, table, written

ALLOW, BLOCK = "allow", "block"
#: (verdict, host and path) as the query's contract fixes them.
RULES = ((ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"), (ALLOW, "com/fr/"), (BLOCK, "com/de/"))
#: Hosts blocked where no rule fits: the method's own list, one host a line.
LISTED = tuple(f"{h}/" for h in pathlib.Path(__file__).with_name("blocklist.txt").read_text().split("\n") if h and not h.startswith("#"))
#: Entries of a list that is shipped as one array (some 100 MB), and entries of a shard of a longer one.
MAPPED, SHARD = 1 << 20, 1 << 18
#: Spark's own seed of xxhash64, so that it and the workers compute the same keys.
SEED = 42

_SCHEMA = "page_id long, host string, path string, rule string, listed string, verdict string"
_FILES: dict[str, str] = {}


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def build_index(entries: Iterable[tuple[str, str]], seed: int = SEED) -> bytes:
    """(verdict, ``host/path``) entries as bytes: counts, sorted keys, verdicts, string ends, strings, path lengths. A
    repeated entry counts once, with the verdict given first."""
    first: dict[str, str] = {}
    for verdict, entry in entries:
        first.setdefault(entry, verdict)
    rows = sorted((xxhash.xxh64_intdigest(e.encode(), seed), e, v) for e, v in first.items())
    texts = [e.encode() for _, e, _ in rows]
    lengths = sorted({len(e) - e.index("/") for _, e, _ in rows})
    head = np.array([len(rows), len(lengths), seed], "<u8")
    keys = np.array([k for k, _, _ in rows], "<u8")
    ends = np.cumsum([len(t) for t in texts], dtype="<u8") if rows else np.array([], "<u8")
    flags = np.array([v == BLOCK for _, _, v in rows], "<u8")
    return b"".join([head.tobytes(), keys.tobytes(), ends.tobytes(), flags.tobytes(), np.array(lengths, "<u8").tobytes(), *texts])


class Index:
    """A memory-mapped digest array."""

    def __init__(self, path: str):
        self.data = np.memmap(path, dtype=np.uint8, mode="r")
        n, lengths, self.seed = (int(x) for x in self.data[:24].view("<u8"))
        parts = [self.data[24 + 8 * a : 24 + 8 * b].view("<u8") for a, b in ((0, n), (n, 2 * n), (2 * n, 3 * n), (3 * n, 3 * n + lengths))]
        self.keys, self.ends, self.flags = parts[:3]
        self.lengths = [int(x) for x in parts[3]]
        self.texts = self.data[24 + 8 * (3 * n + lengths) :]

    def entry(self, i: int) -> str:
        return self.texts[int(self.ends[i - 1]) if i else 0 : int(self.ends[i])].tobytes().decode()

    def probe(self, texts: list[str]) -> list[int]:
        """The number of the entry that equals each string, -1 if none does."""
        out = [-1] * len(texts)
        if not texts or not len(self.keys):
            return out
        keys = np.fromiter((xxhash.xxh64_intdigest(t.encode("utf-8", "replace"), self.seed) for t in texts), np.uint64, len(texts))
        at = np.searchsorted(self.keys, keys)
        for k in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys):
            j = int(at[k])
            while j < len(self.keys) and self.keys[j] == keys[k]:
                if self.entry(j) == texts[k]:
                    out[k] = j
                    break
                j += 1
        return out

    def longest(self, hosts: list[str], paths: list[str]) -> list[tuple[str, bool] | None]:
        """For each URL the longest entry that fits and whether it blocks."""
        row, texts = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            for text in asked(host, path, self.lengths):
                row.append(i)
                texts.append(text)
        best: list[tuple[int, int, str, bool] | None] = [None] * len(hosts)
        for i, text, j in zip(row, texts, self.probe(texts), strict=True):
            if j >= 0:
                found = (len(text), text.index("/"), text, bool(self.flags[j]))
                best[i] = max(best[i] or found, found)
        return [b and (b[2], b[3]) for b in best]


def asked(host: str, path: str, lengths: Iterable[int]) -> list[str]:
    """The entries that a URL could fit: its host and every parent, with every beginning of its path of the given lengths."""
    if not host or not path:
        return []
    starts = [0, *(k + 1 for k, c in enumerate(host) if c == ".")]
    return [host[s:] + path[:n] for n in lengths if n <= len(path) for s in starts]


class _Judge:
    def __init__(self, rules: str, listed: str):
        self.rules, self.listed = rules, listed

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, listed = Index(SparkFiles.get(self.rules)), Index(SparkFiles.get(self.listed))
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            by_rule, by_list = rules.longest(hosts, paths), listed.longest(hosts, [p or "/" for p in paths])
            verdicts = [BLOCK if (r[1] if r else bool(x and x[1])) else ALLOW for r, x in zip(by_rule, by_list, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array([r and r[0] for r in by_rule], pa.string()), pa.array([x and x[0] for x in by_list], pa.string()), pa.array(verdicts, pa.string())],
                names=["page_id", "host", "path", "rule", "listed", "verdict"],
            )


def shipped(spark: SparkSession, index: bytes) -> str:
    """Put an index on every node; its name is its content's digest, so the same list is shipped once."""
    name = f"urls-{hashlib.sha256(index).hexdigest()[:32]}.idx"
    known = f"{spark.sparkContext.applicationId}/{name}"
    if known not in _FILES:
        path = os.path.join(tempfile.mkdtemp(prefix="veridock-"), name)
        with open(path, "wb") as out:
            out.write(index)
        spark.sparkContext.addFile(path)
        _FILES[known] = path
    return name


def _urls(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    url = F.col("url")
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]], listed: Iterable[str] = (), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, listed, verdict for every row. ``rules`` decide first; ``listed`` entries block what
    no rule fits. One pass, no shuffle; only the key and the URL are read. Either list may be at most ``MAPPED`` long."""
    spark = pages.sparkSession
    rules, listed = list(rules), list(listed)
    if max(len(rules), len(listed)) > MAPPED:
        raise ValueError("lists of this length are tables: judge_by_table")
    work = _Judge(shipped(spark, build_index(rules)), shipped(spark, build_index((BLOCK, e) for e in listed)))
    return arrow_map(_urls(pages, id_col, url_col), work, _SCHEMA)


_SHARD = "kind string, shard long, array binary"
_HIT = "kind string, text string, blocks boolean"


def _stored(entries: pa.Table) -> pa.Table:
    """A shard's entries as one sorted array."""
    index = build_index(zip(entries.column("verdict").to_pylist(), entries.column("entry").to_pylist(), strict=True))
    return pa.table({"kind": entries.column("kind")[:1], "shard": entries.column("shard")[:1], "array": pa.array([index], pa.binary())})


def _searched(arrays: pa.Table, texts: pa.Table) -> pa.Table:
    """The strings of a shard that its array has."""
    found: list[tuple[str, str, bool]] = []
    probes = texts.column("text").to_pylist()
    for kind, array in zip(arrays.column("kind").to_pylist(), arrays.column("array").to_pylist(), strict=True):
        with tempfile.NamedTemporaryFile() as file:
            file.write(array)
            file.flush()
            index = Index(file.name)
            found += [(kind, t, bool(index.flags[j])) for t, j in zip(probes, index.probe(probes), strict=True) if j >= 0]
    columns = list(zip(*found, strict=True)) or [(), (), ()]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("kind", "text", "blocks"), columns, (pa.string(), pa.string(), pa.bool_()), strict=True)})


class _Asked:
    """URLs to the strings they ask for; ``lengths``: path lengths of each kind of list."""

    def __init__(self, lengths: dict[str, list[int]]):
        self.lengths = lengths

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True))
            texts = [[("rule", t) for t in asked(h, p, self.lengths["rule"])] + [("listed", t) for t in asked(h, p or "/", self.lengths["listed"])] for h, p in rows]
            kind = pa.struct([("kind", pa.string()), ("text", pa.string())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([[{"kind": k, "text": t} for k, t in row] for row in texts], pa.list_(kind))], names=[*batch.schema.names, "asked"])


def judge_by_table(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """As ``judge``, for lists of any length: ``rules`` has ord, verdict and entry, ``listed`` ord and entry."""
    every = rules.select(F.lit("rule").alias("kind"), "ord", "verdict", "entry").unionByName(listed.select(F.lit("listed").alias("kind"), "ord", F.lit(BLOCK).alias("verdict"), "entry"))
    every = written(every.where(F.contains("entry", F.lit("/"))).groupBy("kind", "entry").agg(F.min_by("verdict", "ord").alias("verdict")), "entries")
    lengths: dict[str, list[int]] = {"rule": [], "listed": []}
    for r in every.select("kind", (F.length("entry") - F.instr("entry", "/") + 1).alias("n")).distinct().collect():  # as many as paths have lengths
        lengths[r["kind"]].append(r["n"])
    bits = max(0, math.ceil(math.log2(max(1, every.count()) / SHARD)))
    shard = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - bits) if bits else F.lit(0).cast("long")
    arrays = written(every.withColumn("shard", shard("entry")).groupBy("kind", "shard").applyInArrow(_stored, _SHARD), "arrays")

    one = F.monotonically_increasing_id().alias("row")
    urls = written(arrow_map(_urls(pages, id_col, url_col).select(one, "page_id", "host", "path"), _Asked(lengths), "row long, page_id long, host string, path string, asked array<struct<kind:string,text:string>>"), "urls")
    wanted = urls.select("row", F.explode("asked").alias("a")).select("row", "a.kind", "a.text")
    texts = wanted.select("text").distinct().withColumn("shard", shard("text"))
    hits = arrays.groupBy("shard").cogroup(texts.groupBy("shard")).applyInArrow(_searched, _HIT)
    place = F.struct(F.length("text").alias("n"), F.instr("text", "/").alias("h"), "text", "blocks")
    best = wanted.join(hits, ["kind", "text"]).groupBy("row").agg(F.max(F.when(F.col("kind") == "rule", place)).alias("r"), F.max(F.when(F.col("kind") == "listed", place)).alias("l"))
    out = urls.join(best, "row", "left")
    verdict = F.when(F.coalesce("r.blocks", "l.blocks", F.lit(False)), BLOCK).otherwise(ALLOW)
    return out.select("page_id", "host", "path", F.col("r.text").alias("rule"), F.col("l.text").alias("listed"), verdict.alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES, LISTED)


def _sql() -> str:
    entries = [(v, e, "rule") for v, e in RULES] + [(BLOCK, e, "listed") for e in LISTED]
    values = ", ".join(f"('{kind}', '{v}', '{e}', '{e[: e.index('/')]}', '{e[e.index('/') :]}')" for v, e, kind in entries)
    return f"""
    WITH entry(kind, says, entry, ehost, epath) AS (VALUES {values}),
    rest AS (SELECT row_number() OVER () AS k, page_id,
                    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    page AS (SELECT k, page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    hit AS (SELECT k, kind, says, entry, row_number() OVER (PARTITION BY k, kind ORDER BY length(entry) DESC, length(ehost) DESC) AS rn
            FROM page JOIN entry ON (host = ehost OR ends_with(host, '.' || ehost))
             AND starts_with(CASE WHEN kind = 'listed' AND path = '' THEN '/' ELSE path END, epath))
    SELECT p.page_id, p.host, p.path, r.entry AS rule, l.entry AS listed,
           coalesce(r.says, l.says, '{ALLOW}') AS verdict
    FROM page p LEFT JOIN hit r ON r.k = p.k AND r.kind = 'rule' AND r.rn = 1
                LEFT JOIN hit l ON l.k = p.k AND l.kind = 'listed' AND l.rn = 1"""


QUERIES = {"op2_url_filter": op2_url_filter}
SQL = {"op2_url_filter": _sql()}
