"""Best-fit decreasing packing of tokenised documents into sequences.

Documents are tokenised, ended by a separator id and, if longer than a sequence, cut into pieces of its length. Best-fit
decreasing looks only at lengths, of which there are no more than a sequence has tokens. So the plan is made from the
number of pieces of each length: from the longest down, a segment tree over the remaining capacities finds the tightest
open bin in logarithmic time, and whole runs of equal pieces are placed at once where piece-by-piece best fit would place
them one after the other. The outcome is the one that best-fit decreasing over the whole corpus has, with a plan whose
size is bounded by the sequence length, not by the corpus; pieces then look up their place by their rank among those of
equal length.

Ranks come from (length, shard) counts: a shard is a hash of the piece, and the number of shards grows with the number of
pieces, so that a very common length is ranked by many tasks.

Defined cases: a null text is read as empty, so that the document is the separator alone; a piece as long as the
sequence has one of its own; rows that repeat a doc_id, or have none, are documents of their own; an empty table gives
an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veridock.llm.common import arrow_map, id_and_text, table, written

CAPACITY = 2048
SEPARATOR = 0
#: Pieces of a shard, and parts of words of a generation whose ids a worker remembers.
SHARD = 50_000
REMEMBERED = 400_000

_CLOSING = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_CACHE: dict[int, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """Ids of words, each encoded once and remembered. A word that ends in ASCII punctuation behind a letter is looked up
    as two parts, as the vocabulary's own splitting has it; what is remembered for long are parts, of which there are
    fewer. Memory is bounded: of parts two generations are kept, so frequent ones stay, of words one."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _encode(self, parts: list[str]) -> None:
        letters = [p for p in parts if p.isalpha()]
        for k in range(0, len(letters), 2000):
            some = letters[k : k + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            after = np.flatnonzero(self.ends[ids]) + 1
            if len(after) != len(some) or after[-1] != len(ids):
                self._one_by_one(some)
                continue
            data, at = ids.tobytes(), 0
            for part, end in zip(some, (4 * after).tolist(), strict=True):
                self.parts[part] = data[at:end]
                at = end
        self._one_by_one([p for p in parts if not p.isalpha()])

    def _one_by_one(self, parts: list[str]) -> None:
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False), strict=True):
            self.parts[part] = np.array(e.ids, "<u4").tobytes()

    def __call__(self, words: list[str]) -> list[bytes]:
        """The ids of different words."""
        if len(self.words) > REMEMBERED // 2:
            self.words = {}
        if len(self.parts) > REMEMBERED:
            self.old, self.parts = self.parts, {}
        known, parts, old = self.words, self.parts, self.old
        parts[""] = b""
        cut, wanted = [], set()
        for w in [w for w in words if w not in known]:
            stem, rest = w.rstrip(_CLOSING), ""
            if len(stem) == len(w) or not stem or not stem[-1].isalpha():
                stem = w
            else:
                rest = w[len(stem) :]
            for part in (stem, rest):
                if part not in parts:
                    if part in old:
                        parts[part] = old[part]
                    else:
                        wanted.add(part)
            cut.append((w, stem, rest))
        if wanted:
            self._encode(list(wanted))
        for w, stem, rest in cut:
            known[w] = parts[stem] + parts[rest] if rest else parts[stem]
        return list(map(known.__getitem__, words))


class Tokenize:
    """Batches of texts to pieces."""

    def __init__(self, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR, keep_ids: bool = False):
        self.tokenizer, self.capacity, self.separator, self.keep_ids = tokenizer, capacity, separator, keep_ids
        # all but the vocabulary, which stands last and is large
        at = tokenizer.index('"model"')
        parsed = json.loads(tokenizer[:at].rstrip().removesuffix(",") + "}")
        kind = parsed.get("normalizer") or {}
        steps = [p.get("type") for p in kind.get("normalizers", [kind])]
        self.special = [t["content"].lower() for t in parsed.get("added_tokens") or []]
        #: by word only if case and white space are dropped before the ids are made, as word_bpe_49k has it
        suffix = re.search(r'"end_of_word_suffix"\s*:\s*"</w>"', tokenizer[at:]) is not None
        self.by_word = "Replace" in steps and "Lowercase" in steps and "Removed" in str(parsed.get("pre_tokenizer")) and suffix

    def _state(self) -> tuple:
        key = zlib.crc32(self.tokenizer.encode())
        if key not in _CACHE:
            from tokenizers import Tokenizer

            loaded = Tokenizer.from_str(self.tokenizer)
            _CACHE[key] = (loaded, Words(loaded) if self.by_word else None)
        return _CACHE[key]

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, separators included, unsigned 32-bit; where each text's ids end)"""
        tokenizer, words = self._state()
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            return self._joined([np.array([*e.ids, self.separator], "<u4") for e in tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)])
        # only ASCII is lower-cased here: anything else may depend on its neighbours
        lower = pc.ascii_lower(texts)
        for x in self.special:  # the tokenizer looks for its special tokens before anything else
            if pc.any(pc.match_substring(lower, x)).as_py():
                rows = [self.flat(texts.slice(i, 1))[0] if not any(s in t for s in self.special) else np.array([*tokenizer.encode(raw, add_special_tokens=False).ids, self.separator], "<u4") for i, (t, raw) in enumerate(zip(lower.to_pylist(), texts.to_pylist(), strict=True))]
                return self._joined(rows)
        split = pc.ascii_split_whitespace(lower)
        coded = split.flatten().dictionary_encode()
        ids = words(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table = np.frombuffer(b"".join([*ids, np.array([self.separator], "<u4").tobytes()]), "<u4")
        size = np.append(size, 1)
        first = np.cumsum(size) - size
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        word = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends, len(ids))
        count = size[word]
        stop = np.cumsum(count)
        at = np.repeat((first[word] - (stop - count)).astype(np.int32), count)
        at += np.arange(len(at), dtype=np.int32)
        return table[at], stop[ends + np.arange(len(ends))]

    @staticmethod
    def _joined(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.zeros(0, "<u4"), *rows]), np.cumsum([len(r) for r in rows], dtype=np.int64)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit, separator included."""
        ids, ends = self.flat(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, ends[:-1])] if len(ends) else []

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, 2000) for b in batches for a in range(0, b.num_rows, 2000)):
            ids, ends = self.flat(batch.column("text"))
            data = memoryview(ids).cast("B")
            rows, a = [], 0
            for i, b in zip(batch.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                for k, s in enumerate(range(a, b, self.capacity)):
                    e = min(b, s + self.capacity)
                    rows.append((i, k, s - a, e - s, zlib.crc32(data[4 * s : 4 * e]), bytes(data[4 * s : 4 * e]) if self.keep_ids else None))
                a = b
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            last = 6 if self.keep_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:last], types[:last], strict=True)], names=names[:last])


def tokenize(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, unsigned 32-bit) of every piece. The
    vocabulary file is read on the driver only."""
    with open(tokenizer_path or default_tokenizer(), encoding="utf-8") as file:
        work = Tokenize(file.read(), capacity, separator, keep_ids)
    return arrow_map(id_and_text(docs, id_col, text_col), work, _PIECES + ", ids binary" * keep_ids)


class Capacities:
    """A segment tree over remaining capacities 0..n: which of them have open bins."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.tree = [False] * (2 * self.size)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]

    def _mark(self, r: int) -> None:
        k, self.tree[self.size + r] = (self.size + r) >> 1, bool(self.bins[r])
        while k:
            self.tree[k] = self.tree[2 * k] or self.tree[2 * k + 1]
            k >>= 1

    def push(self, r: int, first: int, n: int) -> None:
        if n and r:
            self.bins[r].append((first, n))
            self._mark(r)

    def pop(self, r: int) -> tuple[int, int]:
        out = self.bins[r].pop()
        self._mark(r)
        return out

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that has an open bin."""
        k = self.size + least
        if self.tree[k]:
            return least
        while k > 1:
            if not k & 1 and self.tree[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.tree[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over all pieces, in runs (length, first rank, first bin, pieces of a bin, offset): the j-th
    piece of a run goes to bin ``first + j // pieces`` at ``offset + (j % pieces) * length``."""
    runs, open_bins, next_bin = [], Capacities(capacity), 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = open_bins.tightest(length) if length <= capacity else None
            if room is None:
                room, bins = capacity, -(-left // (capacity // length))
                first = next_bin
                next_bin += bins
            else:
                first, bins = open_bins.pop(room)
            each = room // length  # a bin just used is the tightest still, until no further piece fits
            full = min(bins, left // each)
            if full:
                runs.append((length, rank, first, each, capacity - room))
                open_bins.push(room - each * length, first, full)
                rank, left, first, bins = rank + full * each, left - full * each, first + full, bins - full
            if bins and left:  # fewer pieces than a bin takes
                runs.append((length, rank, first, each, capacity - room))
                open_bins.push(room - left * length, first, 1)
                left, first, bins = 0, first + 1, bins - 1
            open_bins.push(room, first, bins)
    return runs


class Place:
    """Ranked pieces to their bins and offsets, by binary search in the plan."""

    def __init__(self, runs: list[tuple[int, int, int, int, int]]):
        ordered = np.array(sorted(runs), np.int64).reshape(-1, 5)
        self.length, self.rank, self.first, self.each, self.offset = ordered.T.copy()

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = _search(self.length, self.rank, length, rank)
            ahead = rank - self.rank[at]
            names = [n for n in batch.schema.names if n != "rank"]
            columns = [*(batch.column(n) for n in names), pa.array(self.first[at] + ahead // self.each[at]), pa.array(self.offset[at] + ahead % self.each[at] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])


def _search(run_length, run_rank, length, rank):
    """For each piece the last run of its length that does not begin after its rank."""
    base = int(max(rank.max(initial=0), run_rank.max(initial=0))) + 1
    if base < (1 << 62) // (int(run_length.max(initial=0)) + 1):
        return np.searchsorted(run_length * base + run_rank, length * base + rank, side="right") - 1
    out, ends = np.empty(len(length), np.int64), np.searchsorted(run_length, length, side="right")
    starts = np.searchsorted(run_length, length, side="left")
    for i in range(len(length)):
        out[i] = starts[i] + np.searchsorted(run_rank[starts[i] : ends[i]], rank[i], side="right") - 1
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any table with an integer ``length`` from 1 to the capacity) with sequence_id and offset. ``pieces``
    is read twice and should be a stored table."""
    by_shard = pieces.withColumn("_shard", F.pmod(F.xxhash64(*pieces.columns), F.lit(1 << 30)))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most a row for each length
    shards = max(1, sum(counts.values()) // SHARD)
    by_shard = by_shard.withColumn("_shard", F.pmod("_shard", F.lit(shards)))
    before = by_shard.groupBy("length", "_shard").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(W.partitionBy("length").orderBy("_shard").rowsBetween(W.unboundedPreceding, -1))).select("length", "_shard", F.coalesce("_before", F.lit(0)).alias("_before"))
    order = W.partitionBy("length", "_shard").orderBy(*pieces.columns)
    ranked = by_shard.withColumn("_in", F.row_number().over(order)).join(before, ["length", "_shard"])
    ranked = ranked.select(*pieces.columns, (F.col("_in") - 1 + F.col("_before")).cast("long").alias("rank"))
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return arrow_map(ranked, Place(plan(counts, capacity)), schema)


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(written(tokenize(docs, tokenizer_path, capacity, separator, False, id_col, text_col), "pieces"), capacity)


def sequences(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, doc_ids and ids (binary, unsigned 32-bit) in order. A
    sequence holds no more tokens than its capacity, so each group is small."""
    placed = pack(written(tokenize(docs, tokenizer_path, capacity, separator, True, id_col, text_col), "pieces"), capacity)
    gathered = placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return gathered.select("sequence_id", "n_tokens", F.expr("transform(p, x -> x.doc_id)").alias("doc_ids"), F.expr("unhex(array_join(transform(p, x -> hex(x.ids)), ''))").alias("ids"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
SQL: dict[str, str] = {}
