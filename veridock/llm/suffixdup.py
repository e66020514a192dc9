"""Removal of passages that occur earlier in the corpus, down to a threshold of 100 bytes.

Each 100-byte string that also starts earlier is found, byte by byte and across documents:

1. Anchors. Of the 77 24-byte strings within any 100 bytes the one of smallest hash is an anchor; equal 100-byte strings
   have equal anchors at equal places. An anchor is one row: its hash, a hash of its context (the bytes of all 100-byte
   strings that have it), hashes of its two sides and its place. Anchors with equal context in a batch are settled before
   the shuffle.
2. Rows meet by anchor and pass through sorted. Of equal contexts all but the first are repeats as a whole: they are equal in
   178 bits of hashes (64 of the anchor, 50 of the context, 32 of either side). Contexts that are alone with their anchor, or
   share neither side of it with another, have nothing that repeats. The rest, mostly the edges of repeated passages, are
   candidates. Anchors that a sample of the documents shows to be common are dealt out by anchor and context, so that no
   task gets one common anchor as a whole, and all their contexts are candidates of a spread anchor.
3. Candidates' contexts are cut from the texts and go through the interval expansion of ``bwt``, in blocks of bounded
   size; it finds which of their 100-byte strings are equal, and all but the earliest of each class are repeats. A spread
   anchor's contexts lie in several blocks; the classes these find are then brought together by a digest of their strings.
4. Each document's repeats are united, and its remaining bytes are the result.

Texts are only shuffled for documents that have candidates or repeats; bitmaps of fixed size tell which, and which anchors are
common. Digests decide equality in step 2 (178 bits) and across blocks in step 3 (128 bits); putting every copy through the
expansion instead would take several times the processor time, for the same result.

Defined cases: a null text is read as empty; documents shorter than the threshold lose nothing; rows without a doc_id
come before all others; rows that repeat a doc_id with one text are the same document and are not repeats of each other,
with different texts they are ordered by a checksum; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridock.llm import bwt
from veridock.llm.common import arrow_batches, discard, table, tidy, written
from veridock.llm.shingles import _BASE, _BYTE, _INVERSE, mix, powers

LEAST, GRAM = 100, 24
WINDOW = LEAST - GRAM + 1
SIDE = (LEAST - GRAM) // 2
#: Bytes that are hashed at once, contexts of an anchor in one block, bytes of contexts in one block, bits of the bitmap.
SEGMENT, CONTEXTS, BLOCK, BITS = 1 << 20, 2000, 1 << 20, 1 << 24
#: One in so many documents is looked at for common anchors: those with more than ``SPREAD`` times ``CONTEXTS`` different contexts,
#: by what these documents have of them.
SAMPLED, SPREAD = 64, 25
#: Bytes of input for each of the chunks that a spread anchor's contexts are dealt out to: an anchor has at most one context in 77
#: bytes, so a chunk has a bounded number of them whether documents are many or long.
CHUNK_BYTES = 12 << 20
NO_ID = -(1 << 63)

_U = np.uint64
_LOW = (1 << 32) - 1


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column as (bytes of all rows, ends of rows) without copying."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def _slide(values: np.ndarray, width: int, of) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours."""
    reach = 1
    while 2 * reach <= width:
        values, reach = of(values[:-reach], values[reach:]), 2 * reach
    return of(values[: len(values) - (width - reach)], values[width - reach :]) if width > reach else values


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(_BASE, size), powers(_INVERSE, size)


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document number, place in it, anchor hash, context hash, side hashes) of all anchors. A context is what the strings
    that have the anchor cover; its hash holds its reach to the left and right in its low 14 bits. The side hashes are 32 bits each for the anchor with half
    of the other bytes of a string to its left and to its right, 0 where the document does not reach that far."""
    starts = np.concatenate([[0], ends[:-1]])
    up, down = _powers(SEGMENT + 4 * LEAST)
    found = []
    for s in range(0, len(data), SEGMENT):  # anchors from s on, with all strings around them
        e = min(len(data), s + SEGMENT)
        a, b = max(0, s - WINDOW + 1), min(len(data), e + LEAST)
        part = data[a:b]
        if len(part) < LEAST:
            continue
        summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * up[: len(part)], dtype=np.uint64)])
        gram = mix((summed[GRAM:] - summed[:-GRAM]) * down[: len(part) - GRAM + 1])
        rank = np.maximum((gram >> _U(32)).astype(np.uint32), np.uint32(1))
        least = _slide(rank, WINDOW, np.minimum)
        first, last = np.searchsorted(ends, [a, b - 1], side="right")
        limit = np.minimum(ends[first : last + 1], b)
        room = np.repeat(ends[first : last + 1], limit - np.maximum(starts[first : last + 1], a))[: len(least)] - np.arange(a, a + len(least))
        least[room < LEAST] = 0  # strings do not cross documents
        around = np.zeros(len(rank) + WINDOW - 1, np.uint32)
        around[WINDOW - 1 : WINDOW - 1 + len(least)] = least
        x = np.flatnonzero(_slide(around, WINDOW, np.maximum) == rank)
        x = x[(x + a >= s) & (x + a < e)]
        if not len(x):
            continue
        chosen = around[x[:, None] + np.arange(WINDOW)] == rank[x][:, None]  # strings from the earliest on that have the anchor
        lead = WINDOW - 1 - chosen.argmax(axis=1)
        tail = LEAST - chosen[:, ::-1].argmax(axis=1)
        context = mix((summed[x + tail] - summed[x - lead]) * down[x - lead])
        context = (context & _U(~0x3FFF & 0xFFFFFFFFFFFFFFFF)) | ((lead << 7) | tail).astype(np.uint64)
        left, right = np.maximum(x - SIDE, 0), np.minimum(x + GRAM + SIDE, len(part))
        sides = [np.where(fits, np.maximum(mix((summed[q] - summed[p]) * down[p]) >> _U(32), _U(1)), _U(0)) for p, q, fits in ((left, x + GRAM, lead >= SIDE), (x, right, tail >= GRAM + SIDE))]
        found.append((np.searchsorted(ends, x + a, side="right"), x + a, gram[x], context, (sides[0] << _U(32)) | sides[1]))
    if not found:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 3
    doc, x, gram, context, sides = (np.concatenate(c) for c in zip(*found, strict=True))
    return doc, x - starts[doc], gram, context, sides


def _heads(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _place(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, ends, document ids, text checksums shifted into the high half)"""
    data, ends = flat(batch.column("text"))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    check = np.fromiter((zlib.crc32(data[a:b]) & 0x7FFFFFFF for a, b in zip(starts, ends, strict=True)), np.int64, len(ends))
    return data, ends, batch.column("doc_id").to_numpy(), check << 32


_ANCHOR = "k long, context long, doc_id long, at long, sides long, repeat boolean, hot boolean"


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to the hashes of their anchors and contexts."""
    for batch in batches:
        _, _, gram, context, _ = anchors(*flat(batch.column("text")))
        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(context.view(np.int64))], names=["k", "context"])


def _inside(bits: bytes, hashed: np.ndarray) -> np.ndarray:
    """Whether a bitmap has the slots of hashes."""
    slot = (mix(hashed.view(np.uint64)) % _U(BITS)).astype(np.int64)
    return ((np.frombuffer(bits, np.uint8)[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)


def _packed(hashes: DataFrame, column: str) -> bytes:
    """Hashes as a bitmap of their slots; as many rows as the bitmap has bytes come to no task, and 512 of 4 KB to the driver."""
    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = batch.column(column).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique((mix(hashed) % _U(BITS)).astype(np.int64)))], names=["s"])

    return _bits(_mapped(hashes.select(column), slots, "s long"))


def _bits(slots: DataFrame) -> bytes:
    parts = slots.groupBy(F.expr("s div 32768").alias("b")).agg(F.bitmap_construct_agg(F.expr("s % 32768")).alias("m")).collect()
    out = bytearray(BITS // 8)
    for r in parts:
        out[r["b"] * 4096 : r["b"] * 4096 + len(r["m"])] = r["m"]
    return bytes(out)


class _Find:
    """Texts to anchors; those that repeat a context of their batch are marked and dealt out by themselves, those of common
    anchors are marked too."""

    def __init__(self, common: bytes):
        self.common = common

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends, ids, check = _place(batch)
            doc, x, gram, context, sides = anchors(data, ends)
            own, at = ids[doc], check[doc] + x
            order = np.lexsort((at, own, sides, context, gram))
            order = order[_heads(gram[order], context[order], sides[order], own[order], at[order])]  # a repeated row is not its own repeat
            gram, context, own, at, sides = gram[order], context[order], own[order], at[order], sides[order]
            repeat = ~_heads(gram, context, sides)
            k = np.where(repeat, mix(own.view(np.uint64) ^ mix(at.view(np.uint64))), gram)
            hot = _inside(self.common, gram) & ~repeat
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(context.view(np.int64)), pa.array(own), pa.array(at), pa.array(sides.view(np.int64)), pa.array(repeat), pa.array(hot)], names=["k", "context", "doc_id", "at", "sides", "repeat", "hot"])


_RESOLVED = "doc_id long, at long, context long, k long, sides long, chunk int, hot boolean, repeat boolean"


def _shared(group: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which rows share a side that is there with another row of their group."""
    order = np.lexsort((side, group))
    head = np.flatnonzero(_heads(group[order], side[order]))
    size = np.diff(np.concatenate([head, [len(order)]]))
    out = np.zeros(len(order), bool)
    out[order] = np.repeat(size > 1, size)
    return out & (side != 0)


class _Resolve:
    """Anchors sorted by hash, context and place to repeats and candidates; holds one anchor's contexts up to a bound. Those of
    common anchors are dealt into ``chunks`` by their context."""

    def __init__(self, chunks: int = 1):
        self.chunks = chunks

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, flushed = (None,) * 5, None, 0
        for batch in batches:
            k, context, own, at, sides, repeat, hot = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "context", "doc_id", "at", "sides", "repeat", "hot"))
            if repeat.any():
                yield self.rows(own[repeat], at[repeat], context[repeat], k[repeat], sides[repeat], 0, False, True)
                k, context, own, at, sides, hot = (c[~repeat] for c in (k, context, own, at, sides, hot))
            once = _heads(k, context, sides, own, at)
            if len(k) and (k[0], context[0], sides[0], own[0], at[0]) == last:
                once[0] = False
            k, context, own, at, sides, hot = (c[once] for c in (k, context, own, at, sides, hot))
            if not len(k):
                continue
            new = _heads(k, context, sides)
            new[0] = (k[0], context[0], sides[0]) != last[:3]
            last = (k[-1], context[-1], sides[-1], own[-1], at[-1])
            if not new.all():
                yield self.rows(own[~new], at[~new], context[~new], k[~new], sides[~new], 0, False, True)
            spread = new & hot
            if spread.any():
                chunk = (mix(context[spread].view(np.uint64)) % _U(self.chunks)).astype(np.int32)
                yield self.rows(own[spread], at[spread], context[spread], k[spread], sides[spread], chunk, True, False)
            new &= ~hot
            if not new.any():
                continue
            rows = tuple(c[new] for c in (own, at, context, k, sides))
            held = rows if held is None else tuple(np.concatenate(c) for c in zip(held, rows, strict=True))
            if not len(held[3]):
                continue
            done = len(held[3]) - int((held[3] == held[3][-1]).sum())
            if done:
                yield from self.groups(tuple(c[:done] for c in held), flushed)
                held, flushed = tuple(c[done:] for c in held), 0
            while len(held[3]) > 2 * CONTEXTS:
                yield self.rows(*(c[:CONTEXTS] for c in held), flushed, True, False)
                held, flushed = tuple(c[CONTEXTS:] for c in held), flushed + 1
        if held is not None and len(held[3]):
            yield from self.groups(held, flushed)

    def groups(self, held: tuple, flushed: int) -> Iterator[pa.RecordBatch]:
        """Complete anchors; the first may have had ``flushed`` chunks before."""
        head = np.flatnonzero(_heads(held[3]))
        size = np.diff(np.concatenate([head, [len(held[3])]]))
        chunk = (np.arange(len(held[3])) - np.repeat(head, size)) // CONTEXTS
        hot = np.repeat(size > CONTEXTS, size)
        if flushed:
            chunk[: size[0]] += flushed
            hot[: size[0]] = True
        # a string around the anchor has half of its other bytes on one side: no shared side, no shared string
        sides, group = held[4].view(np.uint64), np.repeat(np.arange(len(head)), size)
        kept = hot | _shared(group, sides >> _U(32)) | _shared(group, sides & _U(_LOW))
        if kept.any():
            yield self.rows(*(c[kept] for c in held), chunk[kept], hot[kept], False)

    @staticmethod
    def rows(own, at, context, k, sides, chunk, hot, repeat) -> pa.RecordBatch:
        n = len(own)
        full = lambda x, t: pa.array(np.broadcast_to(np.asarray(x), n).astype(t))
        return pa.RecordBatch.from_arrays([pa.array(own), pa.array(at), pa.array(context), pa.array(k), pa.array(sides), full(chunk, np.int32), full(hot, bool), full(repeat, bool)], names=["doc_id", "at", "context", "k", "sides", "chunk", "hot", "repeat"])


_CONTEXT = "k long, chunk int, hot boolean, doc_id long, start long, bytes binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their candidates to the candidates' contexts."""
    for batch in batches:
        out = []
        for own, check, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "check", "text", "found")), strict=True):
            for f in found:
                x, lead, tail = f["at"] & _LOW, (f["context"] >> 7) & 127, f["context"] & 127
                out.append((f["k"], f["chunk"], f["hot"], own, (check << 32) + x - lead, text[x - lead : x + tail]))
        for a in range(0, len(out), 5000):
            columns = zip(*out[a : a + 5000], strict=True)
            types = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["k", "chunk", "hot", "doc_id", "start", "bytes"])


_EXPANDED = "doc_id long, start long, n long, d1 long, d2 long"


class _Expand:
    """Contexts sorted by anchor and chunk to runs of repeated starts and, for spread anchors, the classes found."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, key = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("k", "chunk", "hot", "doc_id", "start", "bytes")), strict=True):
                if row[:2] != key and size >= BLOCK:
                    yield from self.block(held)
                    held, size = [], 0
                key = row[:2]
                held.append(row[2:])
                size += len(row[5]) + 1
        if held:
            yield from self.block(held)

    def block(self, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        hot, own, start = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        strings = [r[3] for r in rows]
        group, number, offset = bwt.classes(strings, LEAST)
        who, where = own[number], start[number] + offset
        order = np.lexsort((where, who, group))
        group, who, where, number, offset = group[order], who[order], where[order], number[order], offset[order]
        head = _heads(group)
        of = np.cumsum(head) - 1
        first_who, first_where = who[head][of] if len(of) else who, where[head][of] if len(of) else where
        later = (who != first_who) | (where != first_where)
        yield from self.runs(who[later], where[later])
        if hot.any():
            single = np.ones(int(sum(len(s) for s in strings)), bool)
            base = np.concatenate([[0], np.cumsum([len(s) for s in strings])])[:-1]
            single[base[number] + offset] = False
            single[base[number[head]] + offset[head]] = True  # one of each class
            yield from self.digests(strings, hot, own, start, single, base)

    @staticmethod
    def runs(who: np.ndarray, where: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((where, who))
        who, where = who[order], where[order]
        once = _heads(who, where)
        who, where = who[once], where[once]
        new = _heads(who) if len(who) else np.zeros(0, bool)
        new[1:] |= where[1:] != where[:-1] + 1
        head = np.flatnonzero(new)
        n = np.diff(np.concatenate([head, [len(who)]]))
        none = pa.nulls(len(head), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(who[head]), pa.array(where[head]), pa.array(n.astype(np.int64)), none, none], names=["doc_id", "start", "n", "d1", "d2"])

    @staticmethod
    def digests(strings, hot, own, start, wanted, base) -> Iterator[pa.RecordBatch]:
        rows = []
        for i in np.flatnonzero(hot):
            for o in range(len(strings[i]) - LEAST + 1):
                if wanted[base[i] + o]:
                    d = hashlib.blake2b(strings[i][o : o + LEAST], digest_size=16).digest()
                    rows.append((int(own[i]), int(start[i]) + o, None, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
        for a in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[a : a + 20_000], strict=True)], names=["doc_id", "start", "n", "d1", "d2"])


class _Bitmap:
    """Rows whose document is (or is not) in a bitmap of fixed size."""

    def __init__(self, bits: bytes, inside: bool, work=None):
        self.bits, self.inside, self.work = bits, inside, work

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(self.bits, np.uint8)

        def chosen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slot = batch.column("slot").to_numpy()
                yield batch.filter(pa.array(((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool) == self.inside))

        yield from self.work(chosen()) if self.work else chosen()


def _bitmap(places: DataFrame) -> bytes:
    """Which slots documents with ``places`` have: at most 512 rows of 4 KB come to the driver."""
    return _bits(places.select("doc_id").distinct().select(_slot().alias("s")))


class _Sharing:
    """Contexts of spread anchors that share a side with another one, as two bitmaps of sides tell."""

    def __init__(self, left: bytes, right: bytes):
        self.left, self.right = left, right

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_inside(self.left, batch.column("left").to_numpy()) | _inside(self.right, batch.column("right").to_numpy())))


def _slot():
    return F.pmod(F.xxhash64("doc_id"), F.lit(BITS))


_REST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class _Keep:
    """Texts with the runs of their repeated starts to what is left of them."""

    def __init__(self, with_text: bool = False):
        self.with_text = with_text

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            runs = batch.column("runs").to_pylist() if "runs" in batch.schema.names else [None] * batch.num_rows
            for own, text, found in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), runs, strict=True):
                spans: list[list[int]] = []
                for r in sorted((r["start"] & _LOW, r["n"]) for r in found or ()):
                    a, b = r[0], r[0] + r[1] - 1 + LEAST
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(b, spans[-1][1])
                    else:
                        spans.append([a, b])
                kept, at = [], 0
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                left = b"".join([*kept, text[at:]])
                rows.append((None if own == NO_ID else own, len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), *([left] * self.with_text)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * (5 + self.with_text)
            types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * self.with_text
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * self.with_text])


def _mapped(df: DataFrame, work, schema: str) -> DataFrame:
    arrow_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(batches)

    return df.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes of every document."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("text"))
    looked_at = _mapped(rows.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(SAMPLED)) == 0), _grams, "k long, context long")
    common = looked_at.distinct().groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > SPREAD * CONTEXTS / SAMPLED)
    chunks = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // CHUNK_BYTES
    dealt = F.when(F.col("hot"), F.xxhash64("k", "context")).otherwise(F.col("k"))
    found = _mapped(rows, _Find(_packed(common, "k")), _ANCHOR).repartition(dealt).sortWithinPartitions("k", "context", "sides", "doc_id", "at")
    resolved = written(_mapped(found, _Resolve(chunks), _RESOLVED), "resolved")
    # a repeated context: each of its starts is one
    whole = resolved.where("repeat").select("doc_id", (F.col("at") - F.expr("shiftright(context, 7) & 127")).alias("start"), F.expr("(shiftright(context, 7) & 127) + (context & 127) - 99").cast("long").alias("n"))

    slotted = rows.withColumn("slot", _slot().cast("long"))
    checked = F.crc32("text").bitwiseAND(F.lit(0x7FFFFFFF))
    kept = "doc_id long, text binary, slot long"
    candidates = resolved.where("not repeat and not hot")
    # a side of a spread anchor counts with the anchor, and only if it is there; 0 stands for none
    side = lambda c: F.when(c == 0, F.lit(0).cast("long")).otherwise(F.xxhash64("k", c))
    spread = resolved.where("hot").select("*", side(F.expr("shiftrightunsigned(sides, 32)")).alias("left"), side(F.expr("sides & 4294967295")).alias("right"))
    shared = [_packed(spread.where(F.col(c) != 0).groupBy(c).agg(F.count("*").alias("n")).where("n > 1"), c) for c in ("left", "right")]
    chosen = _mapped(spread.select(*candidates.columns, "left", "right"), _Sharing(*shared), _RESOLVED + ", left long, right long").select(candidates.columns)
    candidates = written(candidates.unionByName(chosen), "candidates")
    asked = candidates.groupBy("doc_id", F.expr("shiftright(at, 32)").alias("check")).agg(F.collect_list(F.struct("at", "context", "k", "chunk", "hot")).alias("found"))
    some = _mapped(slotted, _Bitmap(_bitmap(candidates), True), kept).select("doc_id", "text", checked.alias("check")).dropDuplicates(["doc_id", "check"])
    contexts = _mapped(some.join(asked, ["doc_id", "check"]).select("doc_id", "check", "text", "found"), _cut, _CONTEXT)
    expanded = written(_mapped(contexts.repartition("k", "chunk").sortWithinPartitions("k", "chunk"), _Expand(), _EXPANDED), "expanded")
    across = expanded.where("d1 is not null").select("d1", "d2", "doc_id", "start")
    first = across.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    more = across.join(first, ["d1", "d2"]).where("struct(doc_id, start) > first").select("doc_id", "start", F.lit(1).cast("long").alias("n"))
    places = written(whole.unionByName(expanded.where("d1 is null").select("doc_id", "start", "n")).unionByName(more), "places")

    discard(resolved, candidates, expanded)
    tidy(docs.sparkSession)
    bits = _bitmap(places)
    schema = _REST + ", kept binary" * with_text
    runs = places.groupBy("doc_id", F.expr("shiftright(start, 32)").alias("check")).agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    hit = _mapped(slotted, _Bitmap(bits, True), kept).select("doc_id", "text", checked.alias("check")).join(runs, ["doc_id", "check"], "left")
    return _mapped(hit.select("doc_id", "text", "runs"), _Keep(with_text), schema).unionByName(_mapped(slotted, _Bitmap(bits, False, _Keep(with_text)), schema))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op9_repeated_passages": op9_repeated_passages}
SQL: dict[str, str] = {}
