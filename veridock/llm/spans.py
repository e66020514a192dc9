"""Spans found in a text, as PII and secret scans report them: (kind, start, end) in code points, end exclusive."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from veridock.llm.common import arrow_map, id_and_text

Span = tuple[str, int, int]


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def ordered(spans: Sequence, kinds: Sequence[str]) -> list:
    """By start, then kind as listed, then end."""
    rank = {kind: i for i, kind in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2]))


class Digest:
    """Batches of texts to one row per document: counts and digest of the base spans, all spans, their scores."""

    def __init__(self, scan: Callable[[str], list], base: Sequence[str], kinds: Sequence[str]):
        self.scan, self.base, self.kinds = scan, tuple(base), tuple(kinds)

    @property
    def schema(self) -> str:
        return ", ".join(["doc_id long", *(f"n_{k} long" for k in self.base), "base_sha256 string, spans string, scores string, n_spans long"])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in self.base}
            digests, every, scores, total = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = ordered(self.scan(text or ""), self.kinds)
                base = [s[:3] for s in found if s[0] in counts]
                for kind in self.base:
                    counts[kind].append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                every.append(joined([s[:3] for s in found]))
                scores.append(",".join(f"{s[3]:.2f}" for s in found))
                total.append(len(found))
            columns = [batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in self.base), *(pa.array(x, pa.string()) for x in (digests, every, scores)), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in self.base), "base_sha256", "spans", "scores", "n_spans"])


def digest(docs: DataFrame, work: Digest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document; one pass, no shuffle."""
    return arrow_map(id_and_text(docs, id_col, text_col), work, work.schema)


class Spans:
    """Batches of texts to one row per span: doc_id, kind, start, end, value, score."""

    schema = "doc_id long, kind string, start long, end long, value string, score double"

    def __init__(self, scan: Callable[[str], list], kinds: Sequence[str]):
        self.scan, self.kinds = scan, tuple(kinds)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, s, e, text[s:e], score) for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if text for k, s, e, score in ordered(self.scan(text), self.kinds)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "kind", "start", "end", "value", "score"])


class Redact:
    """The same rows with every span's text replaced by ``[KIND]``; overlapping spans are replaced once, by the first kind.
    ``length_col`` names the column that holds the text's length, if any; no other column changes."""

    def __init__(self, scan: Callable[[str], list], kinds: Sequence[str], text_col: str = "text", length_col: str | None = None):
        self.scan, self.kinds, self.text_col, self.length_col = scan, tuple(kinds), text_col, length_col

    def text(self, text: str | None) -> str | None:
        spans = ordered(self.scan(text), self.kinds) if text else []
        if not spans:
            return text
        out, at, end = [], 0, -1
        for kind, s, e, _ in spans:
            if s >= end:
                out += [text[at:s], f"[{kind.upper()}]"]
            at = end = max(end, e)
        return "".join([*out, text[at:]])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(self.text_col).to_pylist()
            after = [self.text(t) for t in before]
            names = batch.schema.names
            columns = list(batch.columns)
            columns[names.index(self.text_col)] = pa.array(after, batch.schema.field(self.text_col).type)
            if self.length_col in names:
                k = names.index(self.length_col)
                old = columns[k].to_pylist()
                columns[k] = pa.array([o if a is b or a == b else len(a) for o, a, b in zip(old, after, before, strict=True)], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)
