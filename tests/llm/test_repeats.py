"""Repeated passages: the transform against all substrings, the operator against byte-by-byte brute force."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veridock.llm import bwt, suffixdup

SCHEMA = "doc_id long, text string, start long, k string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(max_size=24).map(lambda b: bytes(x % 3 for x in b)), max_size=8), st.integers(1, 8))
def test_classes(strings, least):
    got = {}
    for c, n, o in zip(*(x.tolist() for x in bwt.classes(strings, least)), strict=True):
        got.setdefault(c, set()).add((n, o))
    want = {}
    for i, s in enumerate(strings):
        for p in range(len(s) - least + 1):
            want.setdefault(s[p : p + least], set()).add((i, p))
    assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values() if len(x) > 1}


def brute(docs):
    """docs in order of doc_id; rows of one id and text are one document."""
    seen, out = {}, {}
    for n, (i, text) in enumerate(sorted({(i, t or "") for i, t in docs}, key=lambda d: (d[0] is not None, d[0] or 0))):
        data = text.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.setdefault(data[p : p + 100], n)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        out[i] = (len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed, passages=3):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    shared = [text(rng.choice([95, 101, 130, 400])) for _ in range(passages)]
    docs = []
    for i in range(60):
        parts = [text(rng.choice([0, 5, 60, 150]))]
        for _ in range(rng.choice([0, 1, 2])):
            parts += [rng.choice(shared)[rng.choice([0, 0, 7]) :], text(rng.choice([0, 1, 80]))]
        docs.append((i * 3, "".join(parts)))
    docs += [(1, docs[5][1]), (2, "ab" * 300), (4, "x" * 250), (500, None), (501, ""), (502, "y" * 99), (None, docs[7][1] + shared[0]), docs[9]]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed, contexts, segment, block, sampled", [(2000, 2000, 1 << 20, 1 << 20, 64), (5, 5, 1 << 20, 1 << 20, 64), (6, 2000, 256, 1 << 20, 64), (7, 5, 300, 500, 64), (8, 2, 1 << 20, 400, 1)])
def test_bytes(spark, monkeypatch, seed, contexts, segment, block, sampled):
    """Few contexts of an anchor in a chunk, short segments with anchors across their borders, small blocks, common anchors."""
    for name, value in {"CONTEXTS": contexts, "SEGMENT": segment, "BLOCK": block, "SAMPLED": sampled, "SPREAD": 2, "CHUNK_BYTES": 3000}.items():
        monkeypatch.setattr(suffixdup, name, value)
    docs = corpus(seed)
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in docs], SCHEMA).repartition(3)
    out = {r.doc_id: tuple(r)[1:] for r in suffixdup.remove_repeats(df).collect()}
    assert out == brute(docs)


def test_anchors_do_not_depend_on_segments(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    data, ends = rng.integers(97, 105, 9000).astype(np.uint8), np.array([40, 4000, 4100, 4101, 9000])
    want = [x.tolist() for x in suffixdup.anchors(data, ends)]
    for segment in (150, 256, 4096):
        monkeypatch.setattr(suffixdup, "SEGMENT", segment)
        assert [x.tolist() for x in suffixdup.anchors(data, ends)] == want


def test_spread_anchor():
    """One anchor with many contexts, resolved in chunks and brought together by digests; the same if it is known as common."""
    import numpy as np
    import pyarrow as pa

    n = 7000
    names = ["k", "context", "doc_id", "at", "sides", "repeat", "hot"]
    for hot in (False, True):
        batch = pa.RecordBatch.from_arrays([pa.array(np.full(n, 5)), *[pa.array(np.arange(n))] * 4, pa.array(np.zeros(n, bool)), pa.array(np.full(n, hot))], names=names)
        rows = [r for b in suffixdup._Resolve(5)(batch.slice(a, 900) for a in range(0, n, 900)) for r in b.to_pylist()]
        assert len(rows) == n and all(r["hot"] and not r["repeat"] for r in rows)
        sizes = {}
        for r in rows:
            sizes[r["chunk"]] = sizes.get(r["chunk"], 0) + 1
        assert max(sizes.values()) <= suffixdup.CONTEXTS and len(sizes) >= 4
    held = [(True, i, 0, bytes([i]) * 76 + b"s" * 100) for i in range(3)]
    found = [r for b in suffixdup._Expand().block(held) for r in b.to_pylist()]
    assert [(r["doc_id"], r["n"]) for r in found if r["d1"] is None] == [(1, 1), (2, 1)]
    assert sum(r["d1"] is not None for r in found) == 3 * 76 + 1


@pytest.mark.parametrize("spread", [25, 2])  # resolved by one task, and dealt out by context
def test_hot_passage_matches_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(suffixdup, "SPREAD", spread)
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(160))
    docs = [(i, "".join(rng.choice("klmnop ") for _ in range(120)) + passage + "".join(rng.choice("qrstuv ") for _ in range(120))) for i in range(4500)]
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in docs], SCHEMA).repartition(4)
    out = {r.doc_id: tuple(r)[1:] for r in suffixdup.remove_repeats(df).collect()}
    assert out == brute(docs)


def test_kept_text_and_empty(spark):
    docs = corpus(8)
    df = spark.createDataFrame([(i, t, 0, "k") for i, t in docs], SCHEMA)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in suffixdup.remove_repeats(df, with_text=True).collect())
    assert suffixdup.remove_repeats(df.limit(0)).count() == 0
