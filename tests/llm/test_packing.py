"""Packing: exact round trip of ids, best-fit decreasing item by item, gapless sequences."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veridock.llm import packing

SCHEMA = "doc_id long, text string, length string, rank int, sequence_id int"


def best_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = [(r, i) for i, r in enumerate(rooms) if r >= x]
        if fit:
            rooms[min(fit)[1]] -= x
        else:
            rooms.append(capacity - x)
    return sorted(rooms)


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=80))))
def test_plan_is_best_fit_decreasing(case):
    capacity, lengths = case
    counts = {x: lengths.count(x) for x in set(lengths)}
    runs = sorted(packing.plan(counts, capacity))
    bins = {}
    for x, n in counts.items():
        own = [r for r in runs if r[0] == x]
        for k in range(n):
            _, rank, first, each, offset = [r for r in own if r[1] <= k][-1]
            bins.setdefault(first + (k - rank) // each, []).append((offset + (k - rank) % each * x, x))
    for pieces in bins.values():
        at = 0
        for offset, x in sorted(pieces):
            assert offset == at
            at += x
        assert at <= capacity
    assert sorted(capacity - sum(x for _, x in p) for p in bins.values()) == best_fit(lengths, capacity)


def test_words_have_the_tokenizers_ids():
    path = packing.default_tokenizer()
    plain = Tokenizer.from_file(path)
    texts = ["It's  3.5%—“quoted”...\tÄÖ ΑΣ Σ", "a<|endoftext|>b <|ENDOFTEXT|>", "x" * 5000, "", None, "\x1c\x85 é e\u0301 \u0301", "don't 'S !?!", "ABC. abc, ÀÉ."]
    work = packing.Tokenize(open(path, encoding="utf-8").read())
    for text, ids in zip(texts, work.ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta."]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 300]))), "x", 1, 2) for i in range(60)]
    return [*rows, (60, None, None, None, None), (61, "", "", 0, 0), (3, "again", "y", 1, 1), (None, "no id", "z", 1, 1), rows[5]]


def test_round_trip_and_gapless(spark, docs):
    df = spark.createDataFrame(docs, SCHEMA)
    rows = packing.pack_documents(df, capacity=64).collect()
    plain = Tokenizer.from_file(packing.default_tokenizer())
    expected = sorted((d[0] if d[0] is not None else -1, k, s, len(ids[s : s + 64]), zlib.crc32(np.array(ids[s : s + 64], "<u4").tobytes())) for d in docs for ids in [[*plain.encode(d[1] or "", add_special_tokens=False).ids, 0]] for k, s in enumerate(range(0, len(ids), 64)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(64 - sum(x for _, x in p) for p in sequences.values()) == best_fit([r.length for r in rows], 64)


def test_sequences_hold_the_ids(spark, docs):
    df = spark.createDataFrame(docs, SCHEMA)
    out = packing.sequences(df, capacity=64).collect()
    assert all(len(r.ids) == 4 * r.n_tokens <= 256 for r in out)
    total = sum(len(x) for x in packing.Tokenize(open(packing.default_tokenizer(), encoding="utf-8").read()).ids([d[1] for d in docs]))
    assert sum(len(r.ids) for r in out) == total


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert packing.pack_documents(df).count() == 0
