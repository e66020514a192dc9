"""Near-duplicate classes against all pairs; signatures against exact similarity; components against union-find."""

import itertools
import random

import numpy as np
import pyarrow as pa

from veridock.llm import graph, neardup, shingles

SCHEMA = "doc_id long, text string, class_id string, size int"


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    known = {}
    for i, t in docs:
        if i is not None:
            known.setdefault(i, []).append(sets(t))
    label = {i: i for i in known}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(sorted(known), 2):
        if any(x and y and len(x & y) >= 0.8 * len(x | y) for x in known[a] for y in known[b]):
            ra, rb = sorted((root(a), root(b)))
            label[rb] = ra
    return {i: root(i) for i in known}


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    docs, i = [], 0
    passage = text(60)
    for _ in range(25):
        base = text(rng.choice([3, 8, 40, 200]))
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append((i, " ".join(copy)))
            i += 1
    base = text(150)
    for _ in range(40):  # copies of one original with different changes, about 0.8 from each other
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        docs.append((i, " ".join(copy)))
        i += 1
    for _ in range(20):  # a passage that unrelated documents share
        docs.append((i, " ".join([*text(60), *passage])))
        i += 1
    docs += [(i + k, t) for k, t in enumerate([None, "", "", " \n", "one", "one", "ONE", "a b", "phrase " * 300, "x y " * 300 + " ".join(text(50))])]
    docs += [docs[0], (docs[1][0], "quite another text under the same id"), (None, "no id"), (None, docs[0][1])]
    return docs


def test_classes_match_all_pairs(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    out = neardup.classes(df).collect()
    want = brute(docs)
    assert {r.doc_id: r.class_id for r in out if r.doc_id is not None} == want
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == sorted(want) and sum(r.doc_id is None for r in out) == 2
    assert all(r.kept == (r.doc_id == r.class_id) for r in out if r.doc_id is not None)
    kept = neardup.representatives(df)
    assert kept.columns == df.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted([-1, -1, *set(want.values())])


def template(pairs=500, shared=884):
    """Pairs of exact similarity 0.81 among texts that all share a template and are 0.79 alike otherwise."""
    rng = random.Random(1)
    base = [f"t{rng.randrange(10**6)}" for _ in range(shared)]
    docs = []
    for k in range(pairs):
        both = [f"p{k}x{j}" for j in range(13)]
        for side in range(2):
            docs.append((2 * k + side, " ".join([*base, *both, *[f"u{k}s{side}x{j}" for j in range(102)]])))
    return docs


def test_pairs_in_a_crowd_just_below_the_threshold(spark):
    """Every bucket holds hundreds of texts, no two of which are linked but for one pair each: none may be lost."""
    docs = template()
    first = [sets(t) for _, t in docs[:3]]
    near, far = (len(first[0] & x) / len(first[0] | x) for x in first[1:])
    assert near >= 0.8 > far > 0.78
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    out = {r.doc_id: r for r in neardup.classes(df).collect()}
    assert all(out[i].class_id == i - i % 2 and out[i].n_links == 1 for i in range(len(docs)))


def test_cells_against_all_pairs(monkeypatch):
    docs = [(i, t) for i, t in template(12, 150)] + [(100 + i, "w1 w2 w3 w4 w5 w6 w7 w8 " * 3 + str(i)) for i in range(6)]
    for limit in (4, 0):  # pair by pair, and as matrices
        rows = [{"d": i, "text": t, "size": len(sets(t)), "label": i, "keys": [1, i % 3 + 10], "block": 0} for i, t in docs]
        cell = neardup.Cell(0.8)
        got = cell.linked(pa.Table.from_pylist(rows), pa.Table.from_pylist(rows if limit else rows[::-1]))
        want = sorted((a, b) for (a, s), (b, t) in itertools.combinations(docs, 2) if len(sets(s) & sets(t)) >= 0.8 * len(sets(s) | sets(t)) and min(len(sets(s)), len(sets(t))) >= 0.8 * max(len(sets(s)), len(sets(t))))
        assert got == want and want
    assert cell.linked(pa.Table.from_pylist([r | {"keys": [1]} for r in rows]), pa.Table.from_pylist([r | {"keys": [2]} for r in rows])) == []


def test_representatives_with_clashing_columns(spark):
    rows = [(1, "a b c d e f", "1", 1), (1, None, "2", 2), (1, None, "0", 2), (2, "A b  c d e f", "3", 3), (3, "x", "4", 4), (None, "x", "5", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string, row int")
    out = sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.gone, r.row) for r in neardup.representatives(df).collect())
    assert neardup.representatives(df).columns == df.columns
    assert out == [(-1, "x", "5", 5), (1, None, "0", 2), (3, "x", "4", 4)]


def test_empty(spark):
    assert neardup.classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signature_estimates_probability_jaccard():
    rng = random.Random(5)
    for changed in (0, 5, 20, 60):
        a = [f"w{rng.randrange(10**6)}" for _ in range(200)] + ["again"] * 30
        b = list(a)
        for k in rng.sample(range(200), changed):
            b[k] = "z" + b[k]
        doc, element, count = shingles.shingles([" ".join(a), " ".join(b)])
        weight = shingles.weights(count)
        signature = shingles.prob_minhash(doc, element, weight, 2, 2048)
        exact, plain = shingles.similarity(*[(element[doc == k], weight[doc == k]) for k in (0, 1)])
        assert abs((signature[0] == signature[1]).mean() - exact) < 0.05
        x, y = sets(" ".join(a)), sets(" ".join(b))
        assert abs(plain - len(x & y) / len(x | y)) < 1e-12
        keys = [np.argsort(element[doc == k]) for k in (0, 1)]
        wa, wb = ({int(element[doc == k][i]): weight[doc == k][i] for i in keys[k]} for k in (0, 1))
        brute_p = sum(1 / sum(max(wa.get(j, 0) / wa[i], wb.get(j, 0) / wb[i]) for j in {*wa, *wb}) for i in wa if i in wb)
        assert abs(brute_p - exact) < 1e-9


def test_signatures_do_not_depend_on_the_batch():
    work = neardup.Signatures()
    texts = [t or "" for _, t in corpus()[:30]]
    together = work.keys(texts)[1]
    assert all((work.keys([t])[1][0] == together[i]).all() for i, t in enumerate(texts) if t.split())


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, k) for k in range(5001, 5100)] + [(7, 7)]
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        ra, rb = sorted((root(a), root(b)))
        label[rb] = ra
    out = {r.id: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def edited(n, seed, pairs):
    """Texts of one template with six changed words each; those of a pair (2i, 2i + 1) have one change in common."""
    rng = random.Random(seed)
    base, slots = [f"w{i}" for i in range(1500)], rng.sample(range(5, 1495, 5), 298)
    edits = [{slots[(6 * i + j) % 298]: f"e{i}x{j}" for j in range(6)} for i in range(n)]
    for i in pairs:
        p, q = next(iter(edits[i])), next(iter(edits[i + 1]))
        del edits[i + 1][q]
        edits[i + 1][p] = edits[i][p]
    return [" ".join(e.get(k, w) for k, w in enumerate(base)) for e in edits]


def assert_classes(spark, texts, threshold):
    found, label = [sets(t) for t in texts], {i: i for i in range(len(texts))}
    for a, b in itertools.combinations(label, 2):
        if len(found[a] & found[b]) >= threshold * len(found[a] | found[b]):
            low, high = sorted((label[a], label[b]))
            label = {i: low if x == high else x for i, x in label.items()}
    out = neardup.classes(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA), threshold)
    assert {r.doc_id: r.class_id for r in out.collect()} == label


def test_pairs_beyond_the_leaders_of_a_large_bucket(spark):
    assert_classes(spark, edited(60, 1, range(0, 60, 2)), 0.932)


def test_no_early_stop_when_a_round_finds_nothing(spark):
    assert_classes(spark, edited(16, 49, [14]), 0.932)


def test_verification_reads_all_white_space_as_the_signatures_do():
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), "\u3000".join([*words[:-1], "z"])
    batch = pa.RecordBatch.from_pydict({"a": [1], "b": [2], "ta": [a], "tb": [b]})
    out = next(neardup.Verify()([batch]))
    assert out.column("linked").to_pylist() == [True]
