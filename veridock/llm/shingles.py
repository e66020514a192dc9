"""Word shingles and weighted minhash, vectorised over a batch of texts.

Words are what white space separates, in lower case; a shingle is five consecutive words, and a text with fewer words has
one shingle of them all. A shingle's weight grows slowly with how often it occurs.
"""

from __future__ import annotations

import numpy as np

WORDS = 5

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C55)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, text number of each)"""
    # a byte order of one blank between texts keeps their words apart
    parts = [(t or "").lower().encode("utf-8", "replace") + b" " for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers(_BASE, len(data)), dtype=np.uint64)])
    inverse = powers(_INVERSE, len(data))
    hashed = mix(((summed[end] - summed[start]) * inverse[start]) ^ ((end - start).astype(np.uint64) << _U(40))) if len(start) else np.zeros(0, np.uint64)
    ends = np.cumsum([len(p) for p in parts])
    return hashed, np.searchsorted(ends, start, side="right")


def shingles(texts: list[str | None], n_words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count) of all distinct shingles, sorted by text number and hash."""
    hashed, owner = words(texts)
    count = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    first = np.concatenate([[0], np.cumsum(count)])[:-1].astype(np.int64)
    number = np.where(count >= n_words, count - n_words + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(texts)), number)
    if not len(doc):
        return doc, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(number)])[:-1], number) + first[doc]
    total = np.zeros(len(doc), np.uint64)
    left = first[doc] + count[doc] - at
    for k in range(n_words):
        here = np.where(k < left, hashed[np.minimum(at + k, len(hashed) - 1)], _U(0))
        total = mix(total * _U(0x2545F4914F6CDD1D) + here + _U(k + 1))
    order = np.lexsort((total, doc))
    doc, total = doc[order], total[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (total[1:] != total[:-1])])
    where = np.flatnonzero(new)
    return doc[where], total[where], np.diff(np.concatenate([where, [len(doc)]]))


def weights(count: np.ndarray) -> np.ndarray:
    """A repeated shingle weighs little more than one that occurs once."""
    return 1.0 + np.log(count) / 4.0


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, size: int, seed: int = 1) -> np.ndarray:
    """ProbMinHash signatures, ``n_docs`` x ``size``: the element that arrives first in each register.

    An element of weight w arrives as a Poisson process of rate w, each arrival in a random register. Arrivals are drawn
    round by round for all elements; one whose next arrival comes after the latest register of its text was filled can no
    longer win anywhere and stops. Two registers agree with the probability Jaccard similarity of the texts. Texts
    without elements get zeros."""
    earliest, winner = np.full(n_docs * size, np.inf), np.zeros(n_docs * size, np.uint64)
    at, step = np.zeros(len(doc)), 0
    while len(doc):
        drawn = mix(element + _U((step * 0x9E3779B97F4A7C15 + seed * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF))
        at = at - np.log(((drawn >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53) / weight
        register = ((mix(drawn ^ _U(0xA24BAED4963EE407)) >> _U(32)) * _U(size)) >> _U(32)
        slot = doc * size + register.astype(np.int64)
        near = at < earliest[slot]
        np.minimum.at(earliest, slot[near], at[near])
        won = near & (at == earliest[slot])
        winner[slot[won]] = element[won]
        live = at < earliest.reshape(n_docs, size).max(axis=1)[doc]
        doc, element, weight, at = doc[live], element[live], weight[live], at[live]
        step += 1
    return winner.reshape(n_docs, size)


def bands(signature: np.ndarray, n_bands: int) -> np.ndarray:
    """One key for each band of registers, distinct between bands."""
    n, size = signature.shape
    rows = signature.reshape(n, n_bands, size // n_bands)
    key = np.broadcast_to(np.arange(1, n_bands + 1, dtype=np.uint64), (n, n_bands)).copy()
    for k in range(rows.shape[2]):
        key = mix(key * _U(0x2545F4914F6CDD1D) + rows[:, :, k])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """(probability Jaccard of the weights, Jaccard of the sets) of two (sorted hashes, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0, 0.0
    _, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    plain = len(ia) / (len(a[0]) + len(b[0]) - len(ia))
    x, y = a[1][ia].astype(float), b[1][ib].astype(float)
    sum_a, sum_b, total = float(a[1].sum()), float(b[1].sum()), 0.0
    ratios, which = np.unique(x / y, return_inverse=True)
    for k, t in enumerate(ratios):  # elements of one ratio share the denominator
        spread = (sum_a - x.sum()) + t * (sum_b - y.sum()) + np.maximum(x, t * y).sum()
        total += float(x[which == k].sum()) / spread
    return total, plain
