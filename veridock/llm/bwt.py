"""Which positions of many short strings begin the same ``least`` bytes, by interval expansion on a Burrows-Wheeler
transform.

The strings, each ended by its own terminator, are sorted by suffix. From the empty string on, intervals of suffixes that
share a prefix are extended backward, breadth first, one character at a time: all prefixes of length 1, then 2, and so on.
The first time an interval ends before some suffix, the common prefix of that suffix and the one before it is the length
reached. So common prefixes come by increasing value, and the expansion stops at ``least``: neighbours still undecided
share at least that much. The work depends on the runs of the transform, which repeated text makes few.
"""

from __future__ import annotations

import numpy as np

_PACKED = 7  # symbols of 9 bits in a 63-bit key


def suffix_order(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes in order. ``symbols`` are 0 for terminators; ``left`` is each position's distance to its terminator.
    Equal suffixes keep the order of their strings, as if terminators grew."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(_PACKED, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(_PACKED):
        key = (key << 9) | np.where(k <= left, padded[k : k + n], 0)
    reach, longest = _PACKED, int(left.max(initial=0)) + 1
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if reach >= longest or new[-1] == n - 1:
            break
        ahead = np.minimum(np.arange(n) + reach, n - 1)
        key = rank * (n + 1) + np.where(reach <= left, rank[ahead] + 1, 0)
        reach *= 2
    return np.argsort(rank * n + np.arange(n))


def undecided(symbols: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each place in ``order``, whether its suffix shares ``least`` symbols or more with the one before."""
    n = len(symbols)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.where(order > 0, symbols[order - 1], 0)  # the transform; 0 is never extended over
    back = place[order - 1]  # where the suffix one symbol longer stands
    starts = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
    ends = np.concatenate([starts[1:], [n]]) - 1
    run = np.repeat(np.arange(len(starts)), ends - starts + 1)
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True

    first = symbols[order]
    edges = np.flatnonzero(first[1:] != first[:-1])
    terminators = int(np.count_nonzero(symbols == 0))
    low = np.concatenate([np.arange(terminators), edges[edges >= terminators - 1] + 1])
    high = np.concatenate([np.arange(terminators), np.concatenate([edges[edges >= terminators], [n - 1]])[: len(low) - terminators]])
    known[high + 1] = True
    for _ in range(1, least):
        if not len(low):
            break
        a, b = run[low], run[high]
        one = a == b
        new_low, new_high = [], []
        pick = np.flatnonzero(one & (before[low] != 0))
        new_low.append(back[low[pick]])
        new_high.append(back[high[pick]])
        many = np.flatnonzero(~one)
        if len(many):
            count = b[many] - a[many] + 1
            of = np.repeat(many, count)
            which = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + a[of]
            symbol = before[starts[which]].astype(np.int64)
            from_, to = np.maximum(starts[which], low[of]), np.minimum(ends[which], high[of])
            real = symbol != 0
            group, from_, to = (of * 512 + symbol)[real], from_[real], to[real]
            by = np.argsort(group, kind="stable")
            group, from_, to = group[by], from_[by], to[by]
            if len(group):
                head = np.concatenate([[True], group[1:] != group[:-1]])
                tail = np.concatenate([head[1:], [True]])
                new_low.append(back[from_[head]])
                new_high.append(back[to[tail]])
        low, high = np.concatenate(new_low), np.concatenate(new_high)
        fresh = ~known[high + 1]
        low, high = low[fresh], high[fresh]
        known[high + 1] = True
    return ~known[:n]


def classes(strings: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, string number, offset) of all positions that share their next ``least`` bytes with another position."""
    size = np.array([len(s) + 1 for s in strings], np.int64)
    end = np.cumsum(size)
    symbols = np.zeros(int(end[-1]) if len(end) else 0, np.int16)
    if not len(symbols):
        return (np.zeros(0, np.int64),) * 3
    symbols[:] = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
    symbols += 1
    symbols[end - 1] = 0
    left = np.repeat(end - 1, size) - np.arange(len(symbols))
    order = suffix_order(symbols, left)
    same = undecided(symbols, order, least)
    member = same.copy()
    member[:-1] |= same[1:]
    at = order[member]
    number = np.searchsorted(end, at, side="right")
    return np.cumsum(~same)[member], number, at - (end - size)[number]
