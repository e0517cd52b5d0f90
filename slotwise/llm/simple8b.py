"""Simple-8b coding of unsigned integers into 64-bit words.

A word's top 4 bits select how its other 60 bits are cut. Selector 0 is the escape: the next word
holds one value raw, for values of over 60 bits. All other words of a block can be decoded at once:
the selectors give each word's count, a running sum gives where its values go.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the code: selector -> (values in a word, bits of each).
SELECTORS = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60)}
ESCAPE = 0
_COUNT = np.zeros(16, dtype=np.int64)
for _s, (_c, _b) in SELECTORS.items():
    _COUNT[_s] = _c
_SELECTOR_OF = {c: s for s, (c, _) in SELECTORS.items()}


def encode(values: np.ndarray) -> np.ndarray:
    """The words that hold values (unsigned, any length); greedy, each word takes as many as it can."""
    v = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    count = np.ones(n, dtype=np.uint8)
    wide = v >= np.uint64(1 << 60)
    for c, bits in sorted(SELECTORS.values()):
        if c == 1:
            continue
        ok = v < np.uint64(1 << bits)
        if not ok.any():
            break
        ok = np.concatenate([ok, np.ones(c - 1, dtype=bool)])  # beyond the end there is only padding
        have = 1
        while have < c:  # ok[i] becomes: the next c values all fit
            step = min(have, c - have)
            ok = ok[:-step] & ok[step:]
            have += step
        count[ok[:n]] = c
    steps, at, i = count.tobytes(), [], 0
    while i < n:
        at.append(i)
        i += steps[i]
    starts = np.array(at, dtype=np.int64)
    counts, raw = count[starts], wide[starts]
    slots = np.cumsum(1 + raw) - 1 - raw  # an escaped value takes a word more
    words = np.zeros(len(starts) + int(raw.sum()), dtype=np.uint64)
    padded = np.concatenate([v, np.zeros(60, dtype=np.uint64)])
    for c in np.unique(counts):
        s = _SELECTOR_OF[int(c)]
        bits = SELECTORS[s][1]
        mine = (counts == c) & ~raw
        p = starts[mine]
        w = np.full(len(p), s << 60, dtype=np.uint64)
        for j in range(int(c)):
            w |= padded[p + j] << np.uint64(bits * j)
        words[slots[mine]] = w
    words[slots[raw] + 1] = v[starts[raw]]  # the escape itself is a word of zeros
    return words


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The n values that encode() put into words."""
    w = np.ascontiguousarray(words, dtype=np.uint64)
    selectors = (w >> np.uint64(60)).astype(np.int64)
    raw_at = np.zeros(0, dtype=np.int64)
    if (selectors == ESCAPE).any():
        # A raw word can look like anything, so escapes are told apart from the front.
        zero, found, last = np.flatnonzero(w == 0), [], -2
        for z in zero.tolist():
            if z != last + 1:
                found.append(z + 1)
                last = z
        raw_at = np.array(found, dtype=np.int64)
    counts = _COUNT[selectors]
    counts[raw_at] = 1
    counts[raw_at - 1] = 0
    is_raw = np.zeros(len(w), dtype=bool)
    is_raw[raw_at] = True
    begin = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    for s, (c, bits) in SELECTORS.items():
        mine = np.flatnonzero((selectors == s) & ~is_raw)
        if len(mine):
            at, x, mask = begin[mine], w[mine], np.uint64((1 << bits) - 1)
            for j in range(c):
                out[at + j] = (x >> np.uint64(bits * j)) & mask
    out[begin[raw_at]] = w[raw_at]
    return out[:n]
