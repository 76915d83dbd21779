"""Simple-8b: integers packed into 64-bit words, vectorised both ways.

A word is a 4-bit selector (high bits) and 60 data bits, the first value
lowest. Selectors 1 to 14 mean so many values of so many bits each. Selector
15 is an escape: the next word is one whole 64-bit value. Values are cut into
blocks of BLOCK; the word offset of each block is kept, so blocks are decoded
on their own or all at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: (values, bits) of selectors 1 to 14.
LAYOUT = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
_COUNT = np.array([0, *(n for n, _ in LAYOUT), 1])


#: Bits of each value below 2^16, 1 at least.
_SHORT = np.array([max(1, v.bit_length()) for v in range(1 << 16)], np.uint8)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value, 1 at least."""
    most = int(values.max(initial=0)).bit_length()
    if most <= 16:
        return _SHORT[values.astype(np.uint16)]
    out = np.ones(len(values), np.uint8)
    for bits in range(1, most):
        out += values >> np.uint64(bits) != 0
    return out


def _choices(widths: np.ndarray) -> np.ndarray:
    """Selector with the most values that fit, from each position of each block (row) on."""
    blocks, n = widths.shape
    padded = np.full((blocks, n + LAYOUT[0][0]), 255, np.uint8)  # nothing fits across a block's end
    padded[:, :n] = widths
    chosen = np.full((blocks, n), ESCAPE, np.uint8)
    widest, have = padded, 1  # the widest of so many values from each position on
    for k in range(len(LAYOUT), 0, -1):
        count, bits = LAYOUT[k - 1]
        while have < count:
            step = min(have, count - have)
            ahead = np.full_like(widest, 255)
            ahead[:, :-step] = widest[:, step:]
            widest, have = np.maximum(widest, ahead), have + step
        chosen[widest[:, :n] <= bits] = k
    return chosen


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words uint64, word offset of each block) of unsigned 64-bit values."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.array([], np.uint64), np.array([], np.int64)
    start = np.arange(0, n, BLOCK)
    end = np.minimum(start + BLOCK, n)
    widths = np.full(len(start) * BLOCK, 255, np.uint8)
    widths[:n] = _widths(values)
    chosen = _choices(widths.reshape(-1, BLOCK)).ravel()[:n]
    step = _COUNT[chosen]
    taken, cursor, lane = np.zeros(n, bool), start.copy(), np.arange(len(start))
    while len(lane):  # all blocks walk their chain of words together
        taken[cursor[lane]] = True
        cursor[lane] += step[cursor[lane]]
        lane = lane[cursor[lane] < end[lane]]
    first = np.flatnonzero(taken)
    selector = chosen[first]
    size = 1 + (selector == ESCAPE)
    where = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    words[where] = selector.astype(np.uint64) << np.uint64(60)
    for k, (count, bits) in enumerate(LAYOUT, 1):
        own = np.flatnonzero(selector == k)
        for j in range(count if len(own) else 0):
            words[where[own]] |= values[first[own] + j] << np.uint64(j * bits)
    raw = np.flatnonzero(selector == ESCAPE)
    words[where[raw] + 1] = values[first[raw]]
    return words, where[np.searchsorted(first, start)]


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n values of encode()'s result."""
    words = np.ascontiguousarray(words, np.uint64)
    if not n:
        return np.array([], np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    head = np.ones(len(words), bool)
    if (selector == ESCAPE).any() or (selector == 0).any():
        # A raw word may look like any selector: walk the blocks together.
        head[:] = False
        cursor, end = offsets.astype(np.int64).copy(), np.append(offsets[1:], len(words)).astype(np.int64)
        lane = np.arange(len(cursor))
        while len(lane):
            head[cursor[lane]] = True
            cursor[lane] += 1 + (selector[cursor[lane]] == ESCAPE)
            lane = lane[cursor[lane] < end[lane]]
    at = np.flatnonzero(head)
    selector = selector[at]
    count = _COUNT[selector]
    where = np.cumsum(count) - count
    out = np.empty(n, np.uint64)
    for k, (size, bits) in enumerate(LAYOUT, 1):
        own = np.flatnonzero(selector == k)
        mask = np.uint64((1 << bits) - 1)
        for j in range(size if len(own) else 0):
            out[where[own] + j] = (words[at[own]] >> np.uint64(j * bits)) & mask
    raw = np.flatnonzero(selector == ESCAPE)
    out[where[raw]] = words[at[raw] + 1]
    return out


def decode_block(words: np.ndarray, offsets: np.ndarray, n: int, block: int) -> np.ndarray:
    """One block's values, without touching the other words."""
    a = int(offsets[block])
    b = int(offsets[block + 1]) if block + 1 < len(offsets) else len(words)
    return decode(words[a:b], np.array([0]), min(BLOCK, n - block * BLOCK))
