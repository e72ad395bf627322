"""Run-length index of a small text collection, and matching statistics streamed over it.

The collection's suffixes are sorted by prefix doubling, and its Burrows-Wheeler transform is cut into
runs of equal symbols. Suffix-array samples are kept at the two ends of every run only. The longest match
of a text position with the suffix before (after) it in order is found by comparing texts at run starts
(run ends); everywhere else the value of the position to the left, less one, is exact, so that streaming
over the text from left to right gives the matching statistics of all positions.
"""

from __future__ import annotations

import numpy as np

END = 0xFF  # never part of UTF-8


def packed(data: np.ndarray) -> np.ndarray:
    """Big-endian numbers of the eight bytes from each position; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | padded[k : k + len(data)]
    return out


def suffix_array(data: np.ndarray, keys: np.ndarray) -> np.ndarray:
    n = len(data)
    order = np.argsort(keys, kind="stable")
    rank = np.zeros(n + 1, np.int64)
    rank[n] = 0
    changed = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    first = np.maximum.accumulate(np.where(changed, np.arange(n), 0))
    rank[order] = first + 1
    step = 8
    while True:
        alone = changed & np.append(changed[1:], True)
        open_ = np.flatnonzero(~alone)  # places in the order whose group has several members
        if not len(open_):
            return order
        at = order[open_]
        key = rank[at] << 32 | rank[np.minimum(at + step, n)]
        again = np.argsort(key, kind="stable")
        at, key = at[again], key[again]
        order[open_] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        changed[open_] = new
        rank[at] = open_[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))] + 1
        step *= 2


def common_prefix(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at a and at b (different positions)."""
    n = len(keys)
    out = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    step = 0
    while len(open_):
        i, j = a[open_] + step, b[open_] + step
        inside = (i < n) & (j < n)
        differ = np.ones(len(open_), np.uint64)
        differ[inside] = keys[i[inside]] ^ keys[j[inside]]
        ended = differ != 0
        top = np.zeros(len(open_), np.int64)
        value = differ.copy()
        for bits in (32, 16, 8):
            high = value >> np.uint64(64 - bits) == 0
            top[high] += bits // 8
            value[high] <<= np.uint64(bits)
        out[open_] = step + np.where(ended, np.where(inside, top, 0), 8)
        open_ = open_[~ended]
        step += 8
    return out


def matching_statistics(texts: list[bytes]) -> list[np.ndarray]:
    """For each position of each text the length of its longest match that starts anywhere else."""
    if not texts:
        return []
    parts, starts, total = [], [], 0
    for i, t in enumerate(texts):
        # The number after the end mark keeps all suffixes different.
        tail = bytes([END, *(1 + i // 200**k % 200 for k in range(4))])
        parts += [t, tail]
        starts.append(total)
        total += len(t) + len(tail)
    data = np.frombuffer(b"".join(parts), np.uint8)
    keys = packed(data)
    order = suffix_array(data, keys)
    n = len(data)
    before = np.where(order > 0, data[order - 1], 256).astype(np.int64)  # the transform
    heads = np.concatenate([[True], before[1:] != before[:-1]])
    heads[order == 0] = True
    tails = np.append(heads[1:], True)
    after_zero = np.flatnonzero(order == 0)
    tails[after_zero] = True
    at = np.arange(n)
    best = np.zeros(n, np.int64)
    for ends, shift in ((heads, -1), (tails, 1)):
        place = np.flatnonzero(ends)
        place = place[(place + shift >= 0) & (place + shift < n)]
        sample = np.zeros(n, np.int64)
        sample[order[place]] = common_prefix(keys, order[place], order[place + shift])
        best = np.maximum(best, np.maximum.accumulate(sample + at) - at)
    ends = np.array([s + len(t) for s, t in zip(starts, texts, strict=True)])
    return [np.minimum(best[s:e], e - at[s:e]) for s, e in zip(starts, ends, strict=True)]
