"""XXH64 of many short byte strings at once, as the published algorithm defines it."""

from __future__ import annotations

import numpy as np

from tablewise.llm.common import by_value

by_value(__name__)

# Fixed values of the algorithm.
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(data: bytes, start: np.ndarray, stop: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of ``data[start[i]:stop[i]]``."""
    old = np.seterr(over="ignore")
    padded = np.frombuffer(data + bytes(8), np.uint8)
    quad = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    word = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    s, length, at = np.uint64(seed), (stop - start).astype(np.int64), start.astype(np.int64)
    h = np.full(len(at), s + P5, np.uint64)
    at = at.copy()
    left = length.copy()
    big = np.flatnonzero(length >= 32)
    if len(big):
        p, n = at[big], length[big] // 32
        v = [np.full(len(big), x, np.uint64) for x in (s + P1 + P2, s + P2, s, s - P1)]
        for k in range(int(n.max())):
            on = np.flatnonzero(n > k)
            for i in range(4):
                v[i][on] = _round(v[i][on], quad[p[on] + 32 * k + 8 * i])
        acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for x in v:
            acc = (acc ^ _round(np.uint64(0), x)) * P1 + P4
        h[big] = acc
        at[big] += 32 * n
        left[big] -= 32 * n
    h += length.astype(np.uint64)
    for _ in range(3):
        on = np.flatnonzero(left >= 8)
        h[on] = _rotl(h[on] ^ _round(np.uint64(0), quad[at[on]]), 27) * P1 + P4
        at[on] += 8
        left[on] -= 8
    on = np.flatnonzero(left >= 4)
    h[on] = _rotl(h[on] ^ (word[at[on]].astype(np.uint64) * P1), 23) * P2 + P3
    at[on] += 4
    left[on] -= 4
    for _ in range(3):
        on = np.flatnonzero(left > 0)
        h[on] = _rotl(h[on] ^ (padded[at[on]].astype(np.uint64) * P5), 11) * P1
        at[on] += 1
        left[on] -= 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    np.seterr(**old)
    return h ^ (h >> np.uint64(32))
