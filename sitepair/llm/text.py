"""Vectorised words and word hashes of UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D, the same runs as ``bytes.split()`` gives.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_A, _B, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _A
    x = (x ^ (x >> _U(27))) * _B
    return x ^ (x >> _U(31))


def spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word."""
    space = np.empty(len(data) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = _SPACE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word, eight bytes a step."""
    if not len(starts):
        return np.empty(0, np.uint64)
    eight = np.ndarray((len(data) + 1,), "<u8", data + b"\0" * 8, 0, (1,))
    length = (ends - starts).astype(np.int64)
    h = mix(length.astype(np.uint64) * _G + _U(seed))
    h = mix(h ^ (eight[starts] & _MASK[np.minimum(length, 8)]))
    at = np.flatnonzero(length > 8)
    step = 8
    while at.size:
        h[at] = mix(h[at] * _G ^ (eight[starts[at] + step] & _MASK[np.minimum(length[at] - step, 8)]))
        step += 8
        at = at[length[at] > step]
    return h


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out + h[j : j + n]) * _G
        out ^= out >> _U(32)
    return mix(out)
