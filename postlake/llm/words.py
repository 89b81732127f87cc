"""Words of whole texts and hashes over them, worked out on flat byte buffers.

A word is a run of ASCII digits, ASCII letters (A-Z taken as a-z) and characters beyond ASCII. All bytes of
such characters are 0x80 or more, so words can be read from UTF-8 without decoding.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(seed) * _U(1 << 32)) * _U(0x9E3779B97F4A7C15))


_LOWER = np.zeros(256, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _LOWER[_b] = _b
for _b in range(0x41, 0x5B):
    _LOWER[_b] = _b + 32
_BYTE = stream(1, 256)
_PLACE = stream(2, 1 << 16) | _U(1)
_STEP = stream(3, 64) | _U(1)


class Words(NamedTuple):
    lower: np.ndarray   # bytes, lower case; 0 where no word is
    start: np.ndarray   # first byte of each word
    end: np.ndarray     # one past its last byte
    hash: np.ndarray    # 64-bit hash of each word
    first: np.ndarray   # per text (n + 1): its first word

    def text(self, i: int, j: int) -> bytes:
        """Words i to j (exclusive), lower case, one space between them."""
        return b" ".join(self.lower[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j], strict=True))


def split(buf: np.ndarray, offsets: np.ndarray) -> Words:
    lower = _LOWER[buf]
    inside = lower != 0
    before = np.zeros(len(buf), bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(buf)]
    before[edges] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(buf), bool)
    after[:-1] = inside[1:] & before[1:]
    end = np.flatnonzero(inside & ~after) + 1
    length = end - start
    hashes = np.zeros(0, _U)
    if len(start):
        at = np.cumsum(length) - length
        place = np.arange(int(length.sum())) - np.repeat(at, length)
        hashes = mix(np.add.reduceat(_BYTE[lower[inside]] * _PLACE[place & 0xFFFF], at) + length.astype(_U))
    return Words(lower, start, end, hashes, np.searchsorted(start, offsets))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; runs over text borders too, so see ``whole``."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for j in range(k):
        out += hashes[j:j + n] * _STEP[j % 64]
        if k > 1:
            out ^= out >> _U(29)
    return mix(out + _U(k))


def whole(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n shingles of k words stay inside one text."""
    ok = np.ones(max(n, 0), bool)
    for back in range(1, k):
        cut = first[1:-1] - back
        ok[cut[(cut >= 0) & (cut < n)]] = False
    return ok
