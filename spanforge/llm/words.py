"""Vectorised hashes of the words of a text: runs of anything but the six ASCII blanks."""

from __future__ import annotations

import numpy as np

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> None:
    size = 1 << max(12, n.bit_length())
    for k, base in enumerate((_STEP, _BACK)):
        factors = np.full(size, base, dtype=np.uint64)
        factors[0] = 1
        _powers[k] = np.multiply.accumulate(factors)


def powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers, or more, of an odd factor and of its inverse modulo 2**64."""
    if n > len(_powers[0]):
        _grow(n)
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str | None, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased unless ``fold`` is off, in text order."""
    raw = (text or "").encode()
    data = np.frombuffer(raw.lower() if fold else raw, dtype=np.uint8)
    if not len(data):
        return np.empty(0, dtype=np.uint64)
    if len(data) >= len(_powers[0]):
        _grow(len(data))
    solid = ~_BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _powers[0][: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct hashes of runs of ``width`` words, rising; fewer words make one run; no words, none."""
    w = word_hashes(text)
    if not len(w):
        return w
    width = min(width, len(w))
    n = len(w) - width + 1
    h = w[:n].copy()
    for j in range(1, width):
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h += w[j : j + n]
    return np.unique(mixed(h + np.uint64(width)))
