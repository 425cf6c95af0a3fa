"""Vectorised 64-bit hashing of words, shingles and byte windows (numpy, whole texts, no per-word Python)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
#: Blanks where words are runs of ASCII letters, digits and non-ASCII characters.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, element-wise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_RAW = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_LOWER = _RAW.copy()
_LOWER[65:91] = _RAW[97:123]
_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, CHUNK + 1)
        for key, base in (("p", _BASE), ("q", _BASE_INV)):
            seq = np.full(size, base, np.uint64)
            seq[0] = 1
            _powers[key] = np.multiply.accumulate(seq)
    return _powers["p"][:n], _powers["q"][:n]


def prefix_sums(data: np.ndarray, table: np.ndarray = _RAW) -> np.ndarray:
    """S with S[j]-S[i] = sum of table[data[t]] * base**t over i <= t < j (mod 2**64)."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum(table[data] * _pow(len(data))[0], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span, independent of where it stands."""
    inverse = _pow(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _chunks(blobs: list[bytes]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(blobs):
        j, size = i, 0
        while j < len(blobs) and (j == i or size + len(blobs[j]) + 1 <= CHUNK):
            size += len(blobs[j]) + 1
            j += 1
        yield i, j
        i = j


def word_hashes(blobs: list[bytes], blanks: np.ndarray = _WS) -> Iterator[np.ndarray]:
    """Per text: hashes of its words (by default [^\\x20\\x09-\\x0D]+) with A-Z lower-cased, in order."""
    for i, j in _chunks(blobs):
        data = np.frombuffer(b" ".join(blobs[i:j]) + b" ", np.uint8)
        blank = blanks[data]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            edge = np.concatenate(([0], edge))
        starts, ends = edge[0::2], edge[1::2]
        hashed = span_hashes(prefix_sums(data, _LOWER), starts, ends)
        limits = np.cumsum([len(b) + 1 for b in blobs[i:j]])
        cut = np.searchsorted(starts, limits)
        at = 0
        for c in cut:
            yield hashed[at:c]
            at = c


_MULT = [np.uint64(x | 1) for x in mix(np.arange(1000, 1064, dtype=np.uint64)).tolist()]


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words, in order; a shorter non-empty text gives one for the whole sequence."""
    n = len(words)
    if n == 0:
        return words
    k = min(width, n)
    total = np.full(n - k + 1, np.uint64(k), np.uint64)
    for t in range(k):
        total += words[t : n - k + 1 + t] * _MULT[t]
    return mix(total)
