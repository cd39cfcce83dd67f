"""Vectorised 64-bit hashes of the words of many texts."""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20_011))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a hash: every bit of the result depends on every bit of ``h``."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32))


def _places(n: int) -> np.ndarray:
    """Odd multipliers for the first ``n`` places of a word, the same ones at every call."""
    if n <= len(_PLACE):
        return _PLACE[:n]
    return np.concatenate([_PLACE, mix(np.arange(len(_PLACE), n, dtype=np.uint64)) | np.uint64(1)])


def word_hashes(texts: list[bytes], prefix: int | None = None):
    """Hashes of the words of all texts in a row, and the number of words of each text.

    Words are runs of bytes other than the space; ``texts`` have every separator
    mapped to it. With ``prefix``, also hashes of the first so many bytes.
    """
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    word = data != 32
    if not word.any():
        none = np.empty(0, np.uint64)
        counts = np.zeros(len(texts), np.int64)
        return (none, counts) if prefix is None else (none, counts, none)
    edge = np.diff(word.astype(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    ends = np.flatnonzero(edge == -1)  # the buffer ends in a space
    lengths = ends - starts
    inside = np.flatnonzero(word)
    place = np.arange(len(inside)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    parts = _BYTE[data[inside]] * _places(int(lengths.max()))[place]
    parts ^= parts >> np.uint64(31)
    at = np.cumsum(lengths) - lengths
    hashes = mix(np.add.reduceat(parts, at) + lengths.astype(np.uint64))
    size = np.array([len(t) + 1 for t in texts])
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(size)]))
    counts = np.diff(bounds)
    if prefix is None:
        return hashes, counts
    parts[place >= prefix] = 0
    return hashes, counts, mix(np.add.reduceat(parts, at) + np.uint64(prefix << 32))
