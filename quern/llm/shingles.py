"""Word shingle sets of texts as sorted 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import numpy as np

from .common import mix64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEEDS = mix64(np.arange(1, 65, dtype=np.uint64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            row = np.full(max(n, 1 << 20), base, np.uint64)
            row[0] = 1
            _powers[i] = np.multiply.accumulate(row)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(raw: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and each text's first word (n + 1 numbers).

    A word is a run of bytes that are not ``gaps`` (ASCII white space), A-Z lower-cased.
    """
    hashes, first, _ = beginnings(raw, offsets, (0,), gaps)
    return hashes[0], first


def beginnings(raw: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...], gaps: np.ndarray = _SPACE) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each of ``sizes`` the hashes of all words' first so many bytes (0: whole words).

    Also each text's first word (n + 1 numbers), and the words' lengths.
    """
    if not len(raw):
        return [np.zeros(0, np.uint64) for _ in sizes], np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    solid = ~gaps[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = solid[begins]
    starts = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[begins[begins > 0] - 1] = solid[begins[begins > 0] - 1]
    ends = np.flatnonzero(last) + 1
    up, down = _power(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LOWER[raw].astype(np.uint64) * up, out=sums[1:])
    base, scale, out = sums[starts], down[starts], []
    for most in sizes:
        to = np.minimum(ends, starts + most) if most else ends
        out.append(mix64((sums[to] - base) * scale + (to - starts).astype(np.uint64) * _SEEDS[63]))
    return out, np.searchsorted(starts, offsets), ends - starts


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text of fewer than ``width`` words has its whole sequence as one shingle;
    one without words has none.
    """
    words, first = word_hashes(raw, offsets)
    runs = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        runs += words[j : len(words) - width + 1 + j] * _SEEDS[j]
    runs = mix64(runs)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        if n >= width:
            own = np.sort(runs[a : b - width + 1])
            keep = np.empty(len(own), bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif n:
            out.append(mix64((words[a:b] * _SEEDS[8 : 8 + n]).sum(keepdims=True) + _SEEDS[32 + n]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
