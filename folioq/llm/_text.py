"""Vectorised text kernels shared by the training-data operators.

A batch of texts becomes one byte array; words are found with array operations
and hashed with a polynomial over Z/2^64, so no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = 0xD6E8FEB86659FD93 | 1
_INV = {base: pow(base, -1, 1 << 64) for base in (_BASE, _GRAM)}
_POW: dict[int, np.ndarray] = {}

#: Bytes that separate words: ASCII white space and control characters.
SPACE = np.zeros(256, bool)
SPACE[:33] = True
SPACE[127] = True

#: Characters that the kernels take at once (a longer text stands alone); their arrays are some hundred times that.
SLICE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), np.uint64(base))
        step[0] = 1
        _POW[base] = have = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of values[start:end] for each pair of bounds; equal slices get equal hashes."""
    n = len(values)
    p = powers(base, n + 1)
    acc = np.zeros(n + 1, np.uint64)
    np.cumsum(values.astype(np.uint64, copy=False) * p[:n], out=acc[1:])
    # Shifting by base**-start makes equal slices comparable.
    return mix((acc[end] - acc[start]) * powers(_INV[base], n + 1)[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words of a batch: `doc` is the text's index, `start`/`end` are byte bounds in `data`."""

    data: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    offset: np.ndarray  # bytes: text i is data[offset[i]:offset[i + 1] - 1]
    first: np.ndarray  # words: text i has words first[i]:first[i + 1]


def as_bytes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """One byte array with a separator after each text, and the offsets. A null counts as empty."""
    raw = [b"" if t is None else t.encode("utf-8", "replace") for t in texts]
    offset = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=offset[1:])
    return np.frombuffer(b"\n".join(raw) + b"\n", np.uint8) if raw else np.zeros(0, np.uint8), offset


def words(texts: list, lower: bool = True, hashed: bool = True, space: np.ndarray = SPACE) -> Words:
    """Words (maximal runs of bytes that are not in `space`) of each text, with hashes."""
    data, offset = as_bytes([t and t.lower() for t in texts] if lower else texts)
    inside = ~space[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    doc = np.searchsorted(offset, start, "right") - 1
    h = range_hash(data, start, end) if hashed else np.zeros(0, np.uint64)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    return Words(data, doc, start, end, h, offset, first)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n words within a text, and the index of its first word."""
    m = len(w.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.doc[:m] == w.doc[n - 1 :])
    return range_hash(w.hash, at, at + n, _GRAM), at


def slices(lengths: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive slices of rows whose lengths sum to about `most`; a longer row stands alone."""
    lo, total = 0, 0
    for i, n in enumerate(lengths):
        if i > lo and total + n > most:
            yield slice(lo, i)
            lo, total = i, 0
        total += int(n)
    if lo < len(lengths):
        yield slice(lo, len(lengths))
