"""Vectorised text kernels: white-space words, their 64-bit hashes and byte n-grams over slices of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel handles at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(items: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of about the limit in bytes."""
    first = total = 0
    for i, x in enumerate(items):
        if total and total + len(x) > limit:
            yield first, i
            first, total = i, 0
        total += len(x) + 1
    if first < len(items):
        yield first, len(items)


class Words:
    """White-space words of a run of texts: hash and text number of each."""

    def __init__(self, items: list[bytes], lower: bool = True):
        joined = b"\n".join(items) + b"\n"
        if lower:
            joined = joined.translate(LOWER)
        self.data = data = np.frombuffer(joined, np.uint8)
        ends = np.cumsum(np.fromiter((len(x) + 1 for x in items), np.int64, len(items)))
        word = ~_IS_SPACE[data]
        before = np.empty_like(word)
        before[0], before[1:] = False, word[:-1]
        self.starts = starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(before & ~word)
        self.doc = np.searchsorted(ends, starts, side="right")
        self.per_doc = np.bincount(self.doc, minlength=len(items))
        if len(starts):
            at = np.zeros(len(data), np.int64)
            at[starts] = starts
            at = np.arange(len(data)) - np.maximum.accumulate(at)
            longest = int((self.ends - starts).max())
            power = np.cumprod(np.full(longest + 1, _BASE, np.uint64))
            value = _BYTE[data] * power[np.minimum(at, longest)]
            value[~word] = 0
            self.hash = mix(np.add.reduceat(value, starts) ^ (self.ends - starts).astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)


_STEP = np.cumprod(np.full(8, np.uint64(0xD6E8FEB86659FD93), np.uint64))


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each n-word shingle; a text of fewer words gives its whole sequence, one without words gives none."""
    h, doc = words.hash, words.doc
    out_h, out_d = [], []
    if len(h) >= n:
        m = len(h) - n + 1
        s = np.zeros(m, np.uint64)
        for k in range(n):
            s += h[k : k + m] * _STEP[k]
        same = doc[:m] == doc[n - 1 :]
        out_h.append(mix(s[same]))
        out_d.append(doc[:m][same])
    short = np.flatnonzero((words.per_doc > 0) & (words.per_doc < n))
    if len(short):
        first = np.searchsorted(doc, short)
        s = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = words.per_doc[short] > k
            s[has] += h[first[has] + k] * _STEP[k]
        out_h.append(mix(s ^ mix(words.per_doc[short].astype(np.uint64))))
        out_d.append(short)
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hs, ds = np.concatenate(out_h), np.concatenate(out_d)
    order = np.argsort(ds, kind="stable")
    return hs[order], ds[order]
