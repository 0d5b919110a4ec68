"""Vectorised splitting and hashing of texts, shared by the text operators.

A word is a maximal run of bytes other than x20 and x09-x0D. Work goes over the
UTF-8 bytes of an Arrow string column in slices of about a megabyte, so memory
stays flat for any batch; one document is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_VALUE = _BYTE_VALUE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C13)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GRAM = _rng.integers(0, 1 << 62, 16, dtype=np.uint64) * np.uint64(4) + np.uint64(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        base = _BASE if which == "up" else _INVERSE
        steps = np.full(max(n, 2 * SLICE_BYTES), base, np.uint64)
        steps[0] = 1
        have = _powers[which] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Words:
    """The words of a run of documents: byte bounds, and where each document's words begin."""

    __slots__ = ("data", "bounds", "first", "ends", "starts")

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        solid = ~_SPACE[data]
        left = np.empty(len(data), bool)
        right = np.empty(len(data), bool)
        if len(data):
            left[1:] = ~solid[:-1]
            left[0] = True
            right[:-1] = ~solid[1:]
            right[-1] = True
            inner = bounds[(bounds > 0) & (bounds < len(data))]
            left[inner] = True
            right[inner - 1] = True
        self.starts = np.flatnonzero(solid & left)
        self.ends = np.flatnonzero(solid & right) + 1
        self.first = np.searchsorted(self.starts, bounds)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word's bytes (A-Z as a-z when lower)."""
        return span_hashes(self.data, self.starts, self.ends, lower)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def running(data: np.ndarray, lower: bool = True) -> np.ndarray:
    """Running polynomial sums, from which the hash of any span follows."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER_VALUE if lower else _BYTE_VALUE)[data] * _power("up", len(data)), out=total[1:])
    return total


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, total: np.ndarray | None = None) -> np.ndarray:
    """Hashes of byte spans by a polynomial over random byte values, finalised."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if total is None:
        total = running(data, lower)
    return mix((total[ends] - total[starts]) * _power("down", len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds) for runs of rows; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to, raw[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at]
        at = to


def grams(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of n words inside a document, and where each document's runs begin.

    A document of fewer than n words, but one at least, has the whole sequence as its one run.
    """
    count = np.diff(first)
    full = np.maximum(count - n + 1, 0)
    runs = np.where(count > 0, np.maximum(full, 1), 0)
    begin = np.zeros(len(count) + 1, np.int64)
    np.cumsum(runs, out=begin[1:])
    out = np.zeros(begin[-1], np.uint64)
    if len(words) >= n:
        joined = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            joined += words[k : len(words) - n + 1 + k] * _GRAM[k]
        doc = np.repeat(np.arange(len(count)), full)
        inside = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
        out[begin[doc] + inside] = joined[first[doc] + inside]
    for i in np.flatnonzero((count > 0) & (count < n)):
        part = words[first[i] : first[i + 1]]
        out[begin[i]] = np.append(part * _GRAM[: len(part)], _GRAM[15:] * np.uint64(len(part))).sum(dtype=np.uint64)
    return mix(out), begin


def doc_unique(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document in ascending order, and where each document's begin."""
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    counts = np.bincount(doc[keep], minlength=len(begin) - 1)
    return values[keep], np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
