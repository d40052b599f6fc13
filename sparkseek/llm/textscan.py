"""Words of many texts at once, with numpy: places, hashes of words and of runs of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Bytes of text that are scanned at once; a longer text is scanned alone.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD1B54A32D192ED03)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _BASE modulo 2**64 and of its inverse."""
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Scan:
    """data: the texts' bytes; text t has the words first[t] up to first[t + 1], word w the bytes begin[w] up to end[w]."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        size = 1 << max(SLICE_BYTES.bit_length(), int(len(self.data)).bit_length())
        power, inverse = _powers(size)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)], out=total[1:])
        own = (total[self.end] - total[self.begin]) * inverse[self.begin]
        return mixed(own + (self.end - self.begin).astype(np.uint64) * _STEP)


def scan(texts: pa.Array) -> Scan:
    """The words of a string or binary array without nulls; A-Z as they are."""
    buffers, n = texts.buffers(), len(texts)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(buffers[1], kind, n + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    gap = np.ones(len(data) + 1, bool)  # gap[i]: byte i is no part of a word; one more at the end
    gap[:-1] = _SPACE[data]
    start = ~gap[:-1]
    stop = start.copy()
    start[1:] &= gap[:-2]
    stop &= gap[1:]
    for edge in (offsets[:-1], offsets[1:]):  # words end where texts do
        edge = edge[(edge > 0) & (edge < len(data))]
        start[edge] = ~gap[edge]
        stop[edge - 1] = ~gap[edge - 1]
    begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return Scan(data, begin, end, np.searchsorted(begin, offsets))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive words, also where they are of two texts; k - 1 fewer than words."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    out, length, factor = hashes, 1, _STEP
    with np.errstate(over="ignore"):
        pieces, at = None, 0
        while True:
            if k & length:  # append this power of two to what there is
                if pieces is None:
                    pieces, at = out, length
                else:
                    n = len(hashes) - (at + length) + 1
                    pieces, at = pieces[:n] * factor + out[at : at + n], at + length
            if length * 2 > k:
                break
            n = len(out) - length
            out, length, factor = out[:n] * factor + out[length : length + n], length * 2, factor * factor
    return mixed(pieces + np.uint64(k))


def slices(batch: pa.RecordBatch, *text_columns: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size`` bytes of text."""
    sizes = sum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(c)), 0), np.int64) for c in text_columns)
    part = np.cumsum(sizes) // size
    edges = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *edges], [*edges, batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)
