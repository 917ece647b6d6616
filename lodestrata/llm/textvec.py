"""Vectorised text primitives on Arrow batches: word spans and hashes without Python strings.

Texts are handled as one UTF-8 byte buffer per slice of a batch. A slice ends after
``SLICE_BYTES`` bytes or with a single longer text, so memory follows the longest text,
never the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {}

#: Bytes that separate words: space and U+0009 to U+000D.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that may be part of a plain word: ASCII letters and digits, and all of non-ASCII.
LETTER = np.zeros(256, dtype=bool)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    LETTER[_lo:_hi] = True


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= SLICE_BYTES + 1:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads every input bit over the word."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first row, end row, bytes, offsets)`` for bounded runs of rows; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


#: Longer spans are hashed byte by byte: a polynomial modulo 2**64 can be equal for long regular ones.
LONG_SPAN = 64


class Hasher:
    """Hashes of any byte spans of one buffer, in constant time a span of up to ``LONG_SPAN`` bytes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data) + 1)[:-1], dtype=np.uint64, out=self.sums[1:])
        self.back = _power(_BASE_INV, len(data) + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = mix((self.sums[ends] - self.sums[starts]) * self.back[starts])
        for i in np.flatnonzero(ends - starts > LONG_SPAN).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.data[starts[i] : ends[i]].tobytes())
        return out


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes with ``inside``, cut at row borders."""
    word = inside[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] |= word[cuts]
    last = word.copy()
    last[:-1] &= ~word[1:]
    before = cuts[cuts > 0] - 1
    last[before] |= word[before]
    return np.flatnonzero(first), np.flatnonzero(last) + 1
