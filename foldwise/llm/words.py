"""Words of whole texts as numpy arrays, many documents at a time.

A word is a run of bytes other than the space and 0x09-0x0D.  Texts come from
Arrow string columns, whose data buffer already is one byte array; every function
here works on the words of a slice of documents at once, without a loop per word.
Hashes are 64-bit and depend on the word alone, so that they agree over tasks.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: The word pattern for regular expressions of Spark, DuckDB and Python.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes handled at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20
#: The same for steps whose results are those of each document, so that a worker needs half of the memory.
SMALL_SLICE_BYTES = 1 << 19

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 - 16  # odd, and 5 modulo 8: powers have the longest period


def constants(seed: int, n: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE_CODES = constants(11, 256)
PLACE = constants(12, 64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.full(n, _BASE | 1, dtype=np.uint64)
    inverse = np.full(n, pow(_BASE | 1, -1, 1 << 64), dtype=np.uint64)
    base[:1] = inverse[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(base), np.multiply.accumulate(inverse)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of an odd number modulo 2^64, and their inverses."""
    return _powers(1 << max(20, int(n - 1).bit_length() if n else 0))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of a slice: ``start`` and ``stop`` bytes, ``hash``, ``first`` (word offset per document)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool):
        n = len(data)
        word = ~_SEPARATOR[data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[bounds] = True
        before = np.empty(n, dtype=bool)
        before[:1] = True
        before[1:] = ~word[:-1]
        self.start = np.flatnonzero(word & (before | cut[:-1]))
        after = np.empty(n, dtype=bool)
        after[-1:] = True
        after[:-1] = ~word[1:]
        self.stop = np.flatnonzero(word & (after | cut[1:])) + 1
        up, down = powers(n)
        codes = _BYTE_CODES[_LOWER] if lower else _BYTE_CODES
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(codes[data] * up[:n], out=sums[1:])
        self.hash = mix((sums[self.stop] - sums[self.start]) * down[self.start])
        self.first = np.searchsorted(self.start, bounds)
        self.count = np.diff(self.first)


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """Yield ``(first row, last row + 1, bytes, bounds)``; a NULL text has no bytes."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a document, and the document of each.

    A document with 1 to ``size - 1`` words has its whole sequence as one shingle.
    """
    h, count = words.hash, words.count
    doc = np.repeat(np.arange(len(count)), count)
    full = np.arange(max(0, len(h) - size + 1))
    full = full[doc[full] == doc[full + size - 1]] if len(full) else full
    out = np.zeros(len(full), dtype=np.uint64)
    for k in range(size):
        out += h[full + k] * PLACE[k]
    owner = doc[full]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = np.zeros(len(short), dtype=np.uint64)
        for k in range(size - 1):
            has = count[short] > k
            whole[has] += h[words.first[short[has]] + k] * PLACE[k]
        whole += count[short].astype(np.uint64) * PLACE[63]
        owner = np.concatenate([owner, short])
        out = np.concatenate([out, whole])
        order = np.argsort(owner, kind="stable")
        owner, out = owner[order], out[order]
    return mix(out), owner


def distinct_sets(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each document, in order, and ``n + 1`` bounds."""
    edges = np.searchsorted(owner, np.arange(n + 1))
    parts = [np.unique(hashes[a:b]) for a, b in zip(edges[:-1], edges[1:])]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]) if parts else np.zeros(1, np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), bounds


def minhashes(hashes: np.ndarray, bounds: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The smallest of each of ``len(seeds)`` orders per non-empty set, as rows of 32-bit numbers."""
    out = np.empty((len(bounds) - 1, len(seeds)), dtype=np.int32)
    if not len(out):
        return out
    for k, seed in enumerate(seeds):
        least = np.minimum.reduceat((hashes ^ (seed >> np.uint64(7))) * seed, bounds[:-1])
        out[:, k] = (least >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def lists(values: np.ndarray, bounds: np.ndarray, kind=None) -> pa.Array:
    """An Arrow list column from flat values and bounds."""
    flat = pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, type=kind)
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat)
