"""Vectorised byte and word helpers shared by the text operators.

Documents arrive as Arrow string columns. They are cut into chunks of whole documents of about
``target`` bytes, so that every numpy intermediate stays a few times that size whatever the batch holds.
A single document longer than ``target`` forms a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Chunk size in bytes: intermediates of 8 bytes a byte then fit in the cache of a core.
CHUNK = 1 << 19


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=U64)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _lookup(seed: int) -> np.ndarray:
    return mix64(np.arange(256, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


#: One random 64-bit value for each byte; FOLDED gives A-Z the values of a-z.
BYTE_HASH = _lookup(0x51ED270B)
FOLDED = BYTE_HASH.copy()
FOLDED[65:91] = FOLDED[97:123]
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

_M = 0xD1342543DE82EF95
_M_INV = pow(_M, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + (CHUNK >> 1))
        x = np.full(size, base, dtype=U64)
        x[0] = 1
        have = np.multiply.accumulate(x)
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums c of values[i] * M**i, for span_hash."""
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * powers(_M, len(values)), out=out[1:])
    return out


#: Values of a span that enter its hash as one polynomial. Polynomials modulo 2**64 of 1000 and more values have equal
#: sums for different ones (Thue-Morse patterns); up to this length their differences keep half of the bits.
BLOCK = 64


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each pair, whatever its place in the buffer.

    BLOCK values at a time enter as a polynomial; blocks are chained by mixing, so a longer span is no polynomial.
    """
    back = powers(_M_INV, len(prefix))
    stop = np.minimum(end, start + BLOCK)
    out = mix64((prefix[stop] - prefix[start]) * back[start])
    more = np.flatnonzero(stop < end)
    a, last = stop[more], end[more]
    with np.errstate(over="ignore"):
        while len(more):
            b = np.minimum(last, a + BLOCK)
            out[more] = mix64(out[more] * U64(0x9FB21C651E98DF25) + (prefix[b] - prefix[a]) * back[a] + (b - a).astype(U64))
            on = b < last
            more, a, last = more[on], b[on], last[on]
    return out


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of an Arrow string (or binary) column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, target: int = CHUNK, most: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, last row + 1, bytes, offsets) for runs of whole documents, ``most`` at a time if given."""
    data, at = string_buffers(column)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + target, side="right")) - 1)
        hi = hi if most is None else min(hi, lo + most)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each document: starts, ends, and n + 1 offsets into them by document."""
    word = np.zeros(len(data) + 2, dtype=bool)
    word[1:-1] = ~IS_SPACE[data]
    first = word[1:-1] & ~word[:-2]
    last = word[1:-1] & ~word[2:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = word[1:-1][inner]
    last[inner - 1] = word[1:-1][inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word with A-Z lower-cased, and n + 1 offsets by document."""
    starts, ends, by = words(data, at)
    return span_hash(prefix_hash(FOLDED[data]), starts, ends), by


def shingle_hashes(hashes: np.ndarray, by: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words, in order with repeats, and n + 1 offsets by document.

    A document with fewer words has its whole sequence as one shingle; one without words has none.
    """
    n_words = np.diff(by)
    with np.errstate(over="ignore"):
        full = max(0, len(hashes) - size + 1)
        run = np.zeros(full, dtype=U64)
        for k in range(size):
            run = mix64(run * U64(0x9FB21C651E98DF25) + hashes[k : k + full] + U64(size))
        count = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
        out_by = np.zeros(len(by), dtype=np.int64)
        np.cumsum(count, out=out_by[1:])
        out = np.empty(out_by[-1], dtype=U64)
        doc = np.repeat(np.arange(len(n_words)), count)
        place = by[:-1][doc] + np.arange(len(out)) - out_by[:-1][doc]
        long = n_words[doc] >= size
        out[long] = run[place[long]]
        for k in range(1, size):
            docs = np.flatnonzero(n_words == k)
            if len(docs):
                h = np.zeros(len(docs), dtype=U64)
                for j in range(k):
                    h = mix64(h * U64(0x9FB21C651E98DF25) + hashes[by[docs] + j] + U64(k))
                out[out_by[docs]] = h
    return out, out_by
