"""NumPy kernels over Arrow batches: byte views, words, rolling hashes.

Every kernel works on the concatenated UTF-8 bytes of one Arrow batch, so a
Python loop never runs per word or per byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240601)
#: A random odd 64-bit code for every byte value.
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 2**64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; grown on demand and kept."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        have = np.full(size, base, U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n+1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or len(at) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of non-space bytes, and n+1 offsets of each row's words. Words never cross rows."""
    n = len(data)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | first[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of data[start:end] that depends on the content only; prefix[i] sums code * BASE**place of data[:i]."""
    return mix((prefix[end] - prefix[start]) * powers(BASE_INV, len(prefix))[start])


#: Bytes whose codes are held at once.
PIECE = 1 << 17
#: Places in a word whose byte codes are looked up; those behind are computed.
NEAR = 32
_SALT = U(0x632BE59BD9B4E019)
_PLACED = mix(np.arange(NEAR * 256, dtype=np.uint64) * U(BASE) + _SALT).reshape(NEAR, 256)
_LOOKED = {False: _PLACED.ravel(), True: _PLACED[:, LOWER].ravel()}


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hashes of words given in order; they depend on the words only.

    Every pair of a byte and its place in the word has a random code of its own, and codes are added:
    no algebra between places, so words of few letters do not collide by their structure.
    """
    out, at, table = np.empty(len(starts), U), 0, _LOOKED[lower]
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + PIECE, "right")))
        first, last = starts[at:to] - low, ends[at:to] - low
        byte = data[low : low + int(last[-1])]
        began = np.zeros(len(byte), np.int32)
        began[first] = first
        place = np.arange(len(byte), dtype=np.int32) - np.maximum.accumulate(began)
        code = table[(np.minimum(place, NEAR - 1) << 8) | byte]
        if int((last - first).max()) > NEAR:
            far = np.flatnonzero(place >= NEAR)
            letter = LOWER[byte[far]] if lower else byte[far]
            code[far] = mix((place[far].astype(U) << U(8) | letter) * U(BASE) + _SALT)
        sums = np.zeros(len(byte) + 1, U)
        np.cumsum(code, out=sums[1:])
        out[at:to] = mix(sums[last] - sums[first] + (last - first).astype(U))
        at = to
    return out


SHINGLE_BASE = 0xD6E8FEB86659FD93


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k-word shingles of every row, ordered by row and hash, and their n+1 offsets.

    A row of fewer than k words but at least one has its whole sequence as its only shingle.
    """
    n, rows = len(hashes), len(offsets) - 1
    counts = np.diff(offsets)
    acc = np.zeros(max(n - k + 1, 0), U)
    for j in range(k):
        acc = acc * U(SHINGLE_BASE) + hashes[j : n - k + 1 + j]
    row_of = np.repeat(np.arange(rows), counts)
    pos = np.arange(n) - offsets[:-1][row_of]
    full = pos + k <= counts[row_of]
    at = np.flatnonzero(full)
    value, row = mix(acc[at] + U(k)), row_of[at]
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        h = 0
        for x in hashes[offsets[r] : offsets[r + 1]].tolist():
            h = (h * SHINGLE_BASE + x) & (2**64 - 1)
        value = np.append(value, mix(np.array([(h + int(counts[r])) & (2**64 - 1)], U)))
        row = np.append(row, r)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[keep], row[keep]
    return value, np.searchsorted(row, np.arange(rows + 1))


def multi_range(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, concatenated."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)
