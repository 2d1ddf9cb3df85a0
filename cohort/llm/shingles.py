"""Word-shingle sets of Arrow string batches as sorted 64-bit hashes, by numpy over the bytes of a batch.

A word is a run of characters other than ASCII white space, A-Z lower-cased. The hash of a word is a polynomial
over random 64-bit values of its bytes, taken from prefix sums, then mixed; that of a shingle combines its words.
Two different shingles share a hash with a probability of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text is cut at white space, its words being hashed piece by piece.
CHUNK = 1 << 20
_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)
_STEP = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser: every bit of the result depends on every bit of h."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def salted_minima(flat: np.ndarray, at: np.ndarray, salt: np.ndarray, piece: int = 1 << 14) -> np.ndarray:
    """(runs, salts): the least mixed(flat * s) of the runs of flat that begin at ``at``, for every salt s.

    Worked on in place, about ``piece`` values at a time, so that they stay in the processor's cache.
    """
    out = np.empty((len(at), len(salt)), np.uint64)
    ends = np.r_[at[1:], len(flat)]
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(ends, at[a] + piece, "right")))
        part, begin = flat[at[a]:ends[b - 1]], at[a:b] - at[a]
        h, t = np.empty_like(part), np.empty_like(part)
        for k, s in enumerate(salt):
            np.multiply(part, s, out=h)
            for factor in (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), None):
                np.right_shift(h, np.uint64(33), out=t)
                np.bitwise_xor(h, t, out=h)
                if factor is not None:
                    np.multiply(h, factor, out=h)
            out[a:b, k] = np.minimum.reduceat(h, begin)
        a = b
    return out


@lru_cache(maxsize=4)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _hash_words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of the words of raw; texts begin at bounds, which end words as white space does."""
    ink = ~_SPACE[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = ink[:-1]
    before[bounds[bounds < len(raw)]] = False
    first = np.flatnonzero(ink & ~before)
    after = np.zeros(len(raw), bool)
    after[:-1] = ink[1:]
    inner = bounds[(bounds > 0) & (bounds <= len(raw))]
    after[inner - 1] = False
    end = np.flatnonzero(ink & ~after) + 1
    bits = max(20, int(len(raw)).bit_length())
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * _powers(_BASE, bits)[:len(raw)], out=sums[1:])
    return mixed((sums[end] - sums[first]) * _powers(_BACK, bits)[first] + (end - first).astype(np.uint64)), first


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string array; null texts are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes; a longer row comes alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, row) of every word of the rows that offsets bound; first bytes count from the first row's start."""
    base, total = int(offsets[0]), int(offsets[-1] - offsets[0])
    starts = offsets - base
    if total <= 2 * CHUNK:
        h, first = _hash_words(raw[base:base + total], starts)
    else:  # cut at white space
        parts, at = [], 0
        own = raw[base:base + total]
        while at < total:
            end = min(total, at + CHUNK)
            while end < total and not _SPACE[own[end]]:
                gap = np.flatnonzero(_SPACE[own[end:end + CHUNK]])
                end = end + int(gap[0]) if len(gap) else min(total, end + CHUNK)
            inside = starts[(starts >= at) & (starts <= end)] - at
            h, first = _hash_words(own[at:end], inside)
            parts.append((h, first + at))
            at = end
        h, first = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    return h, first, np.searchsorted(starts, first, "right") - 1


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words, as shingles() gives them, whatever rows the words are of."""
    total = h[:len(h) - n + 1] * _STEP[0]
    for k in range(1, n):
        total += h[k:len(h) - n + 1 + k] * _STEP[k]
    return mixed(total)


def shingles(h: np.ndarray, row: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the n-word shingles of words; a row with fewer than n words gives one, of all its words."""
    if not len(h):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out, rows = [], []
    if len(h) >= n:
        total = h[:len(h) - n + 1] * _STEP[0]
        for k in range(1, n):
            total = total + h[k:len(h) - n + 1 + k] * _STEP[k]
        same = row[:len(h) - n + 1] == row[n - 1:]
        out.append(mixed(total[same]))
        rows.append(row[:len(h) - n + 1][same])
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[first, len(h)])
    for size in range(1, n):
        at = first[count == size]
        if len(at):
            out.append(mixed(sum((h[at + k] * _STEP[k] for k in range(size)), np.full(len(at), size, np.uint64) * _STEP[n])))
            rows.append(row[at])
    return np.concatenate(out), np.concatenate(rows)


def sets(column: pa.Array, n: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text that has a word, in order of rows."""
    raw, offsets = texts_of(column)
    for a, b in chunks(offsets):
        h, _, row = words(raw, offsets[a:b + 1])
        hashes, rows = shingles(h, row, n)
        order = np.argsort(rows, kind="stable")
        hashes, rows = hashes[order], rows[order]
        cut = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else []
        for i, at in enumerate(cut):
            end = cut[i + 1] if i + 1 < len(cut) else len(rows)
            own = np.sort(hashes[at:end])
            yield a + int(rows[at]), own[np.r_[True, own[1:] != own[:-1]]]


def set_keys(hashes: np.ndarray) -> tuple[int, int]:
    """Two 63-bit and 64-bit keys of a set of sorted hashes."""
    import hashlib

    a = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    one, two = np.frombuffer(a, np.int64)
    return int(one), int(two)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets: the shorter is probed in the longer by binary search."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
