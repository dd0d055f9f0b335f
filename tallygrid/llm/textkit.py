"""Vectorised word and shingle hashing over Arrow text columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D in the UTF-8
text after lower-casing A-Z only.  Everything here works on whole batches of
texts at once; texts are taken in pieces of bounded size, so memory does not
follow the length of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_U = np.uint64
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_Q = 0xC2B2AE3D27D4EB4F

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    key = f"{base}"
    have = _powers.get(key)
    if have is None or len(have) < n:
        out = np.ones(max(n, PIECE + 1), dtype=_U)
        done, step = 1, base
        with np.errstate(over="ignore"):
            while done < len(out):
                more = min(done, len(out) - done)
                out[done : done + more] = out[:more] * _U(step)
                done += more
                step = step * step % (1 << 64)
        _powers[key] = have = out
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_binary():
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def groups(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about ``limit`` bytes each; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the bytes, and for each row its first word's index."""
    tok = ~SPACE[raw]
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = tok[:-1]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    prev[inner] = False
    starts = np.flatnonzero(tok & ~prev)
    nxt = np.empty(n, bool)
    nxt[-1] = False
    nxt[:-1] = tok[1:]
    nxt[inner - 1] = False
    ends = np.flatnonzero(tok & ~nxt) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_ranges(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of raw[starts[i]:ends[i]] for each i; starts must ascend."""
    out = np.empty(len(starts), _U)
    i, n = 0, len(starts)
    while i < n:
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
        j = min(j, n)
        stop = int(ends[i:j].max())
        size = stop - base
        pw, inv = _power_table(_P, size + 1), _power_table(_P_INV, size + 1)
        with np.errstate(over="ignore"):
            acc = np.zeros(size + 1, _U)
            np.cumsum((raw[base:stop].astype(_U) + _U(1)) * pw[:size], out=acc[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            h = (acc[e] - acc[s]) * inv[s]
            out[i:j] = h + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words, and for each row its first word's index."""
    raw = LOWER[raw]
    starts, ends, first = words(raw, offsets)
    return hash_ranges(raw, starts, ends), first


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[i:i+n] for each i (rows are not looked at; callers cut at row ends)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        out = np.full(m, _U(n) * _U(0xA0761D6478BD642F), _U)
        q = 1
        for j in range(n):
            out += h[j : j + m] * _U(q)
            q = q * _Q % (1 << 64)
    return mix(out)


def shingle_sets(column: pa.Array, n: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its n-word shingles).

    A text of fewer words has its whole sequence as the one shingle; a text
    without words has none.
    """
    raw, offsets = column_bytes(column)
    for i, j in groups(offsets):
        lo, hi = offsets[i], offsets[j]
        h, first = word_hashes(raw[lo:hi], offsets[i : j + 1] - lo)
        grams = ngram_hashes(h, n)
        for r in range(j - i):
            a, b = int(first[r]), int(first[r + 1])
            if b - a >= n:
                s = np.sort(grams[a : b - n + 1])
                if len(s) > 1:
                    s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                s = ngram_hashes(h[a:b], b - a)
            else:
                s = np.zeros(0, _U)
            yield i + r, s


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as compressed byte planes of their differences."""
    import zstandard

    d = np.diff(values, prepend=_U(0)) if len(values) else values
    planes = np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    with np.errstate(over="ignore"):
        return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=_U)
