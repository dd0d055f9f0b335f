"""Content-defined anchors of fixed-size byte windows.

Every window of W bytes picks one of its K-byte strings, the one with the
smallest hash (the leftmost of equals), so equal windows pick equal strings
at equal offsets.  Neighbouring windows mostly pick the same place; such a
run of windows with one anchor is a segment, the bytes that they cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .textkit import _P, _P_INV, _power_table, column_bytes, groups, mix

_U = np.uint64
PLACE_BITS = 24
#: Bytes of texts taken at once; a longer text is cut into overlapping pieces of this many windows.
PIECE = 1 << 17


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i:i+w] for each i."""
    span = 1
    out = x
    while span * 2 <= w:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segments(raw: np.ndarray, offsets: np.ndarray, w: int, k: int) -> tuple[np.ndarray, ...]:
    """For the texts of one piece: (row, first window's place in the row, windows, anchor hash,
    segment hash, first window's place in raw, anchor's offset in the first window)."""
    n = len(raw)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U, np.int64, np.int64))
    if n < w:
        return none
    pw, inv = _power_table(_P, n + 1), _power_table(_P_INV, n + 1)
    acc = np.zeros(n + 1, _U)
    with np.errstate(over="ignore"):
        np.cumsum((raw.astype(_U) + _U(1)) * pw[:n], out=acc[1:])
        grams = mix((acc[k:] - acc[:-k]) * inv[: n - k + 1])
    low = _U((1 << PLACE_BITS) - 1)
    least = _least((grams & ~low) | np.arange(n - k + 1, dtype=_U), w - k + 1)
    place = np.arange(n - w + 1)
    row = np.searchsorted(offsets, place, side="right") - 1
    inside = np.flatnonzero(place + w <= offsets[row + 1])
    if not len(inside):
        return none
    chosen = least[inside]
    start = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (inside[1:] != inside[:-1] + 1))))
    first = inside[start]
    count = np.diff(np.append(start, len(inside)))
    anchor = (chosen[start] & low).astype(np.int64)
    stop = first + count + w - 1
    with np.errstate(over="ignore"):
        seg = mix((acc[stop] - acc[first]) * inv[first] + count.astype(_U) * _U(0x9FB21C651E98DF25))
        seg = mix(seg ^ ((anchor - first).astype(_U) * _U(0xC2B2AE3D27D4EB4F)))
    r = row[first]
    return r, first - offsets[r], count, grams[anchor], seg, first, anchor - first


def column_segments(column: pa.Array, w: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """segments() of a whole column, piece by piece, with the bytes of the piece."""
    raw, offsets = column_bytes(column)
    for i, j in groups(offsets, PIECE):
        lo, hi = int(offsets[i]), int(offsets[j])
        if hi - lo <= 2 * PIECE or j - i > 1:
            row, *rest = segments(raw[lo:hi], offsets[i : j + 1] - lo, w, k)
            yield row + i, *rest, raw[lo:hi]
            continue
        for at in range(0, max(1, hi - lo - w + 1), PIECE):
            piece = raw[lo + at : min(hi, lo + at + PIECE + w - 1)]
            row, first, *rest = segments(piece, np.array([0, len(piece)]), w, k)
            yield row + i, first + at, *rest, piece
