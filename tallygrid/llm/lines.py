"""Fuzzy line dedup: SimHash, pigeonhole blocks, edit similarity, one line kept.

Lines are normalised (ASCII lower case, digits to 0, other ASCII to single
blanks).  Equal normalised lines are one class.  Classes meet by blocks: the
four 32-bit blocks of the 128-bit SimHash of a line's distinct words; for
lines of up to SHORT characters segments of the line, of which one stays
whole in every pair that is similar enough (no such pair is missed); for
longer ones the lowest hashes of their word shingles, and of character grams
where the line has few words.  Of classes that meet, longer lines must not
differ in more than MAX_BITS bits of the SimHash, which lines of other words
do; then lower bounds of the edit distance are tried, and an edit similarity
of at least MIN_SIMILARITY links them.  Of every connected group the first
occurrence stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import column_bytes, groups, hash_ranges, mix, ngram_hashes, signed, words
from .workspace import TILE, Sieve, Workspace, bounded, linked_lists

MIN_SIMILARITY = 90
#: Bits of 128 in which lines of more than SHORT characters and FEW words or more may differ; unlike lines differ in about
#: 60.  For lines of fewer or very long words 0 stands for the SimHash, and no bits are compared.
MAX_BITS = 48
#: Lines, with their documents' ids, that may be broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Characters up to which a line is cut into segments; from LONG on it has shingles.
SHORT, LONG = 44, 40
#: Words in a shingle and shingles kept; bytes in a gram and grams kept, for lines of under FEW words or of long words.
SHINGLE, SHINGLES, GRAM, GRAMS, FEW = 4, 8, 12, 12, 8
#: Ratio of neighbouring length classes; above 100 / MIN_SIMILARITY, so that near lines lie at most one apart.
LENGTH_STEP = 1.12
#: Bytes of texts whose keys go to one task, and of those dealt at once.
PART_BYTES, DEAL_BYTES = 8 << 20, 8 << 20
#: Characters up to which a line goes into tiles with its text.
CARRIED = 4096
#: Lines of one side of a tile whose pairs are tried at once.
STRIP = 32
#: Lines with one key among those dealt at once from which the key's rows are spread over all tasks.
CROWD = 256

_U = np.uint64

#: Byte by byte: ASCII letters to lower case, digits to 0, other ASCII to a blank; the line feed stays.
_NORMAL = np.arange(256, dtype=np.uint8)
for _c in range(128):
    _ch = chr(_c)
    _NORMAL[_c] = ord("0") if _ch.isdigit() else ord(_ch.lower()) if _ch.isalpha() else 32
_NORMAL[10] = 10


class Lines:
    """The normalised lines of the texts raw[offsets[i]:offsets[i + 1]], empty lines included; lines end at a line feed.

    row and number tell a line's text and place; raw[offsets[i]:offsets[i + 1]]
    is line i; words first[i] to first[i + 1] are its own, with places in
    words and hashes in hashes.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        raw = _NORMAL[raw]
        feeds = np.flatnonzero(raw == 10)
        row = np.concatenate((np.arange(len(offsets) - 1), np.searchsorted(offsets, feeds, side="right") - 1))
        begin = np.concatenate((offsets[:-1], feeds + 1))
        order = np.lexsort((begin, row))
        row, begin = row[order], begin[order]
        first_of_row = np.searchsorted(row, np.arange(len(offsets) - 1))
        starts, ends, _ = words(raw, offsets)
        line = np.searchsorted(begin, starts, side="right") - 1
        keep = raw != 10
        keep[raw == 32] = False
        inner = np.ones(len(starts), bool)
        inner[1:] = line[1:] == line[:-1]
        inner[:1] = False
        keep[starts[inner] - 1] = True
        place = np.concatenate(([0], np.cumsum(keep)))
        self.row, self.number = row, np.arange(len(row)) - first_of_row[row]
        self.raw = raw[keep]
        self.words = place[starts], place[ends]
        self.first = np.searchsorted(line, np.arange(len(row) + 1))
        size = np.zeros(len(row), np.int64)
        some = np.flatnonzero(np.diff(self.first))
        size[some] = self.words[1][self.first[some + 1] - 1] - self.words[0][self.first[some]]
        self.offsets = np.concatenate(([0], np.cumsum(size)))
        self.hashes = hash_ranges(self.raw, *self.words)

    def __getitem__(self, i: int) -> bytes:
        return self.raw[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def __len__(self) -> int:
        return len(self.row)

    def pick(self, which: np.ndarray) -> Lines:
        """Some of the lines, in ascending order."""
        out = object.__new__(Lines)
        out.row, out.number = self.row[which], self.number[which]
        size, n = np.diff(self.offsets)[which], np.diff(self.first)[which]
        out.offsets, out.first = np.concatenate(([0], np.cumsum(size))), np.concatenate(([0], np.cumsum(n)))
        at = np.arange(out.offsets[-1]) + np.repeat(self.offsets[which] - out.offsets[:-1], size)
        out.raw = self.raw[at]
        w = np.arange(out.first[-1]) + np.repeat(self.first[which] - out.first[:-1], n)
        back = np.repeat(self.offsets[which] - out.offsets[:-1], n)
        out.words = self.words[0][w] - back, self.words[1][w] - back
        out.hashes = self.hashes[w]
        return out


def column_lines(column: pa.Array) -> Iterator[Lines]:
    """The lines of a column of texts, by pieces of bounded size; row counts from the column's start."""
    raw, offsets = column_bytes(column)
    for i, j in groups(offsets):
        out = Lines(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        out.row = out.row + i
        yield out


def line_hashes(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each line; no line is empty."""
    at = np.arange(len(lines.hashes)) - np.repeat(lines.first[:-1], np.diff(lines.first))
    with np.errstate(over="ignore"):
        other = mix(np.add.reduceat(mix(lines.hashes ^ _U(0x5851F42D4C957F2D)) * (2 * at + 1).astype(_U), lines.first[:-1]))
    return hash_ranges(lines.raw, lines.offsets[:-1], lines.offsets[1:]), other


def simhash(lines: Lines) -> np.ndarray:
    """The 128-bit SimHash of each line, as two columns.

    Every distinct word of a line votes once, so that common words do not
    make unrelated lines alike.
    """
    line = np.repeat(np.arange(len(lines), dtype=_U), np.diff(lines.first))
    keys = np.sort((line << _U(40)) | (lines.hashes >> _U(24)))
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    first = np.searchsorted(keys >> _U(40), np.arange(len(lines) + 1, dtype=_U))
    bits = np.empty((len(keys), 2), _U)
    bits[:, 0] = mix(keys & _U((1 << 40) - 1))
    bits[:, 1] = mix(bits[:, 0] ^ _U(0x2545F4914F6CDD1D))
    planes = np.unpackbits(bits.view(np.uint8).reshape(len(keys), 16), axis=1)
    count = np.diff(first)
    # eight one-byte counters in a 64-bit lane; they hold for lines of up to 255 distinct words
    ones = np.add.reduceat(planes.view(_U), first[:-1], axis=0).view(np.uint8).astype(np.int32)
    for i in np.flatnonzero(count > 255):
        ones[i] = planes[first[i] : first[i + 1]].sum(axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > count[:, None], axis=1).view(_U)


def sizes_and_bags(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """(characters, counts of them up to 255 in 32 bins) of each line; an edit moves one character."""
    lead = (lines.raw & 0xC0) != 0x80
    chars = np.diff(np.concatenate(([0], np.cumsum(lead)))[lines.offsets])
    line = np.repeat(np.arange(len(lines)), np.diff(lines.offsets))
    bags = np.bincount((line[lead] << 5) | (lines.raw[lead] & 31), minlength=32 * len(lines)).reshape(-1, 32)
    return chars, np.minimum(bags, 255).astype(np.uint8)


def segments(x: str) -> list[tuple[int, int, str]]:
    """(length, number, characters): two lines that are near by MIN_SIMILARITY have one in common.

    A line of n characters at distance d or less holds one of its d + 1
    segments unchanged; the shorter line tries the lengths of all longer
    partners, and of each only the shifts that the edits before and behind
    the segment allow.
    """
    out, n = [], len(x)
    for longer in range(n, n * 100 // MIN_SIMILARITY + 1):
        most, gap = longer * (100 - MIN_SIMILARITY) // 100, longer - n
        size, extra = divmod(longer, most + 1)
        at = 0
        for i in range(most + 1 if most else 0):
            width = size + (i > most - extra)
            for p in range(at + max(-i, i - most - gap), at + min(i, most - i - gap) + 1):
                if 0 <= p <= n - width:
                    out.append((longer, i, x[p : p + width]))
            at += width
    return out


def _lowest(start: np.ndarray, n: np.ndarray, hashed, most: int, thin: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the ``most`` smallest distinct hashed(indices) of each row's n indices from start."""
    row = np.repeat(np.arange(len(n)), n)
    v = hashed(np.arange(len(row)) + np.repeat(start - np.cumsum(n) + n, n))
    many = (n > 4 * most) & thin
    if many.any():
        # values far above those wanted are not sorted
        top = np.full(len(n), 2**64 - 1, _U)
        top[many] = ((2.0**64 - 4096) * (4.0 * most / n[many])).astype(_U)
        keep = v <= top[row]
        row, v = row[keep], v[keep]
    order = np.argsort((row.astype(_U) << _U(40)) | (v >> _U(24)))
    row, v = row[order], v[order]
    fresh = np.ones(len(v), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (v[1:] != v[:-1])
    row, v = row[fresh], v[fresh]
    first = np.searchsorted(row, np.arange(len(n) + 1))
    low = np.arange(len(row)) - first[row] < most
    short = many & (np.diff(first) < most)
    if not short.any():
        return row[low], v[low]
    low &= ~short[row]
    k = np.flatnonzero(short)
    r, x = _lowest(start[k], n[k], hashed, most, False)
    return np.concatenate((row[low], k[r])), np.concatenate((v[low], x))


def _few_words(lines: Lines) -> np.ndarray:
    """Lines whose words tell little: few ones, or very long ones as where no blanks are written."""
    n = np.diff(lines.first)
    return (n < FEW) | (np.diff(lines.offsets) > 12 * n)


def near_keys(lines: Lines, chars: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of non-empty lines with their sizes and SimHashes; near lines have a key in common."""
    each = np.arange(len(lines))
    found = [(each, mix((sim[:, i >> 1] >> _U(32 * (i & 1))) & _U(0xFFFFFFFF) | _U((i + 1) << 32))) for i in range(4)]
    size, n = np.diff(lines.offsets), np.diff(lines.first)
    grams = ngram_hashes(lines.hashes, SHINGLE)
    found.append(_lowest(lines.first[:-1], np.maximum(0, n - SHINGLE + 1) * (chars >= LONG), lambda at: grams[at], SHINGLES))
    few = (chars >= LONG) & _few_words(lines)
    found.append(_lowest(lines.offsets[:-1], np.maximum(0, size - GRAM + 1) * few, lambda at: mix(hash_ranges(lines.raw, at, at + GRAM)), GRAMS))
    row, parts = [], []
    for i in np.flatnonzero(chars <= SHORT):
        for longer, k, x in segments(lines[i].decode("utf-8", "replace")):
            row.append(i)
            parts.append(b"%d %d " % (longer, k) + x.encode())
    if parts:
        ends = np.cumsum([len(x) for x in parts])
        v = hash_ranges(np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], ends[:-1])), ends)
        found.append((np.array(row, np.int64), mix(mix(v))))
    return np.concatenate([r for r, _ in found]), np.concatenate([v for _, v in found])


#: A row is an occurrence (up to bag) or keys of one part (part, how, pairs).
_SCAN = "h long, h2 long, doc_id long, text_key long, line int, size int, lo long, hi long, bag binary, part long, how int, pairs binary"
_FIELDS = [(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]]) for x in _SCAN.split(", ")]
#: A key, the line that has it, and the line's length class.
_PAIR = np.dtype([("key", "<u8"), ("node", "<u8"), ("kind", "u1")])
#: How keys are dealt: by key; by key and node, for keys of very many lines; and one mark by key for each of those.
_PLAIN, _SPREAD, _MARK = 0, 1, 2


def _length_class(chars: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(chars, 1).astype(float)) / np.log(LENGTH_STEP)).astype(np.uint8)


def _rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(n, t)) for k, t in _FIELDS], names=[k for k, _ in _FIELDS])


def _blobs(values: np.ndarray) -> pa.Array:
    """The rows of a byte matrix as binary values."""
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _dealt(rows: np.ndarray, parts: int) -> pa.RecordBatch:
    """Keys by part.  Those of a key that very many lines have are spread, and one mark stays in the key's own part."""
    rows = rows[np.argsort(rows["key"], kind="stable")]
    at = np.flatnonzero(np.concatenate(([True], rows["key"][1:] != rows["key"][:-1])))
    count = np.diff(np.append(at, len(rows)))
    crowd = count >= CROWD
    spread = np.repeat(crowd, count)
    part, how, blobs = [], [], []
    for kind, some in ((_PLAIN, rows[~spread]), (_SPREAD, rows[spread]), (_MARK, rows[at[crowd]])):
        if len(some):
            place = (mix(some["key"] ^ some["node"]) if kind == _SPREAD else some["key"]) % _U(parts)
            order = np.argsort(place, kind="stable")
            which, first = np.unique(place[order], return_index=True)
            part += which.astype(np.int64).tolist()
            how += [kind] * len(which)
            blobs += [x.tobytes() for x in np.split(some[order], first[1:])]
    return _rows(len(part), part=pa.array(part, pa.int64()), how=pa.array(how, pa.int32()), pairs=pa.array(blobs, pa.binary()))


def _scan(min_words: int, parts: int):
    """(doc_id, text_key, text) to a row for each line of at least min_words words, and to their keys by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            doc, text_key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lines in column_lines(batch.column(2)):
                lines = lines.pick(np.flatnonzero(np.diff(lines.first) >= max(1, min_words)))
                if not len(lines):
                    continue
                h, h2 = line_hashes(lines)
                _, at, back = np.unique(h, return_index=True, return_inverse=True)
                kinds = lines.pick(np.sort(at))
                rank = np.empty(len(at), np.int64)
                rank[np.argsort(at)] = np.arange(len(at))
                back = rank[back]
                chars, bags = sizes_and_bags(kinds)
                sim = simhash(kinds)
                row, key = near_keys(kinds, chars, sim)
                sim[_few_words(kinds)] = 0
                yield _rows(
                    len(lines), h=pa.array(signed(h)), h2=pa.array(signed(h2)), doc_id=pa.array(doc[lines.row]), text_key=pa.array(text_key[lines.row]),
                    line=pa.array(lines.number.astype(np.int32)), size=pa.array(chars[back].astype(np.int32)), bag=_blobs(bags[back]),
                    lo=pa.array(signed(sim[back, 0])), hi=pa.array(signed(sim[back, 1])),
                )
                pairs = np.empty(len(row), _PAIR)
                pairs["key"], pairs["node"], pairs["kind"] = key, h[np.sort(at)][row], _length_class(chars)[row]
                held.append(pairs)
                size += len(lines.raw)
                if size >= DEAL_BYTES:
                    yield _dealt(np.concatenate(held), parts)
                    held, size = [], 0
        if held:
            yield _dealt(np.concatenate(held), parts)

    return run


def _distinct(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.lexsort((rows["node"], rows["key"]))]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["node"][1:] != rows["node"][:-1])
    return rows[fresh]


def _by_length(rows: np.ndarray, whole: bool = False) -> np.ndarray:
    """Every row twice, its key split by its length class and the next.

    Where the rows are ``whole``, all of each key and ascending by key, kind
    becomes 1 in lists whose members all meet in another one, else 0.
    """
    kind = rows["kind"].astype(_U)
    spare = np.zeros((2, len(rows)), bool)
    if whole and len(rows):
        order = np.lexsort((kind, rows["key"]))
        key, ordered = rows["key"][order], kind[order]
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (ordered[1:] != ordered[:-1]))))
        one, k = key[first], ordered[first]
        beside = (one[1:] == one[:-1]) & (k[1:] == k[:-1] + _U(1))
        count = np.diff(np.append(first, len(rows)))
        below, above = (np.repeat(x, count) for x in (np.append(False, beside), np.append(beside, False)))
        spare[:, order] = ~below, below & ~above
    out = np.concatenate([rows, rows])
    out["key"] = mix(out["key"] ^ mix(np.concatenate([kind, kind + _U(1)]) + _U(1)))
    out["kind"] = spare.ravel()
    return out


def _several(rows: np.ndarray) -> np.ndarray:
    """The rows whose key another row has; rows ascend by key."""
    if len(rows) < 2:
        return rows[:0]
    same = rows["key"][1:] == rows["key"][:-1]
    return rows[np.concatenate((same, [False])) | np.concatenate(([False], same))]


def _shared_keys(table: pa.Table) -> pa.Table:
    """The keys of one part to (key, node, spare) of the keys and length classes that several nodes have; spare lists add nothing."""
    how = table.column("how").to_numpy()
    blobs = table.column("pairs").to_pylist()
    plain, spread, marks = (np.frombuffer(b"".join(x for x, k in zip(blobs, how, strict=True) if k == kind), _PAIR) for kind in (_PLAIN, _SPREAD, _MARK))
    marked = np.isin(plain["key"], marks["key"])
    rest = _several(_distinct(_by_length(_several(_distinct(plain[~marked])), True)))
    rows = np.concatenate([rest, *(_by_length(_distinct(x)) for x in (plain[marked], spread))])
    key, node = (pa.array(signed(np.ascontiguousarray(rows[c]))) for c in ("key", "node"))
    return pa.table({"key": key, "node": node, "spare": pa.array(rows["kind"] != 0)})


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32).astype(np.int16)


def _possible(percent: int):
    """Pairs (a, b, size and bag of each) that lengths and bags do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 3))
            x, y = _matrix(batch.column(4)), _matrix(batch.column(5))
            away = np.maximum(np.abs(p - q), np.maximum(np.maximum(x - y, 0).sum(axis=1), np.maximum(y - x, 0).sum(axis=1)))
            mask = pa.array(100 * away <= (100 - percent) * np.maximum(p, q))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def _possible_matrix(percent: int):
    """The same bounds for every row of one table against every row of another."""

    def match(a: pa.Table, b: pa.Table) -> np.ndarray:
        p, q = (t.column("size").to_numpy().astype(np.int64) for t in (a, b))
        x, y = _matrix(a.column("bag")), _matrix(b.column("bag"))
        sides = [[t.column(c).to_numpy().view(_U) for c in ("lo", "hi")] for t in (a, b)]
        bare = [(lo | hi) == 0 for lo, hi in sides]
        ok = np.zeros((len(p), len(q)), bool)
        # a strip of rows at a time: the numbers behind a truth value take far more room than it
        for i in range(0, len(p), STRIP):
            s = slice(i, i + STRIP)
            longer = np.maximum(p[s, None], q[None, :])
            bits = sum(np.bitwise_count(u[s, None] ^ v[None, :]) for u, v in zip(*sides, strict=True))
            rough = 100 * np.abs(p[s, None] - q[None, :]) <= (100 - percent) * longer
            rough &= (bits <= MAX_BITS) | (np.minimum(p[s, None], q[None, :]) <= SHORT) | bare[0][s, None] | bare[1][None, :]
            r, c = np.nonzero(rough)
            for k in range(0, len(r), STRIP * TILE):
                m, n = r[k : k + STRIP * TILE], c[k : k + STRIP * TILE]
                d = x[i + m] - y[n]
                away = np.maximum(np.maximum(d, 0).sum(axis=1), np.maximum(-d, 0).sum(axis=1))
                ok[i + m, n] = 100 * away <= (100 - percent) * longer[m, n]
        return ok

    return match


def _run(a: str, i: int, b: str, j: int) -> int:
    """Characters that a from i and b from j have in common."""
    n, step = 0, 16
    while True:
        x, y = a[i + n : i + n + step], b[j + n : j + n + step]
        if x and x == y:
            n += len(x)
            step *= 2
            continue
        if step == 1 or not x or not y:
            return n
        step = step // 2 if step > 2 else 1


#: Characters skipped at once at most, and those that must agree behind them.
SKIP, AGREE = 12, 8


def surely_within(a: str, b: str, most: int) -> bool:
    """Whether going from one difference to the next shows a distance of at most ``most``; False decides nothing."""
    i = j = cost = 0
    while True:
        n = _run(a, i, b, j)
        i, j = i + n, j + n
        if i == len(a) or j == len(b):
            return cost + max(len(a) - i, len(b) - j) <= most
        for k in range(1, min(SKIP, most - cost) + 1):
            at = next(((x, y) for x, y in ((k, k), *((k, d) for d in range(k)), *((d, k) for d in range(k))) if a[i + x : i + x + AGREE] == b[j + y : j + y + AGREE]), None)
            if at:
                break
        else:
            return False
        i, j, cost = i + at[0], j + at[1], cost + k


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance by bit-parallel columns; with ``most`` any larger distance gives most + 1."""
    if a == b:
        return 0
    most = max(len(a), len(b)) if most is None else most
    i = _run(a, 0, b, 0)
    a, b = a[i:], b[i:]
    j = _run(a[::-1], 0, b[::-1], 0)
    a, b = a[: len(a) - j], b[: len(b) - j]
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    limit = most + len(b)  # a column lowers the score by one at most
    for c in b:
        eq = where.get(c, 0)
        x = eq | down
        eq |= ((eq & up) + up) ^ up
        grow, shrink = down | (~(eq | up) & full), up & eq
        limit -= 1
        if grow & top:
            score += 1
        elif shrink & top:
            score -= 1
        if score > limit:
            return most + 1
        grow, shrink = (grow << 1 | 1) & full, shrink << 1 & full
        up, down = shrink | (~(x | grow) & full), grow & x
    return score


#: Edits, and characters of a pair, up to which pairs of lines are measured many at once, and cells of one step of that.
WIDE, REACH, CELLS = 256, 1 << 14, 1 << 16


def _coded(texts: list[str], front: int, height: int) -> np.ndarray:
    """The code points of each text down a column, from row ``front`` on."""
    size = np.array([len(x) for x in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    out = np.zeros((len(texts), height), np.uint16 if codes.max(initial=0) < 1 << 16 else np.uint32)
    out[np.repeat(np.arange(len(texts)), size), front + np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)] = codes
    return np.ascontiguousarray(out.T)


def _within_band(xs: list[str], ys: list[str], most: np.ndarray) -> np.ndarray:
    """Whether each pair's distance is at most its ``most``, by the antidiagonals of all their tables at once.

    Pairs descend by their summed lengths, and no pair's lengths differ by
    more than its ``most``.  Only the diagonals -k to k are filled, k being
    the largest ``most``; those of one parity in each step, a column a pair.
    """
    k = max(1, int(most.max()))
    m, n = (np.array([len(x) for x in side]) for side in (xs, ys))
    front, last = k // 2 + 2, m + n
    height = front + (int(last[0]) + k) // 2 + 2
    a, b = _coded(xs, front, height), _coded(ys, front, height)
    out, which = np.zeros(len(xs), bool), np.arange(len(xs))
    far = np.int16(1 << 13)
    # rows of a step stand for every second diagonal; a border of ``far`` is on both sides of those of even steps' partners
    even, odd = np.full((k + 1, len(xs)), far, np.int16), np.full((k + 2, len(xs)), far, np.int16)
    for t in range(int(last[0]) + 1):
        p = (t + k) & 1
        here, beside = (odd[1:-1], even) if p else (even, odd)
        if t:
            i, j, width = front - 1 + (t + k - p) // 2, front - 1 + (t - k + p) // 2, len(here)
            here += a[i - width + 1 : i + 1][::-1] != b[j : j + width]
            np.minimum(here, np.minimum(beside[:-1], beside[1:]) + np.int16(1), out=here)
        else:
            here[(k - p) // 2] = 0
        live = len(which)
        while live and last[live - 1] == t:
            live -= 1
        if live < len(which):
            done = np.arange(live, len(which))
            out[which[done]] = here[(n[done] - m[done] + k - p) // 2, done] <= most[done]
        keep = slice(live) if live < len(which) else None
        if t % 32 == 31 and live:
            hopeful = np.minimum(even[:, :live].min(axis=0), odd[:, :live].min(axis=0)) <= most[:live]
            if 4 * np.count_nonzero(hopeful) < 3 * live:
                keep = np.flatnonzero(hopeful)
        if keep is not None:
            which, m, n, last, most = (x[keep] for x in (which, m, n, last, most))
            even, odd = even[:, keep], odd[:, keep]
            a, b = a[:, keep], b[:, keep]
            if not len(which):
                break
    return out


def all_within(xs: list[str], ys: list[str], percent: int) -> np.ndarray:
    """Whether the edit similarity of each pair is at least ``percent``; for pairs of long lines one by one."""
    m, n = (np.array([len(x) for x in side], np.int64) for side in (xs, ys))
    most = np.maximum(m, n) * (100 - percent) // 100
    out = np.zeros(len(xs), bool)
    close = np.abs(m - n) <= most
    small = (most <= WIDE) & (m + n <= REACH)
    for i in np.flatnonzero(close & ~small).tolist():
        out[i] = surely_within(xs[i], ys[i], int(most[i])) or edit_distance(xs[i], ys[i], int(most[i])) <= most[i]
    order = np.flatnonzero(close & small)
    order = order[np.argsort(-(m + n)[order], kind="stable")]
    at = 0
    while at < len(order):
        some = order[at : at + max(16, CELLS // (int(most[order[at]]) + 2))]
        if len(some) < 8:
            out[some] = [edit_distance(xs[i], ys[i], int(most[i])) <= most[i] for i in some]
        else:
            out[some] = _within_band([xs[i] for i in some], [ys[i] for i in some], most[some])
        at += len(some)
    return out


def _similar(percent: int):
    """Pairs (a, b, their lines) whose edit similarity is at least ``percent``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = pa.array(all_within(batch.column(2).to_pylist(), batch.column(3).to_pylist(), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def _confirmed(percent: int):
    return lambda xs, ys: all_within(xs, ys, percent)


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(wanted nodes and line numbers, text) to (node, its normalised line)."""
    for batch in batches:
        wanted = batch.column(0).to_pylist()
        for lines in column_lines(batch.column(1)):
            first = np.searchsorted(lines.row, np.arange(batch.num_rows + 1))
            node, norm = [], []
            for r in np.unique(lines.row).tolist():
                for x in wanted[r]:
                    node.append(x["node"])
                    norm.append(lines[int(first[r]) + x["line"]].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(norm, pa.string())], names=["node", "text"])


def repeated_lines(ws: Workspace, keyed: DataFrame, min_words: int = 1) -> DataFrame:
    """(doc_id, text_key, lines): the line numbers to remove, for keyed(doc_id, text_key, text)."""
    keyed = keyed.where("doc_id is not null and text is not null")
    parts = 1 + (keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES
    scan = ws.cut(keyed.mapInArrow(_scan(min_words, parts), _SCAN))
    dealt = scan.where("part is not null").select("part", "how", "pairs").groupBy("part")
    met = ws.cut(dealt.applyInArrow(_shared_keys, "key long, node long, spare boolean").where("not spare").select("key", "node"))
    occ = ws.cut(scan.where("part is null").select("h", "h2", "doc_id", "text_key", "line", "size", "lo", "hi", "bag"))
    ws.drop(scan)
    where = F.struct("doc_id", "text_key", "line")
    # a hash that two different lines have stands for one of them in lists; the other meets no near lines
    listed = occ.join(met.select(F.col("node").alias("h")).distinct(), "h").groupBy("h")
    sig = ws.cut(listed.agg(F.min(F.struct("h2", where.alias("first"), "size", "lo", "hi", "bag")).alias("x")).select(F.col("h").alias("node"), "x.*"))

    def norms(nodes: DataFrame) -> DataFrame:
        """(node, text): the normalised lines of nodes."""
        wanted = nodes.join(sig.select("node", "first"), "node").select("node", "first.*")
        wanted = ws.cut(wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("node", "line")).alias("wanted")))
        found = keyed.join(bounded(wanted, BROADCAST_ROWS, F.size("wanted")), ["doc_id", "text_key"]).select("wanted", "text")
        out = ws.cut(found.mapInArrow(_pick, "node long, text string").dropDuplicates(["node"]))
        ws.drop(wanted)
        return out

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda x: sig.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("size", "lo", "hi", "bag")))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        bits = F.bit_count(F.col("lo_a").bitwiseXOR(F.col("lo_b"))) + F.bit_count(F.col("hi_a").bitwiseXOR(F.col("hi_b")))
        bare = (F.col("lo_a").bitwiseOR(F.col("hi_a")) == 0) | (F.col("lo_b").bitwiseOR(F.col("hi_b")) == 0)
        both = both.where((bits <= MAX_BITS) | (F.least("size_a", "size_b") <= SHORT) | bare).select("a", "b", "size_a", "size_b", "bag_a", "bag_b")
        near = ws.cut(both.mapInArrow(_possible(MIN_SIMILARITY), "a long, b long"))
        nodes = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
        named = norms(nodes)
        pairs = near.join(named.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
        pairs = pairs.join(named.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
        out = ws.cut(pairs.select("a", "b", "x", "y").mapInArrow(_similar(MIN_SIMILARITY), "a long, b long"))
        ws.drop(near, named)
        return out

    def texts(nodes: DataFrame) -> DataFrame:
        return norms(nodes.join(sig.where(F.col("size") <= CARRIED).select("node"), "node"))

    sieve = Sieve(sig.select("node", "size", "lo", "hi", "bag"), _possible_matrix(MIN_SIMILARITY), texts, _confirmed(MIN_SIMILARITY))
    labels = linked_lists(ws, met, verify, sieve, short=2, hubs=1)
    ws.drop(met)
    linked = labels.join(sig.select("node", "h2"), "node").select(F.col("node").alias("h"), "h2", "comp")
    classes = occ.groupBy("h", "h2").agg(F.min(where).alias("first"), F.count("*").alias("n"))
    named = classes.join(linked, ["h", "h2"], "left").select("h", "h2", "first", "n", "comp").where("n > 1 or comp is not null")
    named = ws.cut(named)
    ws.drop(sig)
    lead = named.where("comp is not null").groupBy("comp").agg(F.min("first").alias("lead"))
    named = named.join(lead, "comp", "left").select("h", "h2", F.coalesce("lead", "first").alias("lead"))
    gone = occ.join(named, ["h", "h2"]).where(where != F.col("lead")).select("doc_id", "text_key", "line")
    gone = ws.cut(gone.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line")).alias("lines")))
    ws.drop(occ)
    return gone


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 1) -> DataFrame:
    """(row, n_lines, removed, kept_text): every row of docs as a struct, and what stays of its text.

    The order of occurrences is (id, hash of the text, line number).  Rows
    that repeat id and text are one document and stay alike; a null id or
    text loses nothing and is nobody's first occurrence; empty lines, and
    lines of fewer than ``min_words`` words, stay.  ``row`` holds all columns
    of docs, so their names cannot clash.
    """
    ws = Workspace(spark)
    text = F.col(text_col)
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    gone = repeated_lines(ws, keyed, min_words)
    row = docs.select(F.struct("*").alias("row"))
    text = F.col("row").getField(text_col)
    row = row.withColumn("doc_id", F.col("row").getField(id_col).cast("long")).withColumn("text_key", F.xxhash64(text))
    both = row.join(bounded(gone, BROADCAST_ROWS, F.size("lines")), ["doc_id", "text_key"], "left")
    parts = F.split(text, "\n", -1)
    left = F.filter(parts, lambda x, i: ~F.array_contains("lines", i))
    return both.select(
        "row",
        F.coalesce(F.size(parts), F.lit(0)).alias("n_lines"),
        F.coalesce("lines", F.array().cast("array<int>")).alias("removed"),
        F.when(F.col("lines").isNull(), text).otherwise(F.array_join(left, "\n")).alias("kept_text"),
    )


def without_repeated_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with the kept text and its length in text and n_chars.

    A document whose every word is in removed lines is a copy and goes;
    one that had no removed line stays as it is.
    """
    out = drop_repeated_lines(spark, docs)
    emptied = (F.size("removed") > 0) & ~F.col("kept_text").rlike(r"\S")
    row = F.col("row").withField("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.when(F.size("removed") > 0, F.length("kept_text").cast(kind)).otherwise(F.col("row.n_chars"))
        row = row.withField("n_chars", changed)
    return out.where(~emptied).select(row.alias("row")).select("row.*")
