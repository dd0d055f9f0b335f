"""Exact substring dedup over bytes with suffix arrays.

A byte is removed when a 100-byte string that covers it also starts earlier
in the corpus.  Windows of 100 bytes are grouped by content-defined anchors
(see ``anchors``), so that only windows whose anchor repeats are looked at:

1. all (anchor hash, segment hash) pairs are counted; anchors that occur once
   are out, and so are all their windows;
2. equal segments share all their windows: the first occurrence of each
   stands for them, every later one is removed whole;
3. different segments of one anchor may still share windows.  Each is cut
   into SPLITS ranges of windows; the bytes common to a range's windows
   become one symbol, those beside it keep theirs, and a suffix array over
   these strings brings equal windows together; the first stays.

The suffix array is built by linear grouping: groups of suffixes with equal
Lyndon prefix are processed in descending order, previous-smaller pointers
tell which suffixes they refine, and a last pass emits each group's order
from the next-smaller relation, without recursion or renaming.

Hashes are 64-bit pairs (anchor and segment); the anchors' sorted arrays lie
in the shared folder, and workers map them into memory.
"""

from __future__ import annotations

import hashlib
import os
import shutil
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import column_segments
from .kneser import _map, _save, part_bits
from .textkit import hash_ranges, mix, pack_sorted, signed, unpack_sorted
from .workspace import Workspace, mounted_folder, swept

WINDOW, ANCHOR, SPLITS = 100, 50, 4
#: Segments, or their numbers, that a task holds before it sends them on.
HOLD = 1 << 19
#: Bytes of text to a part of the anchors; a task holds a part.
PART_BYTES = 16 << 20
#: Symbols of one suffix array; a larger group of one core is decided by hashes of whole windows.
BLOCK = 1 << 17
_U = np.uint64


def suffix_array(s: list[int]) -> list[int]:
    """The suffix array of a sequence of non-negative integers, by linear grouping."""
    n = len(s)
    if not n:
        return []
    values = np.asarray(s)
    order = np.argsort(values, kind="stable")
    starts = np.searchsorted(values[order], values)
    sa, group = order.tolist(), starts.tolist()
    where = [0] * n
    for r, i in enumerate(sa):
        where[i] = r
    last = [0] * n  # last[start of a group] is its end
    for r, i in enumerate(sa):
        last[group[i]] = r
    smaller = [-1] * n
    end = n - 1
    while end >= 0:
        start = group[sa[end]]
        seen: dict[int, int] = {}
        members = (sa[end],) if start == end else sorted(sa[start : end + 1])
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                seen[j] = seen.get(j, 0) + 1
        end = start - 1
        if not seen:
            continue
        if len(seen) == 1:
            batches = (tuple(seen),)
        else:
            runs: dict[int, list[int]] = {}
            for j, c in seen.items():
                runs.setdefault(c, []).append(j)
            batches = [runs[c] for c in sorted(runs, reverse=True)]
        for batch in batches:
            # to the upper end of their groups, where they become groups of their own
            ends: dict[int, int] = {}
            for j in batch:
                g = group[j]
                e = last[g]
                ends.setdefault(g, e)
                p, x = where[j], sa[e]
                sa[p], where[x] = x, p
                sa[e], where[j] = j, e
                last[g] = e - 1
            fresh = {g: last[g] + 1 for g in ends}
            for j in batch:
                group[j] = fresh[group[j]]
            for g, e in ends.items():
                last[fresh[g]] = e
    place = list(range(n))  # next free place of each group, by its start
    placed = [False] * n
    out = [0] * n
    j = n - 1
    r = -1
    while True:
        while j >= 0 and not placed[j]:
            g = group[j]
            out[place[g]] = j
            place[g] += 1
            placed[j] = True
            j = smaller[j]
        r += 1
        if r == n:
            return out
        j = out[r] - 1


# -- anchors ---------------------------------------------------------------


def _count_segments(bits: int):
    """Distinct (anchor, segment) hashes of a stretch of texts, dealt by anchor: (part, keys, segs, many)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            h, g = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            h, g, n = _distinct(h, g)
            part = (h >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
            cut = np.flatnonzero(np.diff(part)) + 1
            rows = [
                (int(p[0]), pack_sorted(a), b.astype("<u8").tobytes(), np.packbits(c > 1).tobytes())
                for p, a, b, c in zip(np.split(part, cut), np.split(h, cut), np.split(g, cut), np.split(n, cut), strict=True)
                if len(a)
            ]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["part", "keys", "segs", "many"])

        for batch in batches:
            for _, _, _, h, g, *_ in column_segments(batch.column(0), WINDOW, ANCHOR):
                held.append((h, g))
                if sum(len(x) for x, _ in held) > HOLD:
                    yield flush()
        if held:
            yield flush()

    return run


def _distinct(h: np.ndarray, g: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs by ascending h, then g, and how often each occurs."""
    order = np.lexsort((g, h))
    h, g = h[order], g[order]
    at = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])))) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.append(at, len(h))) if n is None else np.add.reduceat(n[order], at) if len(at) else at
    return h[at], g[at], count


def _store_repeated(folder: str):
    """Write the anchors that occur twice or more, and mark those with different segments."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        h = [unpack_sorted(x.as_py()) for x in table.column("keys")]
        g = [np.frombuffer(x.as_py(), "<u8") for x in table.column("segs")]
        n = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(k)).astype(np.int64) + 1 for x, k in zip(table.column("many"), h, strict=True)]
        h, g, n = np.concatenate(h), np.concatenate(g), np.concatenate(n)
        del table  # the part is held once
        h, _, n = _distinct(h, g, n)
        at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        total, kinds = np.add.reduceat(n, at), np.diff(np.append(at, len(h)))
        keep = total > 1
        _save(folder, f"r{part}.keys", h[at][keep].astype("<u8"))
        _save(folder, f"r{part}.mixed", (kinds[keep] > 1).astype(np.uint8))
        return pa.table({"part": [part], "n": [int(keep.sum())]})

    return run


def _known(folder: str, name: str, sizes: dict[int, int], bits: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(h is in the stored keys, and marked as mixed) for hashes in any order; sizes: keys in each part."""
    u, back = np.unique(h, return_inverse=True)
    part = (u >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(u), np.int64)
    edge = np.searchsorted(part, np.arange((1 << bits) + 1))
    found, mixed = np.zeros(len(u), bool), np.zeros(len(u), bool)
    for p in np.flatnonzero(np.diff(edge)):
        n = sizes.get(int(p), 0)
        if n:
            keys = _map(folder, f"{name}{p}.keys", "<u8", n)
            a, b = edge[p], edge[p + 1]
            k = np.searchsorted(keys, u[a:b])
            k[k == len(keys)] = 0
            hit = keys[k] == u[a:b]
            found[a:b] = hit
            if name == "r":
                mixed[a:b] = hit & (_map(folder, f"r{p}.mixed", np.uint8, n)[k] > 0)
    return found[back], mixed[back]


def _repeated_segments(folder: str, sizes: dict[int, int], bits: int):
    """(doc_id, text_key, text) to a row for each segment whose anchor repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, first, count, h, g, *_ in column_segments(batch.column(2), WINDOW, ANCHOR):
                if not len(h):
                    continue
                found, mixed = _known(folder, "r", sizes, bits, h)
                k = np.flatnonzero(found)
                if len(k):
                    cols = (signed(h[k]), signed(g[k]), doc[row[k]], key[row[k]], first[k], count[k].astype(np.int32), mixed[k])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "g", "doc_id", "text_key", "p", "n", "mixed"])

    return run


_SEGMENTS = "h long, g long, doc_id long, text_key long, p long, n int, mixed boolean"


def _place_key(h: np.ndarray, g: np.ndarray, doc: np.ndarray, key: np.ndarray, p: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = mix(h.view(_U) ^ mix(g.view(_U)))
        x = mix(x + doc.astype(np.int64).view(_U))
        return mix(mix(x ^ key.view(_U)) + p.astype(np.int64).view(_U))


def _deal_places(bits: int):
    """First places of segments that share an anchor with others, as sorted keys by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.sort(_place_key(*(c.to_numpy() for c in batch.columns)))
            part = (k >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(k), np.int64)
            cut = np.flatnonzero(np.diff(part)) + 1
            rows = [(int(p[0]), pack_sorted(x)) for p, x in zip(np.split(part, cut), np.split(k, cut), strict=True) if len(x)]
            cols = list(zip(*rows, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary())], names=["part", "keys"])

    return run


def _store_places(folder: str):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        keys = np.unique(np.concatenate([unpack_sorted(x.as_py()) for x in table.column("keys")]))
        _save(folder, f"f{part}.keys", keys.astype("<u8"))
        return pa.table({"part": [part], "n": [len(keys)]})

    return run


def _ranges() -> list[tuple[int, int]]:
    """The ranges (least, greatest) of an anchor's offset in its window."""
    n = WINDOW - ANCHOR + 1
    edges = [n * i // SPLITS for i in range(SPLITS + 1)]
    return [(a, b - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _cores(folder: str, sizes: dict[int, int], firsts: dict[int, int], bits: int):
    """(doc_id, text_key, text) to a row for each range of windows of a first, contested segment.

    core: hash of the bytes that all windows of the range have, with the
    range; side: hash of all the bytes; left, right: the bytes beside the core.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, first, count, h, g, begin, lead, raw in column_segments(batch.column(2), WINDOW, ANCHOR):
                if not len(h):
                    continue
                k = np.flatnonzero(_known(folder, "r", sizes, bits, h)[1])
                if len(k):
                    places = _place_key(signed(h[k]), signed(g[k]), doc[row[k]], key[row[k]], first[k])
                    k = k[_known(folder, "f", firsts, bits, places)[0]]
                if len(k):
                    yield _split(doc[row[k]], key[row[k]], first[k], count[k], h[k], begin[k], lead[k], raw)

    return run


_CORES = "core long, side long, span int, doc_id long, text_key long, p long, n int, left binary, right binary"


def _split(doc, key, first, count, h, begin, lead, raw) -> pa.RecordBatch:
    out: list[list[np.ndarray]] = []
    for which, (o1, o2) in enumerate(_ranges()):
        high, low = np.minimum(o2, lead), np.maximum(o1, lead - count + 1)
        k = np.flatnonzero(high >= low)
        a, hi, lo = begin[k] + lead[k], high[k], low[k]
        core = hash_ranges(raw, a - o1, a - o2 + WINDOW)
        side = hash_ranges(raw, a - hi, a - lo + WINDOW)
        with np.errstate(over="ignore"):
            core = mix(core ^ mix(h[k] + _U(which)))
            side = mix(side ^ (hi - o1).astype(_U))
        left = [raw[x:y].tobytes() for x, y in zip((a - hi).tolist(), (a - o1).tolist(), strict=True)]
        right = [raw[x:y].tobytes() for x, y in zip((a - o2 + WINDOW).tolist(), (a - lo + WINDOW).tolist(), strict=True)]
        span = np.full(len(k), o2 - o1, np.int32)
        n = (hi - lo + 1).astype(np.int32)
        out.append([signed(core), signed(side), span, doc[k], key[k], first[k] + lead[k] - hi, n, left, right])
    cols = [pa.array(np.concatenate(c)) if isinstance(c[0], np.ndarray) else pa.array(sum(c, []), pa.binary()) for c in zip(*out, strict=True)]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _CORES.split(", ")])


_SPANS = "doc_id long, text_key long, s long, e long"


def _spans(doc, key, s, e) -> pa.RecordBatch:
    cols = [pa.array(np.asarray(x, np.int64)) for x in (doc, key, s, e)]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_key", "s", "e"])


def _equal_windows(rows: list[tuple]) -> list[tuple[int, int, int]]:
    """Places (doc_id, text_key, p) of the windows that are not the first of their kind.

    rows: (core, span, doc_id, text_key, p, n, left, right) of whole groups of a core.
    """
    symbols: list[int] = []
    starts, owner, length = [], [], []
    names: dict[int, int] = {}
    for i, (core, span, _, _, _, n, left, right) in enumerate(rows):
        at = len(symbols)
        starts.extend(range(at, at + n))
        owner.extend((i, j) for j in range(n))
        length.extend([span + 1] * n)
        symbols.extend(x + 1 for x in left)
        symbols.append(names.setdefault(core, 257 + len(names)))
        symbols.extend(x + 1 for x in right)
        symbols.append(0)
    order = np.asarray(suffix_array(symbols))
    mine = np.full(len(symbols), -1)
    mine[starts] = np.arange(len(starts))
    ranked = mine[order]
    ranked = ranked[ranked >= 0]
    most = max(length)
    padded = np.concatenate((np.asarray(symbols), np.full(most, -1)))
    at, size = np.asarray(starts)[ranked], np.asarray(length)[ranked]
    same = size[1:] == size[:-1]
    for j in range(most):
        same &= (padded[at[1:] + j] == padded[at[:-1] + j]) | (size[1:] <= j)
    again = []
    group: list[tuple[int, int, int]] = []
    for k, r in enumerate(ranked.tolist()):
        i, j = owner[r]
        place = (rows[i][2], rows[i][3], rows[i][4] + j)
        if k and same[k - 1]:
            group.append(place)
            continue
        if len(group) > 1:
            again.extend(sorted(group)[1:])
        group = [place]
    if len(group) > 1:
        again.extend(sorted(group)[1:])
    return again


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of core; whole groups are gathered to about BLOCK symbols."""
    held: list[tuple] = []
    group: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        again = _equal_windows(held)
        held.clear()
        doc, key, p = zip(*again, strict=True) if again else ((), (), ())
        p = np.asarray(p, np.int64)
        return _spans(doc, key, p, p + WINDOW)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and row[0] != group[0][0]:
                held.extend(group)
                group = []
                if size >= BLOCK:
                    yield flush()
                    size = 0
            group.append(row)
            size += len(row[6]) + len(row[7]) + 2
    held.extend(group)
    if held:
        yield flush()


def _single_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of rows of very large groups, with two hashes of it."""
    for batch in batches:
        core, h1, h2, doc, key, p = [], [], [], [], [], []
        for c, span, d, t, at, n, left, right in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            for j in range(n):
                digest = hashlib.blake2b(left[j:] + b"|%d|" % (len(left) - j) + right[: span - (len(left) - j)], digest_size=16).digest()
                core.append(c)
                h1.append(int.from_bytes(digest[:8], "little", signed=True))
                h2.append(int.from_bytes(digest[8:], "little", signed=True))
                doc.append(d)
                key.append(t)
                p.append(at + j)
        cols = [pa.array(x, pa.int64()) for x in (core, h1, h2, doc, key, p)]
        yield pa.RecordBatch.from_arrays(cols, names=["core", "h1", "h2", "doc_id", "text_key", "p"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, s, e) to the document without the bytes of its spans."""
    for batch in batches:
        spans, kept, sizes = [], [], []
        for text, s, e in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            merged: list[list[int]] = []
            for a, b in sorted(zip(s or (), e or (), strict=True)):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            parts, at = [], 0
            for a, b in merged:
                parts.append(data[at:a])
                at = b
            parts.append(data[at:])
            kept.append(b"".join(parts))
            sizes.append(len(data))
            spans.append([{"start": a, "stop": b} for a, b in merged])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "spans", "kept"],
        )


def repeated_bytes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the removed spans and the remaining bytes of every row of docs.

    A null text counts as empty.  Places are ordered by (id, hash of the
    text, start); rows that repeat id and text are one document and stay
    alike.  A null id loses nothing and nothing is removed for it.  Texts
    under 100 bytes have no window.  Other columns are not read; an empty
    table gives an empty result.
    """
    ws = Workspace(spark)
    folder = mounted_folder(spark, "suffixes")
    os.makedirs(folder, exist_ok=True)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("text_key", F.coalesce(F.xxhash64("text"), F.lit(0)))
    real = docs.where("doc_id is not null and octet_length(text) >= 100").select("doc_id", "text_key", "text")

    bits = part_bits(real, PART_BYTES)
    with swept(spark):
        counted = real.select("text").mapInArrow(_count_segments(bits), "part long, keys binary, segs binary, many binary")
        stored = counted.groupBy("part").applyInArrow(_store_repeated(folder), "part long, n long")
        sizes = {r["part"]: r["n"] for r in stored.collect()}

    place = F.struct("doc_id", "text_key", "p")
    found = ws.cut(real.mapInArrow(_repeated_segments(folder, sizes, bits), _SEGMENTS))
    firsts = found.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.max("mixed").alias("mixed"))
    firsts = ws.cut(firsts)
    later = found.join(firsts.where("first <> last").select("h", "g", "first"), ["h", "g"]).where(place != F.col("first"))
    spans = later.select("doc_id", "text_key", F.col("p").alias("s"), (F.col("p") + F.col("n") + (WINDOW - 1)).alias("e"))

    mixed = firsts.where("mixed").select("h", "g", "first.doc_id", "first.text_key", "first.p")
    with swept(spark):
        dealt = mixed.mapInArrow(_deal_places(bits), "part long, keys binary").groupBy("part")
        leads = {r["part"]: r["n"] for r in dealt.applyInArrow(_store_places(folder), "part long, n long").collect()}
    cores = ws.cut(real.mapInArrow(_cores(folder, sizes, leads, bits), _CORES))
    kinds = cores.groupBy("core", "side").agg(
        F.min(place).alias("first"), F.max(place).alias("last"), F.min("span").alias("span"),
        F.min("n").alias("n"), F.min("left").alias("left"), F.min("right").alias("right"),
    )
    kinds = ws.cut(kinds)
    again = cores.join(kinds.where("first <> last").select("core", "side", "first"), ["core", "side"]).where(place != F.col("first"))
    spans = spans.union(again.select("doc_id", "text_key", F.col("p").alias("s"), (F.col("p") + F.col("n") + (WINDOW - 1)).alias("e")))
    width = F.sum(F.octet_length("left") + F.octet_length("right") + 2)
    crowds = kinds.groupBy("core").agg(F.count("*").alias("kinds"), width.alias("width")).where("kinds > 1")
    rest = ws.cut(kinds.join(crowds.select("core", "width"), "core"))
    columns = ["core", "span", "first.doc_id", "first.text_key", "first.p", "n", "left", "right"]
    small = rest.where(F.col("width") <= BLOCK).select(*columns).repartition("core").sortWithinPartitions("core")
    spans = spans.union(small.mapInArrow(_blocks, _SPANS))
    large = rest.where(F.col("width") > BLOCK).select(*columns)
    single = ws.cut(large.mapInArrow(_single_windows, "core long, h1 long, h2 long, doc_id long, text_key long, p long"))
    least = single.groupBy("core", "h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    more = single.join(least.drop("last"), ["core", "h1", "h2"]).where(place != F.col("first"))
    spans = spans.union(more.select("doc_id", "text_key", F.col("p").alias("s"), (F.col("p") + WINDOW).alias("e")))

    gone = spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("s", "e")).alias("x"))
    gone = ws.cut(gone.select("doc_id", "text_key", "x.s", "x.e"))
    for table in (found, firsts, cores, kinds, rest, single):
        ws.drop(table)
    shutil.rmtree(folder, ignore_errors=True)
    both = docs.join(gone, ["doc_id", "text_key"], "left").select("doc_id", "text", "s", "e")
    return both.mapInArrow(_remove, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")
