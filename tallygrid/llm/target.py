"""A draw from the corpus that follows the distribution of target text.

Words are hashed into buckets by their CRC; the counts of the corpus and of
the target give every bucket an integer gain.  A document's weight is the mean
gain of its words, and Gumbel noise on it makes the highest scores a draw
without replacement.

The draw is an external merge: every task of the scoring pass writes its
documents in sorted runs of bounded length.  The scores' histogram says where the
draw ends and cuts what lies above into ranges of bounded size; each range is
merged from the pieces of all runs by a tournament tree, and the counts of the
ranges before it make its places ranks.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import LOWER, column_bytes, groups
from .workspace import Workspace

BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
#: Documents of one sorted run, and of one range of the draw (about).
RUN = 1 << 17
RANGE = 1 << 16
#: Words of more bytes are hashed one by one.
_LONG = 48
_LAST = np.iinfo(np.int64).max

# Word bytes after lower-casing: digits, a-z, and all of non-ASCII characters.
_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


_CRC = _crc_table()


def word_buckets(raw: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word of the texts in raw, and for each text its first word's index."""
    raw = LOWER[raw]
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = _WORD[raw]
    joined = np.empty(n, bool)  # the byte goes on a word that began before it
    joined[0] = False
    np.logical_and(inside[1:], inside[:-1], out=joined[1:])
    heads = offsets[1:-1]
    joined[heads[heads < n]] = False
    starts = np.flatnonzero(inside & ~joined)
    ends_at = np.empty(n, bool)
    ends_at[-1] = inside[-1]
    np.logical_and(inside[:-1], ~joined[1:], out=ends_at[:-1])
    length = np.flatnonzero(ends_at) + 1 - starts
    order = np.argsort(-np.minimum(length, _LONG + 1), kind="stable")
    at, size = starts[order], length[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    many = int(np.searchsorted(-size, -_LONG, side="left"))  # the first ones are longer than _LONG
    counts = np.searchsorted(-size, -np.arange(1, _LONG + 1), side="right")  # words of at least 1, 2, ... bytes
    for k, m in enumerate(counts):
        if m <= many:
            break
        c = crc[many:m]
        crc[many:m] = _CRC[(c ^ raw[at[many:m] + k]) & np.uint32(255)] ^ (c >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(many):
        crc[i] = zlib.crc32(raw[at[i] : at[i] + size[i]])
    out = np.empty(len(at), np.int64)
    out[order] = crc % np.uint32(buckets)
    return out, np.searchsorted(starts, offsets)


def _texts(column: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bucket of each word, first word of each row) in pieces of about a megabyte."""
    raw, offsets = column_bytes(column)
    for i, j in groups(offsets):
        lo = offsets[i]
        yield i, j, *word_buckets(raw[lo : offsets[j]], offsets[i : j + 1] - lo, buckets)


def _counter(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, b, _ in _texts(batch.column(0), buckets):
                seen += np.bincount(b, minlength=buckets)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often the words of all texts fall into each bucket."""
    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_counter(buckets), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to raw probability, one added to every count, rounded down."""
    buckets, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    out = np.empty(buckets, np.int64)
    for i, (s, t) in enumerate(zip(raw.tolist(), target.tolist(), strict=True)):
        out[i] = math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))))
    return out


def _noise(seed: int, doc: int | None) -> int:
    name = "null" if doc is None else doc
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = ("doc_id", "n_features", "weight", "score", "eligible")


def _scorer(gain: np.ndarray, seed: int, least: int, run_rows: int):
    """(doc_id, text) to scored rows in sorted runs: eligible ones first, by falling score, ties by rising id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            order = [("eligible", "descending"), ("score", "descending"), ("doc_id", "ascending")]
            yield from table.sort_by(order).to_batches(max_chunksize=1 << 14)

        for batch in batches:
            weight, n = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, j, b, first in _texts(batch.column(1), len(gain)):
                n[i:j] = np.diff(first)
                total = np.concatenate(([0], np.cumsum(gain[b])))[first]
                weight[i:j] = np.diff(total) // np.maximum(n[i:j], 1)
            score = weight + np.array([_noise(seed, d) for d in batch.column(0).to_pylist()], np.int64)
            held.append(pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight), pa.array(score), pa.array(n >= least)], names=list(_SCORED)))
            if sum(b.num_rows for b in held) >= run_rows:
                yield from flush()
        if held:
            yield from flush()

    return run


def _cuts(ws: Workspace, eligible: DataFrame, draw: int, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Last keys (-score, doc_id) of the ranges of about ``size`` rows that hold the draw, ascending, and the lowest score in them.

    Ranges end between scores; a score of more rows is cut further at quantiles of its ids.  The
    histogram has a row for each score, and scores are integers of a narrow
    interval (log ratios and noise of doubles in thousandths), however many documents there are.
    """
    histogram = eligible.groupBy("score").count().orderBy(F.desc("score")).collect()
    ends, have, above = [], 0, 0
    crowded: dict[int, int] = {}
    for score, n in histogram:
        if have and have + n > size:
            ends.append((-last, _LAST))
            have = 0
        have, last, above = have + n, score, above + n
        if n > size:
            crowded[score] = math.ceil(n / size)
        if above >= draw:
            break
    ends.append((-last, _LAST))
    if crowded:
        most = max(crowded.values())
        marks = F.percentile_approx(F.coalesce("doc_id", F.lit(int(_LAST))), F.array(*[F.lit(k / most) for k in range(1, most)]), F.lit(100 * most))
        for score, ids in eligible.where(F.col("score").isin(list(crowded))).groupBy("score").agg(marks).collect():
            ends += [(-score, i) for i in ids]
    ends.sort()
    return np.array([e[0] for e in ends], np.int64), np.array([e[1] for e in ends], np.int64), int(last)


def _range_of(neg: np.ndarray, ids: np.ndarray, cut_neg: np.ndarray, cut_ids: np.ndarray) -> np.ndarray:
    """The range of each key.  An id that ends several ranges fills all of these in turn: its rows are alike."""
    lo, hi = np.searchsorted(cut_neg, neg, "left"), np.searchsorted(cut_neg, neg, "right")
    out = lo.copy()
    for i in np.unique(lo[hi > lo]):
        at = np.flatnonzero((lo == i) & (hi > i))
        own = cut_ids[i : hi[at[0]]]
        first, last = np.searchsorted(own, ids[at], "left"), np.searchsorted(own, ids[at], "right")
        turn = np.arange(len(at)) % np.maximum(last - first, 1)
        out[at] = i + first + turn
    return out


def _pieces(cut_neg: np.ndarray, cut_ids: np.ndarray):
    """Scored rows to pieces of runs: (range, rows, and lists of what the rows hold), each piece sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, score = batch.column(0), batch.column(3).to_numpy(zero_copy_only=False)
            ids = doc.fill_null(int(_LAST)).to_numpy(zero_copy_only=False)
            at = _range_of(-score, ids, cut_neg, cut_ids)
            order = np.lexsort((ids, -score, at))
            at = at[order]
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
            bounds = pa.array(np.concatenate((first, [len(at)])).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, c.take(pa.array(order))) for c in batch.columns[:4]]
            n = np.diff(np.concatenate((first, [len(at)])))
            yield pa.RecordBatch.from_arrays([pa.array(at[first]), pa.array(n), *lists], names=["range", "n", *_SCORED[:4]])

    return run


def tournament(runs: list[list[tuple]]) -> Iterator[tuple[int, int]]:
    """(run, place in it) of all entries of sorted runs in one ascending order, by a tree of losers.

    Every leaf stands for a run; an inner node keeps the loser of the match
    below it, so that the next winner takes one match a level.
    """
    k = len(runs)
    if not k:
        return
    heads, done = [0] * k, (1,)

    def key(r: int) -> tuple:
        return (0, runs[r][heads[r]], r) if heads[r] < len(runs[r]) else (*done, (), r)

    keys = [key(r) for r in range(k)]
    loser = [0] * k
    winner = [0] * (2 * k)
    for r in range(k):
        winner[k + r] = r
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], loser[node] = (a, b) if keys[a] < keys[b] else (b, a)
    top = winner[1] if k > 1 else 0
    while keys[top][0] == 0:
        yield top, heads[top]
        heads[top] += 1
        keys[top] = key(top)
        node = (k + top) >> 1
        while node:
            if keys[loser[node]] < keys[top]:
                loser[node], top = top, loser[node]
            node >>= 1


def _merger(offsets: dict[int, int], draw: int):
    """All pieces of one range to its rows with their ranks; the merge stops at the end of the draw, what is left has none."""

    def run(table: pa.Table) -> pa.Table:
        before = offsets[table.column("range")[0].as_py()]
        cols = [table.column(c).combine_chunks() for c in _SCORED[:4]]
        ends = cols[0].offsets.to_numpy()
        flat = [c.values for c in cols]
        ids, neg = flat[0].fill_null(int(_LAST)).to_numpy(zero_copy_only=False), -flat[3].to_numpy(zero_copy_only=False)
        keys = list(zip(neg.tolist(), ids.tolist(), strict=True))
        runs = [keys[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        wanted = max(0, min(draw - before, len(keys)))
        rank = np.zeros(len(keys), np.int64)
        for place, (r, i) in zip(range(wanted), tournament(runs), strict=False):
            rank[ends[r] + i] = before + place + 1
        return pa.table({c: v for c, v in zip(_SCORED, flat, strict=False)} | {"rank": pa.array(rank, mask=rank == 0)})

    return run


def target_resample(
    spark: SparkSession,
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
    range_rows: int = RANGE,
    run_rows: int = RUN,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row for each row of docs, all long.

    Of the N documents of ``min_words`` words or more, ``floor(percent * N /
    100)`` are drawn: the highest scores, ties by the smaller doc_id, a null
    id last.  rank counts the drawn from 1; others have null.  A word is a run of
    ASCII letters (lower-cased), digits and non-ASCII characters; null and empty texts have none, and
    weight 0.  Noise follows from seed and id alone, so rows that repeat an
    id are scored alike if their texts are; they are rows of their own, and which of two rows with one
    id and score has the better rank is open.  An empty target leaves the ratio of smoothed uniform
    to raw.  Columns other than doc_id and text are not read.  An empty table gives an empty result.
    """
    ws = Workspace(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    schema = "doc_id long, n_features long, weight long, score long, eligible boolean"
    scored = ws.cut(docs.mapInArrow(_scorer(gain, seed, min_words, run_rows), schema))
    undrawn = F.lit(None).cast("long").alias("rank")
    eligible = scored.where("eligible")
    draw = percent * eligible.count() // 100
    if not draw:
        return scored.select(*_SCORED[:4], undrawn)
    cut_neg, cut_ids, lowest = _cuts(ws, eligible, draw, range_rows)
    inside = F.col("eligible") & (F.col("score") >= lowest)
    lists = "range long, n long, doc_id array<long>, n_features array<long>, weight array<long>, score array<long>"
    pieces = ws.cut(scored.where(inside).mapInArrow(_pieces(cut_neg, cut_ids), lists))
    offsets, before = {}, 0
    for r, n in sorted(map(tuple, pieces.groupBy("range").agg(F.sum("n")).collect())):
        offsets[r], before = before, before + n
    merged = pieces.groupBy("range").applyInArrow(_merger(offsets, draw), "doc_id long, n_features long, weight long, score long, rank long")
    return merged.union(scored.where(~inside).select(*_SCORED[:4], undrawn))
