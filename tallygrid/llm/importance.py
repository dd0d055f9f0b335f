"""Quality by importance resampling.

Words and word pairs are hashed into BUCKETS; the target text (labelled good
and not toxic) and the raw text (all of it) each give a distribution over the
buckets.  A document's log weight is the sum of the log ratios of its
features, and Gumbel top-k on it draws the sample without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import column_bytes, groups, ngram_hashes, word_hashes
from .workspace import Workspace

BUCKETS = 1 << 18
#: Target features lent to each bucket on both sides, against noise in rare buckets.
LENT = 8.0
#: Labels that may be broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000
_EXACT_ROWS = 10_000


def _features(text: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bucket of each feature, row of each feature)."""
    raw, offsets = column_bytes(text)
    for i, j in groups(offsets):
        lo = offsets[i]
        h, first = word_hashes(raw[lo : offsets[j]], offsets[i : j + 1] - lo)
        row = np.repeat(np.arange(j - i), np.diff(first))
        pairs = ngram_hashes(h, 2)
        inside = row[1:] == row[:-1] if len(row) > 1 else np.zeros(0, bool)
        every = np.concatenate((h, pairs[inside]))
        yield i, j, (every % np.uint64(buckets)).astype(np.int64), np.concatenate((row, row[1:][inside]))


def _counter(buckets: int):
    """(target, text) to counts of each bucket in raw and target text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            good = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for i, j, b, row in _features(batch.column(1), buckets):
                raw += np.bincount(b, minlength=buckets)
                target += np.bincount(b[good[i:j][row]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"]
        )

    return run


def fit_ratio(ws: Workspace, docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of target to raw probability for each bucket; zero throughout without target text.

    The counts of a bucket that the raw distribution leads one to expect in
    the target stand below the target's own counts; LENT is added to both.
    """
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    good = ws.cut(good.withColumn("good", F.lit(True)))
    side = F.broadcast(good) if good.count() <= BROADCAST_ROWS else good
    marked = docs.join(side, "doc_id", "left").select(F.coalesce("good", F.lit(False)).alias("good"), "text")
    counted = marked.mapInArrow(_counter(buckets), "bucket long, raw long, target long")
    rows = counted.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for b, r, t in rows:
        raw[b], target[b] = r, t
    if not target.sum():
        return np.zeros(buckets)
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + LENT) / (expected + LENT))


def _scorer(ratio: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i, j, b, row in _features(batch.column(1), len(ratio)):
                out[i:j] = np.bincount(row, ratio[b], minlength=j - i)
                n[i:j] = np.bincount(row, minlength=j - i)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(out), batch.column(2)], names=["doc_id", "n_features", "log_weight", "noise"]
            )

    return run


def _kth(keys: DataFrame, k: int) -> tuple[float, int, int] | None:
    """The k-th (key, doc_id, tie) in descending key, ascending others; exact, by narrowing histograms."""
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    if lo is None or k <= 0:
        return None
    above = 0
    while True:
        inside = keys.where(F.col("key").between(lo, hi))
        n = inside.count()
        width = (hi - lo) / 1024
        if n <= _EXACT_ROWS or not lo < lo + width < hi:
            break
        cell = F.least(F.floor((F.col("key") - lo) / width), F.lit(1023)).alias("cell")
        cells = inside.groupBy(cell).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        for c in cells.orderBy(F.desc("cell")).collect():
            if above + c["n"] >= k:
                lo, hi = c["lo"], c["hi"]
                break
            above += c["n"]
    row = inside.orderBy(F.desc("key"), "doc_id", "tie").offset(k - above - 1).limit(1).select("key", "doc_id", "tie").first()
    return tuple(row)


def resample(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 17, buckets: int = BUCKETS
) -> DataFrame:
    """(doc_id, n_features, log_weight, key, kept), one row for each row of docs.

    ``floor(share * rows)`` rows are kept, by default the share of labelled
    documents that are good and not toxic: those with the largest log weight
    plus Gumbel noise; the noise follows from id, text and seed, and ties go
    by id, and rows that repeat id and text stay or go together (they may
    exceed the share).  Null and empty texts have log weight 0; a null id sorts before
    all others in a tie; labels without a document are ignored and a
    document counts as target if any of its labels says so.  Other columns
    are not read.  Empty tables give an empty result.
    """
    ws = Workspace(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if share is None:
        share = labels.agg(F.avg(F.expr("cast(quality = 1 and coalesce(toxic, 0) = 0 as int)"))).first()[0] or 0.0
    ratio = fit_ratio(ws, docs, labels, buckets)
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11)
    u = (bits.cast("double") + 0.5) / float(1 << 53)
    noisy = docs.select("doc_id", "text", (-F.log(-F.log(u))).alias("noise"), F.xxhash64("text").alias("tie"))
    scored = noisy.select("doc_id", "text", F.struct("noise", "tie").alias("noise")).mapInArrow(
        _scorer(ratio), "doc_id long, n_features long, log_weight double, noise struct<noise:double,tie:long>"
    )
    keyed = scored.select("doc_id", "n_features", "log_weight", (F.col("log_weight") + F.col("noise.noise")).alias("key"), "noise.tie")
    keyed = ws.cut(keyed)
    last = _kth(keyed.select("key", F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "tie"), int(share * keyed.count()))
    if last is None:
        return keyed.select("doc_id", "n_features", "log_weight", "key", F.lit(False).alias("kept"))
    key, doc, tie = last
    mine = F.coalesce("doc_id", F.lit(-(2**63)))
    tied = (F.col("key") == key) & ((mine < doc) | ((mine == doc) & (F.col("tie") <= tie)))
    kept = (F.col("key") > key) | tied
    return keyed.select("doc_id", "n_features", "log_weight", "key", kept.alias("kept"))
