"""Document fingerprints: bottom-k sketches of five-word shingle hashes.

A fingerprint is the k smallest distinct hashes, 12 hex digits each, in
ascending order; fewer than k mean that it holds the whole set.  Fingerprints
of parts merge into that of the union of their shingles, and two of them
estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .textkit import shingle_sets

K = 128
DIGITS = 12
_SHIFT = np.uint64(64 - 4 * DIGITS)


def _truncate(s: np.ndarray, k: int) -> np.ndarray:
    v = s >> _SHIFT
    if len(v) > 1:
        v = v[np.concatenate(([True], v[1:] != v[:-1]))]
    return v[:k]


def encode(values: np.ndarray) -> str:
    return values.astype(">u8").tobytes().hex() if DIGITS == 16 else "".join(f"{x:0{DIGITS}x}" for x in values.tolist())


def decode(fingerprint: str) -> np.ndarray:
    return np.array([int(fingerprint[i : i + DIGITS], 16) for i in range(0, len(fingerprint), DIGITS)], np.uint64)


def sketch(text: str | None, k: int = K) -> str:
    """The fingerprint of one text; empty for a text without words."""
    return encode(_truncate(next(shingle_sets(pa.array([text], pa.string())))[1], k))


def _merged(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest of both, and those of them that are in both."""
    both = np.sort(np.concatenate((x, y)))
    again = np.concatenate((both[1:] == both[:-1], [False])) if len(both) else np.zeros(0, bool)
    union = both[~again][:k]
    shared = both[again]
    return union, shared[shared <= union[-1]] if len(union) else shared


def merge(a: str, b: str, k: int = K) -> str:
    return encode(_merged(decode(a), decode(b), k)[0])


def _likeness(x: np.ndarray, y: np.ndarray, k: int = K) -> float:
    if not len(x) and not len(y):
        return 1.0
    union, shared = _merged(x, y, k)
    return len(shared) / len(union)


def resemblance(a: str, b: str, k: int = K) -> float:
    """Estimated Jaccard similarity; exact while the union has at most k shingles; two empty sets are alike."""
    return _likeness(decode(a), decode(b), k)


def distinct(a: str, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    v = decode(a)
    return float(len(v)) if len(v) < k else (k - 1) * 2.0 ** (4 * DIGITS) / float(v[-1] + np.uint64(1))


def containment(a: str, b: str, k: int = K) -> float:
    """Estimated share of a's shingles that b has; an empty set is contained in any."""
    n = distinct(a, k)
    return 1.0 if not n else min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / n)


_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_distinct double"
)


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, ghost, doc_id, text), in order within their bucket, each against the one after it."""
    held: tuple | None = None

    def rows() -> Iterator[tuple]:
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            prints = (_truncate(s, K) for _, s in shingle_sets(batch.column(3)))
            for bucket, ghost, doc, text, v in zip(*cols, prints, strict=True):
                yield bucket, ghost, doc, text or "", v

    ready: list[tuple] = []  # (doc, text, values, next text, next values)

    def flush() -> pa.RecordBatch:
        edited, out = [], []
        for _, text, _, after, _ in ready:
            half = len(text) // 2
            edited.append(text[: len(text) - half] + after[:half])
        sets = [_truncate(s, K) for _, s in shingle_sets(pa.array(edited, pa.string()))]
        for (doc, text, v, _, nv), e, ev in zip(ready, edited, sets, strict=True):
            sha = hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest()
            near_next = _likeness(v, nv) if nv is not None else None
            n = float(len(v)) if len(v) < K else (K - 1) * 2.0 ** (4 * DIGITS) / float(v[-1] + np.uint64(1))
            out.append((doc, len(text), sha, encode(v), encode(ev), _likeness(v, ev), near_next, n))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64())
        ready.clear()
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _SCHEMA.split(", ")])

    size = 0
    for row in rows():
        if row[2] is None:
            ready.append((None, row[3], row[4], "", None))
        else:
            if held is not None and held[0] == row[0] and not held[1]:
                ready.append((*held[2:], row[3], row[4]))
            held = row
        size += len(row[3])
        if size >= 1 << 20 and ready:
            yield flush()
            size = 0
    if ready:
        yield flush()


def _longs(values: list[int | None]) -> Column:
    """A constant array: one literal of the plan, however many numbers it holds."""
    return F.split(F.lit(",".join("" if v is None else str(v) for v in values)), ",").try_cast("array<long>")


def fingerprints(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, one row for each row of docs.

    The edited text has its last floor(n/2) code points replaced by the first
    as many of the next document's, in ascending order of id (rows that
    repeat an id: of id and text); the last is followed by the first, a lone
    document by itself.  A null text counts as empty.  A null id is followed
    by nothing: its edited text is the first half, near_next is null.  An
    empty table gives an empty result; other columns are not read.

    Documents are dealt to ranges of ids; each range also gets the first
    document of the range after it, so one shuffle of the texts is enough.
    A row finds its range by bisection, whatever their number.
    """
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * parts
    at = [i / ranges for i in range(1, ranges)]
    edges = sorted(set(map(int, docs.approxQuantile("doc_id", at, 1 / (8 * ranges)))))
    cuts = _longs(edges)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(edges).bit_length()))])
    bucket = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at)) if edges else F.lit(0)
    heads = docs.where("doc_id is not null").groupBy(bucket.alias("bucket")).agg(F.min("doc_id").alias("head")).orderBy("bucket").collect()
    placed = docs.withColumn("bucket", bucket)
    own = placed.select("bucket", F.lit(False).alias("ghost"), "doc_id", "text")
    if heads:
        head, before = [None] * (len(edges) + 1), [None] * (len(edges) + 1)
        for i, r in enumerate(heads):
            head[r["bucket"]], before[r["bucket"]] = r["head"], heads[i - 1]["bucket"]
        first = F.col("doc_id") == F.get(_longs(head), F.col("bucket"))
        ghosts = F.when(first, F.struct(F.get(_longs(before), F.col("bucket")).cast("int").alias("bucket"), F.lit(True).alias("ghost")))
        here = F.struct("bucket", F.lit(False).alias("ghost"))
        both = F.filter(F.array(here, ghosts), lambda x: x.isNotNull())
        own = placed.select(F.explode(both).alias("p"), "doc_id", "text").select("p.*", "doc_id", "text")
    dealt = own.repartition(parts, "bucket").sortWithinPartitions("bucket", "ghost", "doc_id", "text")
    return dealt.mapInArrow(_follow, _SCHEMA)
