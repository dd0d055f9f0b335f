"""Best-fit packing under conflicts.

Documents are laid into bins of fixed capacity, longest first, each into the
bin with the smallest sufficient residual that has no conflict.  Bins stand
in order of their residual and carry bitmaps of the sources and duplicate
clusters they hold; the search goes from one residual to the next larger one
until a compatible bin is found, else a new bin is opened.

A bin may not hold two documents of one duplicate cluster, nor more than
``per_source`` of one source: for each source a bin has ``per_source`` bit
planes, and a set bit in the last one is a conflict.

Shards of about SHARD_TOKENS tokens are packed independently; rows are dealt to
them by a hash of all that tells them apart, and equal rows by their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .textkit import column_bytes, groups, words

CAPACITY = 2048
PER_SOURCE = 2
SHARD_TOKENS = 1_000_000
#: Members of a cluster in a shard beyond which its bins are told apart as a kind.
FREQUENT = 16
#: Rows without any difference that one row stands for while they are dealt to shards.
BLOCK = 4096


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, source, cluster, text) to word counts plus one end token."""
    for batch in batches:
        raw, offsets = column_bytes(batch.column(3))
        n = np.empty(batch.num_rows, np.int64)
        for i, j in groups(offsets):
            lo = offsets[i]
            _, _, first = words(raw[lo : offsets[j]], offsets[i : j + 1] - lo)
            n[i:j] = np.diff(first) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n)], names=["doc_id", "source", "cluster", "n_tokens"])


class Bins:
    """Open bins by residual; those of one residual by what they refuse, each kind's bins in order of opening.

    A kind is the mask of the sources a bin can take no more of and of the
    frequent clusters it holds: a kind that conflicts with a piece is passed
    over whole.  Members of rare clusters are tried one by one.  A bin that
    is closed to ``every`` source of the shard is taken out.
    """

    def __init__(self, capacity: int, per_source: int, every: int = 0, frequent: int = 0):
        self.capacity, self.per_source, self.every, self.frequent = capacity, per_source, every, frequent
        self.kinds: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(capacity + 1)]
        self.tops: list[list[tuple[int, tuple[int, int]]]] = [[] for _ in range(capacity + 1)]
        self.mask = 0  # the residuals that have bins
        self.planes: list[list[int]] = []
        self.clusters: list[int] = []
        self.used: list[int] = []

    def open(self) -> int:
        self.planes.append([0] * self.per_source)
        self.clusters.append(0)
        self.used.append(0)
        return len(self.used) - 1

    def _add(self, residual: int, b: int) -> None:
        kind = (self.planes[b][-1], self.clusters[b] & self.frequent)
        own = self.kinds[residual].setdefault(kind, [])
        heappush(own, b)
        if own[0] == b:
            heappush(self.tops[residual], (b, kind))
        self.mask |= 1 << residual

    def _take(self, residual: int, source: int, cluster: int) -> int | None:
        """The first bin of a residual, by opening, that a piece may enter; it is taken out."""
        kinds, tops, passed, found = self.kinds[residual], self.tops[residual], [], None
        while tops and found is None:
            top = heappop(tops)
            b, kind = top
            own = kinds.get(kind)
            if not own or own[0] != b:
                continue  # the kind's first bin is another by now, and has its own entry
            if kind[0] & source or kind[1] & cluster:
                passed.append(top)
                continue
            heappop(own)
            if self.clusters[b] & cluster:
                passed.append((b, None))
            else:
                found = b
            if own:
                heappush(tops, (own[0], kind))
            else:
                del kinds[kind]
        for b, kind in passed:
            if kind is None:
                self._add(residual, b)
            else:
                heappush(tops, (b, kind))
        if not kinds:
            self.mask &= ~(1 << residual)
        return found

    def place(self, size: int, source: int, cluster: int) -> int:
        """The bin for a piece; source and cluster are single-bit masks, 0 for none."""
        rest = self.mask >> size << size
        while rest:
            low = rest & -rest
            b = self._take(low.bit_length() - 1, source, cluster)
            if b is not None:
                return self.put(b, size, source, cluster)
            rest ^= low
        return self.put(self.open(), size, source, cluster)

    def put(self, b: int, size: int, source: int, cluster: int) -> int:
        for plane in range(self.per_source):
            had = self.planes[b][plane] & source
            self.planes[b][plane] |= source
            source = had
        self.clusters[b] |= cluster
        self.used[b] += size
        left = self.capacity - self.used[b]
        if left and not (self.every and self.planes[b][-1] & self.every == self.every):
            self._add(left, b)
        return b


def _packer(capacity: int, per_source: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["n_tokens", "doc_id", "source", "cluster"], ascending=[False, True, True, True], kind="stable", na_position="last")
        again = shard["cluster"].duplicated(keep=False) & shard["cluster"].notna()
        cluster_bits = np.where(again, pd.factorize(shard["cluster"])[0], -1)
        source_bits = pd.factorize(shard["source"])[0]  # -1 for null: no conflict
        sizes = np.bincount(cluster_bits[cluster_bits >= 0], minlength=1)
        frequent = sum(1 << int(c) for c in np.flatnonzero(sizes > FREQUENT))
        every = (1 << int(source_bits.max()) + 1) - 1 if len(source_bits) and source_bits.min() >= 0 else 0
        bins, out = Bins(capacity, per_source, every, frequent), []
        position: dict[int, int] = {}
        pieces = []
        for doc, n, s, c in zip(shard["doc_id"], shard["n_tokens"], source_bits, cluster_bits, strict=True):
            s, c = (1 << int(s) if s >= 0 else 0), (1 << int(c) if c >= 0 else 0)
            whole = n // capacity * capacity
            for start in range(0, whole, capacity):
                pieces.append((capacity, doc, start, s, c))
            if n > whole:
                pieces.append((n - whole, doc, whole, s, c))
        pieces.sort(key=lambda x: -x[0])
        for size, doc, start, s, c in pieces:
            b = bins.place(size, s, c)
            k = position[b] = position.get(b, -1) + 1
            out.append((b, k, doc, start, size))
        got = pd.DataFrame(out, columns=["bin", "position", "doc_id", "start", "n_tokens"])
        return got.assign(shard=int(shard["shard"].iloc[0]), used=[bins.used[b] for b in got["bin"]])

    return run


def _numbered(sized: DataFrame) -> DataFrame:
    """Rows with ``copy``, the number of each among those without any difference, so that a shard need not hold all of these.

    They are counted and written out again in blocks: no task holds them all, and a task run anew numbers them as before.
    """
    cols = sized.columns
    counted = sized.groupBy(*cols).agg(F.count("*").alias("m"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / BLOCK))))
    blocks = blocks.repartition(*cols, "block")
    last = F.least(F.col("m"), (F.col("block") + 1) * BLOCK) - 1
    return blocks.select(*cols, F.explode(F.sequence(F.col("block") * BLOCK, last)).alias("copy"))


def pack(
    spark: SparkSession,
    docs: DataFrame,
    clusters: DataFrame | None = None,
    capacity: int = CAPACITY,
    per_source: int = PER_SOURCE,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """(shard, bin, position, doc_id, start, n_tokens, used): a row for every piece of every row of docs.

    A token is a word; every document has one end token, so null and empty
    texts take one.  A document longer than the capacity is cut into full
    pieces and a rest; nothing is dropped.  ``clusters(doc_id, cluster)``
    names duplicate clusters; without it equal texts are one.  A null source
    never conflicts, nor do null and empty texts without ``clusters``.  Ties go by id; rows that repeat an id are separate
    documents, and so are rows without an id.  An empty table gives an empty result.

    A bin holds at most ``per_source`` pieces of a source: with few sources, and without null ones, bins
    are closed after sources * per_source pieces and stay as empty as these leave them.
    """
    ship(spark)
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")).alias("source"),
        F.when(F.octet_length("text") > 0, F.xxhash64("text")).alias("cluster"),
        F.col("text").cast("string").alias("text"),
    )
    if clusters is not None:
        named = clusters.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("cluster").cast("long").alias("named"))
        docs = docs.join(named, "doc_id", "left").select("doc_id", "source", F.col("named").alias("cluster"), "text")
    sized = docs.mapInArrow(_count, "doc_id long, source string, cluster long, n_tokens long")
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    shards = 1 + total // shard_tokens
    sized = _numbered(sized)
    sized = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "source", "cluster", "n_tokens", "copy"), F.lit(shards))).drop("copy")
    schema = "bin long, position long, doc_id long, start long, n_tokens long, shard long, used long"
    out = sized.groupBy("shard").applyInPandas(_packer(capacity, per_source), schema)
    return out.select("shard", "bin", "position", "doc_id", "start", "n_tokens", "used")
