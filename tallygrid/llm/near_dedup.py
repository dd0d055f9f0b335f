"""MinHash near-duplicates: bottom-k sketches, inverted lists, exact Jaccard.

Every document gets the smallest values of one hash function over its
five-word shingles: K for the lists, and of WIDE the upper halves, which are
enough for estimates.  Documents with
equal sets are one class.  The retained values of class representatives form
inverted lists; the union of two sketches estimates the overlap and filters
candidates; the full sets decide.

Which values go into lists follows from the link rule: a pair at 0.75 or more
shares at least ``need`` of its retained values, so two such documents meet
in a list of their ``size - need + 1`` rarest ones.  For sets no larger
than k ``need`` is exact; above, it lies DEVIATIONS standard deviations below
the expected 48 of 64, towards 28 for very large sets.

Lists that are still long hold documents that mostly consist of widely shared
passages.  For these documents the same rule is applied once more to their
full sets, where ``need`` is exact, and with their sizes: in a list of
documents of nearly one size only those lead that have enough common values
left for partners of at least that size.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textkit import mix, shingle_sets, signed
from .workspace import Sieve, Workspace, bounded, components, linked_lists

#: Smallest hashes kept for the lists, and for estimating a candidate pair.
K, WIDE = 64, 256
DEVIATIONS = 5.5
#: Logarithm of the ratio of neighbouring size classes.
SIZE_STEP = 0.05
#: Documents of candidate pairs that may be broadcast as ids; beyond it they are joined by a shuffle.
BROADCAST_IDS = 500_000

_SETS = "doc_id long, n_shingles long, d1 long, d2 long, prefix int, low array<long>, wide array<int>"


def _need(size: int, threshold: int, k: int = K) -> int:
    """Retained values that a set of ``size`` shingles shares at least with any set at the threshold."""
    t = threshold / 100
    exact = -(-threshold * size // 100)
    if size <= k:
        # the other set has at most size / t shingles, and all but the k smallest of them are not retained
        return max(1, min(exact, k - (size * (100 - threshold) // threshold)))
    union = size / t
    spread = sqrt(k * t * (1 - t) * (union - k) / (union - 1))
    return max(1, floor(k * t - DEVIATIONS * spread))


def _arrays(values: list[np.ndarray], kind: type) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _sketcher(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, pre, low, wide = [], [], [], [], [], []
            for _, s in shingle_sets(batch.column(1)):
                n.append(len(s))
                with np.errstate(over="ignore"):
                    d1.append(int(signed(mix(s)).sum()))
                    d2.append(int(np.bitwise_xor.reduce(signed(mix(s ^ np.uint64(0x5851F42D4C957F2D)))) if len(s) else 0))
                kept = min(len(s), K)
                pre.append(kept - _need(len(s), threshold) + 1 if kept else 0)
                low.append(signed(s[:K]))
                wide.append((s[:WIDE] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                    pa.array(pre, pa.int32()), _arrays(low, np.int64), _arrays(wide, np.int32),
                ],
                names=[x.split()[0] for x in _SETS.split(", ")],
            )

    return run


def _lists(column: pa.Array, kind: type) -> list[np.ndarray]:
    values, offs = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b].view(kind) for a, b in zip(offs[:-1], offs[1:], strict=True)]


def _by_sketch(threshold: int):
    """Keep the pairs whose union sketch allows the threshold: (a, b, n_a, n_b, w_a, w_b).

    Halves of hashes that agree by chance only make a pair look nearer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_n, b_n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            keep = np.zeros(len(a_n), bool)
            for i, (x, y) in enumerate(zip(_lists(batch.column(4), np.uint32), _lists(batch.column(5), np.uint32), strict=True)):
                if 100 * min(a_n[i], b_n[i]) < threshold * max(a_n[i], b_n[i]):
                    continue
                both = np.sort(np.concatenate((x, y)))
                again = both[1:] == both[:-1]
                shared, union = both[1:][again], np.concatenate((both[:1], both[1:][~again]))
                if max(a_n[i], b_n[i]) <= WIDE:
                    keep[i] = 100 * len(shared) >= threshold * len(union)
                else:
                    last = union[min(WIDE, len(union)) - 1]
                    keep[i] = np.count_nonzero(shared <= last) >= _need(int(min(a_n[i], b_n[i])), threshold, WIDE)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def _by_low(threshold: int):
    """Whether the K smallest values of two documents, row by row, may be those of a pair at the threshold."""

    def match(a: pa.Table, b: pa.Table) -> np.ndarray:
        n_a, n_b = (t.column("n_shingles").to_numpy() for t in (a, b))
        need_a, need_b = (np.array([_need(int(n), threshold) for n in x]) for x in (n_a, n_b))
        need = np.where(n_a[:, None] <= n_b[None, :], need_a[:, None], need_b[None, :])
        x, y = (_lists(t.column("low").combine_chunks(), np.uint64) for t in (a, b))
        rows_x, rows_y = (np.repeat(np.arange(len(z)), [len(v) for v in z]) for z in (x, y))
        x, y = np.concatenate(x), np.concatenate(y)
        both = np.intersect1d(x, y)
        shared = np.zeros((len(n_a), len(n_b)), np.float32)
        for at in range(0, len(both), 2048):
            some = both[at : at + 2048]
            sides = []
            for values, rows, n in ((x, rows_x, len(n_a)), (y, rows_y, len(n_b))):
                k = np.minimum(np.searchsorted(some, values), len(some) - 1)
                hit = some[k] == values
                m = np.zeros((n, len(some)), np.float32)
                m[rows[hit], k[hit]] = 1
                sides.append(m)
            shared += sides[0] @ sides[1].T
        close = 100 * np.minimum(n_a[:, None], n_b[None, :]) >= threshold * np.maximum(n_a[:, None], n_b[None, :])
        return close & (shared >= need)

    return match


def _exactly(threshold: int):
    """Keep the pairs whose full sets meet the threshold: (a, b, text_a, text_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                uniq = batch.column(2).dictionary_encode()
                sets = dict(shingle_sets(uniq.dictionary))
                keep = np.zeros(batch.num_rows, bool)
                index = uniq.indices.to_numpy()
                for i, y in shingle_sets(batch.column(3)):
                    x = sets[index[i]]
                    both = np.sort(np.concatenate((x, y)))
                    shared = int(np.count_nonzero(both[1:] == both[:-1]))
                    keep[i] = 100 * shared >= threshold * (len(both) - shared)
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"]
                )

    return run


def _full_sets(threshold: int):
    """(node, text) to a row for each shingle: (key, set, node, size, prefix); set names the document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            for i, s in shingle_sets(batch.column(1)):
                n = len(s)
                pre = n - -(-threshold * n // 100) + 1
                with np.errstate(over="ignore"):
                    name = mix(mix(s).sum(keepdims=True) ^ node[i : i + 1].view(np.uint64))
                cols = (signed(s), np.full(n, signed(name)[0]), np.full(n, node[i]), np.full(n, n, np.int32), np.full(n, pre, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "set", "node", "size", "prefix"])

    return run


def _rarest(every: DataFrame) -> DataFrame:
    """every(key, set, size, prefix, ...) of each set's ``prefix`` values that the fewest sets have, with rest and prev.

    Any one order of all values keeps the guarantee; the rarest first keeps
    values of passages that very many documents share out of the lists.
    Values that one set alone has come first and need no list.  rest is the
    number of the set's values from key on, prev the shared value before key.
    """
    shared = every.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    held = every.join(shared, "key")
    order = Window.partitionBy("set").orderBy("df", "key")
    ranked = held.withColumn("rank", F.row_number().over(order)).withColumn("prev", F.lag("key").over(order))
    ranked = ranked.withColumn("held", F.count("*").over(Window.partitionBy("set")))
    place = F.col("rank") + F.col("size") - F.col("held")
    return ranked.where(place <= F.col("prefix")).withColumn("rest", F.col("size") - place + 1).drop("df", "rank", "held", "prefix")


def _by_size(ranked: DataFrame, threshold: int) -> DataFrame:
    """(key, node, lead, prev) from full sets' (key, node, size, rest, prev): lists split by classes of the smaller size.

    Where a pair's first common value leaves ``rest`` values from there on,
    it shares at most so many; at the threshold t that allows partners of up
    to rest * (1 + t) / t - size shingles.  A document leads in the class of
    its own size if that allows partners no smaller than itself, and stands
    in the classes of smaller partners that it allows.  Whoever stands or
    leads in a class at a value does so at all the set's values before it.
    """
    t = threshold / 100
    most = F.floor(F.col("rest") * (1 + t) / t - F.col("size") + 1e-9)
    place = lambda x: F.floor(F.log(x.cast("double")) / SIZE_STEP).cast("int")
    least, most_smaller = F.greatest(F.lit(1), F.ceil(F.col("size") * t - 1e-9)), F.least("size", most)
    rows = ranked.withColumn("own", place(F.col("size"))).withColumn("leads", most >= F.col("size"))
    rows = rows.where(most_smaller >= least).withColumn("at", F.explode(F.sequence(place(least), place(most_smaller))))
    lead = F.col("leads") & (F.col("at") == F.col("own"))
    prev = F.when(F.col("prev").isNotNull(), F.xxhash64("prev", "at"))
    out = rows.select(F.xxhash64("key", "at").alias("key"), "node", lead.alias("lead"), prev.alias("prev"))
    # an id with several texts stands in a list once and has no place in an order
    return out.groupBy("key", "node").agg(F.max("lead").alias("lead"), F.when(F.count("*") == 1, F.min("prev")).alias("prev"))


def near_duplicates(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 75
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs.

    Documents are linked when 100 * |A n B| >= threshold * |A u B| over their
    sets of distinct five-word shingles; component_id is the smallest id
    reachable.  Null, empty and blank texts have no shingles and are linked
    with nothing; a null id is kept, with a null component, and linked with
    nothing.  Rows that repeat an id share its component, reached through any
    of their texts.  Only the two named columns are read, so further columns
    may have any names.  An empty table gives an empty result.
    """
    ws = Workspace(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    digest = ["n_shingles", "d1", "d2"]
    sets = ws.cut(docs.mapInArrow(_sketcher(threshold), _SETS))
    ids = ws.cut(sets.select("doc_id", *digest))
    real = ids.where("n_shingles > 0 and doc_id is not null")
    repeated = not real.groupBy("doc_id").count().where("count > 1").isEmpty()
    classes = ws.cut(real.groupBy(*digest).agg(F.min("doc_id").alias("rep")))
    firsts = sets.join(classes, digest).where("doc_id = rep").dropDuplicates(["doc_id", *digest])
    reps = ws.cut(firsts.select(F.col("rep").alias("node"), F.xxhash64("rep", "d1", "d2").alias("set"), "n_shingles", "prefix", "low", "wide"))
    ws.drop(sets)

    def verify(pairs: DataFrame) -> DataFrame:
        a = reps.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("wide").alias("w_a"))
        b = reps.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("wide").alias("w_b"))
        near = pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b", "w_a", "w_b")
        near = ws.cut(near.mapInArrow(_by_sketch(threshold), "a long, b long").distinct())
        wanted = ws.cut(near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct())
        texts = docs.join(bounded(wanted, BROADCAST_IDS), "doc_id")
        texts = ws.cut(texts.distinct() if repeated else texts)
        pairs = near.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        pairs = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        out = ws.cut(pairs.select("a", "b", "text_a", "text_b").mapInArrow(_exactly(threshold), "a long, b long").distinct())
        ws.drop(near, wanted, texts)
        return out

    def refine(nodes: DataFrame) -> DataFrame:
        wanted = ws.cut(nodes.withColumnRenamed("node", "doc_id"))
        some = docs.join(bounded(wanted, BROADCAST_IDS), "doc_id").select("doc_id", "text")
        rows = some.mapInArrow(_full_sets(threshold), "key long, set long, node long, size int, prefix int")
        return _by_size(_rarest(rows), threshold)

    every = reps.select(F.explode("low").alias("key"), "set", F.size("low").alias("size"), "prefix")
    listed = _rarest(every).select("key", "set").join(reps.select("set", "node"), "set").select("key", "node")
    sieve = Sieve(reps.select("node", "n_shingles", "low"), _by_low(threshold))
    labels = linked_lists(ws, listed, verify, sieve, refine=refine)
    # An id with several different texts ties its classes together.
    if repeated:
        split = real.groupBy("doc_id").agg(F.min("d1").alias("x"), F.max("d1").alias("y"), F.min("d2").alias("p"), F.max("d2").alias("q"))
        split = split.where("x <> y or p <> q").select("doc_id")
        more = real.join(split, "doc_id").join(classes, digest).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        old = labels.select(F.col("node").alias("a"), F.col("comp").alias("b"))
        labels = ws.cut(components(ws, old.union(more)))
    named = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = ws.cut(named.select(*digest, F.coalesce("comp", "rep").alias("component_id")))
    out = real.join(named, digest).select("doc_id", "n_shingles", "component_id")
    alone = ids.where("n_shingles = 0 or doc_id is null")
    out = out.union(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    out = ws.cut(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
    ws.drop(ids, classes, reps, labels, named)
    return out


def without_near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, whose id is the smallest of its component.

    Rows that repeat an id go or stay together; a null id stays.
    """
    ws = Workspace(spark)
    gone = ws.cut(near_duplicates(spark, docs).where("not kept").select(F.col("doc_id").alias("id")).distinct())
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    return row.join(bounded(gone, BROADCAST_IDS), "id", "left_anti").select("row.*")
