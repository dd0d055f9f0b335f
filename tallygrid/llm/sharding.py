"""Shards of equal bytes by Karmarkar-Karp differencing.

Documents of one text form a group that no shard boundary may cut.  The groups
are combined by k-way differencing: every unit starts as a partial partition
with its bytes in one place and nothing in the others; again and again the two
partial partitions of the largest spread are laid on each other in opposite
order, the heaviest place of one on the lightest of the other, until one is
left.  Its places are the shards.

Units are the groups that hold at least 1/HEAVY of all bytes, each alone, and
PARCELS hash classes of all others; so what the driver combines is bounded
whatever the table holds, and a group, whole in its class, never falls apart.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace, bounded

SHARDS = 24
#: Classes of light groups; the driver combines at most PARCELS + HEAVY units.
PARCELS = 1 << 15
#: A group of at least this part of all bytes is a unit of its own.
HEAVY = 1 << 12
#: Bytes that a row takes besides its text.
ROW_BYTES = 8
#: Rows of the table of offsets (a few for each partition) that may be broadcast.
BROADCAST_ROWS = 100_000


def difference(sizes: list[int], shards: int) -> list[int]:
    """The shard of each unit by k-way largest differencing method.

    Ties in spread go to the partial partition made first, units in the order
    given; equal input gives an equal result.
    """
    if not sizes:
        return []
    # a place is (bytes above the lightest place, tree); a tree is -1, a unit, or len(sizes) + index of a join of two
    joins: list[tuple[int, int]] = []
    n = len(sizes)
    heap = []
    for unit, size in enumerate(sizes):
        places = [(size, unit)] + [(0, -1)] * (shards - 1)
        heap.append((-(size if shards > 1 else 0), unit, places))
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = []
        for (x, s), (y, t) in zip(a, reversed(b), strict=True):
            if s >= 0 and t >= 0:
                joins.append((s, t))
                s = n + len(joins) - 1
            both.append((x + y, s if s >= 0 else t))
        both.sort(key=lambda p: -p[0])
        low = both[-1][0]
        heapq.heappush(heap, (low - both[0][0], made, [(x - low, s) for x, s in both]))
        made += 1
    out = [0] * n
    for shard, (_, root) in enumerate(heap[0][2]):
        stack = [root] if root >= 0 else []
        while stack:
            tree = stack.pop()
            if tree < n:
                out[tree] = shard
            else:
                stack.extend(joins[tree - n])
    return out


def _units(ws: Workspace, sized: DataFrame, shards: int, parcels: int, heavy: int) -> tuple[DataFrame, DataFrame]:
    """(parcel, parcel_shard) of the classes and (text_key, own_shard) of the heavy groups, both bounded."""
    grouped = ws.cut(sized.groupBy("text_key").agg(F.sum("size").alias("bytes")), True)
    total = grouped.agg(F.sum("bytes")).first()[0] or 0
    alone = F.col("bytes").cast("decimal(38,0)") * heavy >= total
    large = grouped.where(alone).orderBy(F.desc("bytes"), "text_key").collect()
    rest = grouped.where(~alone).groupBy(F.pmod("text_key", F.lit(parcels)).alias("parcel")).agg(F.sum("bytes").alias("bytes"))
    small = rest.orderBy(F.desc("bytes"), "parcel").collect()
    ws.drop(grouped)
    shard = difference([r["bytes"] for r in large] + [r["bytes"] for r in small], shards)
    spark = ws.spark
    own = spark.createDataFrame([(r["text_key"], s) for r, s in zip(large, shard, strict=False)], "text_key long, own_shard int")
    shared = spark.createDataFrame([(r["parcel"], s) for r, s in zip(small, shard[len(large) :], strict=True)], "parcel long, parcel_shard int")
    return shared, own


def shard_documents(
    spark: SparkSession, docs: DataFrame, shards: int = SHARDS, parcels: int = PARCELS, heavy: int = HEAVY
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row for each row of docs.

    The law is `bytes`: the shards' sums of size differ as little as
    differencing gets them.  size is the UTF-8 bytes of the text plus 8.
    Documents of equal text share a shard, whatever that does to the balance;
    null and empty texts are one group of 0 bytes a text.  Texts are told apart by 64-bit hashes:
    two that collide are held together and counted in full.  slot counts the rows of a shard
    from 0 without gaps by (doc_id, size, text_crc32), a null id first; rows that
    repeat an id are rows of their own.  grown_shard is null, since no key law
    holds.  Columns other than doc_id and text are not read.  With fewer units than shards some
    shards stay empty; an empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    ws = Workspace(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_BYTES).cast("long")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_key"),
    )
    sized = ws.cut(sized)
    shared, own = _units(ws, sized, shards, parcels, heavy)
    placed = sized.withColumn("parcel", F.pmod("text_key", F.lit(parcels))).join(F.broadcast(shared), "parcel", "left").join(F.broadcast(own), "text_key", "left")
    placed = placed.select("doc_id", "size", "text_crc32", F.coalesce("own_shard", "parcel_shard").alias("shard"))
    order = ["shard", "doc_id", "size", "text_crc32"]
    # the number holds the partition above 33 bits and the row's place in it below, so it ascends with the order
    laid = ws.cut(placed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", F.monotonically_increasing_id()))
    ws.drop(sized)
    part = F.shiftright("number", 33).alias("part")
    starts = laid.groupBy("shard", part).agg(F.min("number").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ws.cut(starts.select("shard", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), True)
    out = laid.withColumn("part", part).join(bounded(starts, BROADCAST_ROWS), ["shard", "part"])
    slot = F.col("before") + F.col("number") - F.col("first")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
