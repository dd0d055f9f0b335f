from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallygrid.llm import sharding


def plain_difference(sizes, shards):
    """The differencing method with lists of units and a sort at every step; returns the final sums."""
    parts = [(i, [(s, [i])] + [(0, [])] * (shards - 1)) for i, s in enumerate(sizes)]
    made = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(max(x for x, _ in p[1]) - min(x for x, _ in p[1])), p[0]))
        (_, a), (_, b) = parts[:2]
        a, b = sorted(a, key=lambda x: -x[0]), sorted(b, key=lambda x: x[0])
        parts = [*parts[2:], (made, [(x + y, s + t) for (x, s), (y, t) in zip(a, b, strict=True)])]
        made += 1
    return sorted(x for x, _ in parts[0][1])


def sums(sizes, shard, shards):
    out = [0] * shards
    for size, s in zip(sizes, shard, strict=True):
        out[s] += size
    return sorted(out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(8, 4000), min_size=1, max_size=40), st.integers(1, 6))
def test_differencing_against_plain_lists(sizes, shards):
    assert sums(sizes, sharding.difference(sizes, shards), shards) == plain_difference(sizes, shards)


def test_tighter_than_greedy():
    r = random.Random(4)
    for _ in range(5):
        sizes = [r.randint(100, 20000) for _ in range(400)]
        greedy = [0] * 24
        for s in sorted(sizes, reverse=True):
            greedy[greedy.index(min(greedy))] += s
        got = sums(sizes, sharding.difference(sizes, 24), 24)
        assert got[-1] - got[0] <= max(greedy) - min(greedy)


def check(rows, docs, shards):
    assert Counter(r["doc_id"] for r in rows) == Counter(d[0] for d in docs)
    have = Counter((d[0], len((d[1] or "").encode()) + 8, zlib.crc32((d[1] or "").encode())) for d in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == have
    slots, where = defaultdict(list), defaultdict(set)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append((r["slot"], (r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"])))
        where[(r["size"], r["text_crc32"])].add(r["shard"])
    for s in slots.values():
        s.sort()
        assert [x for x, _ in s] == list(range(len(s))) and [x for _, x in s] == sorted(x for _, x in s)
    assert all(len(s) == 1 for s in where.values())


def test_documents(spark, documents, texts):
    rows = sharding.shard_documents(spark, documents, shards=5).collect()
    check(rows, texts, 5)
    # groups in their own parcels: the sums are those of differencing the groups themselves
    grouped = Counter()
    for d in texts:
        grouped[d[1] or ""] += len((d[1] or "").encode()) + 8
    got = sums([r["size"] for r in rows], [r["shard"] for r in rows], 5)
    assert got == sums(sorted(grouped.values(), reverse=True), sharding.difference(sorted(grouped.values(), reverse=True), 5), 5)


def test_one_text_holds_a_third(spark):
    docs = [(i, "copy " * 40 if i % 3 == 0 else f"text {i} " * (5 + i % 90)) for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    rows = sharding.shard_documents(spark, df, shards=24, parcels=256, heavy=64).collect()
    check(rows, docs, 24)
    by = Counter()
    for r in rows:
        by[r["shard"]] += r["size"]
    copies = 300 * 208
    rest = sorted(v for v in by.values() if v < copies)
    assert max(by.values()) >= copies and len(rest) == 23
    assert rest[-1] - rest[0] < 0.02 * rest[-1]


@pytest.mark.parametrize("partitions", [1, 6])
def test_same_result_whatever_the_order(spark, documents, partitions):
    a = sorted(map(str, sharding.shard_documents(spark, documents).collect()))
    assert a == sorted(map(str, sharding.shard_documents(spark, documents.repartition(partitions)).collect()))


def test_edge_tables(spark, nothing, odd):
    assert sharding.shard_documents(spark, nothing).count() == 0
    check(sharding.shard_documents(spark, odd, shards=3).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()], 3)
    clash = odd.selectExpr("doc_id", "text", "1 as shard", "2 as size", "3 as slot", "4 as text_key", "5 as parcel", "6 as number", "7 as part")
    assert sharding.shard_documents(spark, clash).count() == odd.count()
    with pytest.raises(ValueError):
        sharding.shard_documents(spark, odd, shards=0)
