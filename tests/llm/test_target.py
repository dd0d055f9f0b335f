from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallygrid.llm import target


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(docs, items, percent=10, least=20, seed=2024, buckets=10000):
    bucket = lambda w: zlib.crc32(w.encode()) % buckets
    raw, aim = Counter(bucket(w) for _, t in docs for w in words(t)), Counter(bucket(w) for t in items for w in words(t))
    s_all, t_all = raw.total(), aim.total()
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for doc, text in docs:
        w = words(text)
        weight = math.floor(sum(gain[bucket(x)] for x in w) / len(w)) if w else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abZ09 -é語'\n\x00ß"), max_size=120), max_size=12))
def test_word_buckets(texts):
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    got, first = target.word_buckets(np.frombuffer(b"".join(data), np.uint8), offsets, 10000)
    want = [[zlib.crc32(w.encode()) % 10000 for w in words(t)] for t in texts]
    assert [list(got[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)] == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9)), max_size=9))
def test_tournament(runs):
    runs = [sorted(r) for r in runs]
    assert [runs[r][i] for r, i in target.tournament(runs)] == list(heapq.merge(*runs))


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x or 0) for x in r))


@pytest.fixture(scope="module")
def corpus_and_target(spark):
    r = random.Random(8)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"Word{i}" for i in range(400)]
    docs = [(i * 3, " ".join(r.choice(vocabulary[: 60 if i % 4 == 0 else 400]) for _ in range(r.randint(5, 60)))) for i in range(400)]
    docs += [(5000, None), (5001, ""), (5002, "... --- \n"), (5003, "word1 " * 20000), (None, "word1 word2 " * 15), (5004, "語" * 30000)]
    items = [" ".join(r.choice(vocabulary[:60]) for _ in range(30)) for _ in range(20)] + [None, ""]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in items], "text string")


@pytest.mark.parametrize("range_rows, run_rows, percent", [(1 << 16, 1 << 17, 10), (7, 20, 10), (3, 1, 60), (2, 9, 100), (50, 50, 0)])
def test_against_counting(spark, corpus_and_target, range_rows, run_rows, percent):
    docs, items, df, aim = corpus_and_target
    got = target.target_resample(spark, df, aim, percent=percent, range_rows=range_rows, run_rows=run_rows).collect()
    assert ordered(got) == ordered(plain(docs, items, percent))


def test_crowded_scores_and_one_id_for_many_rows(spark, corpus_and_target):
    """Ranges of a few rows where a third of all rows are one row, and scores are crowded with ids."""
    _, items, _, aim = corpus_and_target
    docs = [(7 if i % 3 == 0 else i, "word1 word2 word3 " * 9) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    for percent in (20, 50, 90):
        got = target.target_resample(spark, df, aim, percent=percent, range_rows=4).collect()
        assert ordered(got) == ordered(plain(docs, items, percent))


def test_ranges_cut_a_score_by_ids(spark):
    scored = spark.range(1000).selectExpr("id as doc_id", "cast(id % 2 as long) as score")
    neg, ids, lowest = target._cuts(None, scored, 700, 100)
    assert lowest == 0 and len(neg) >= 10 and list(neg) == sorted(neg)
    at = target._range_of(np.array([-(i % 2) for i in range(1000)]), np.arange(1000), neg, ids)
    assert max(Counter(at.tolist()).values()) <= 110
    order = sorted(range(1000), key=lambda i: (-(i % 2), i))
    assert list(at[order]) == sorted(at)


def test_edge_tables(spark, corpus_and_target, nothing, odd):
    docs, items, df, aim = corpus_and_target
    assert target.target_resample(spark, nothing, aim).count() == 0
    none = aim.where("false")
    assert ordered(target.target_resample(spark, df, none).collect()) == ordered(plain(docs, []))
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    clash = odd.selectExpr("doc_id", "text", "1 as rank", "2 as score", "3 as range", "'x' as n", "true as eligible")
    assert ordered(target.target_resample(spark, clash, aim, percent=50).collect()) == ordered(plain(rows, items, 50))
