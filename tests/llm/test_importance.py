from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.llm import importance as im


@pytest.fixture(scope="module")
def graded(spark):
    r = random.Random(3)
    good, bad = [f"good{i}" for i in range(60)], [f"junk{i}" for i in range(60)]
    docs = [(i, " ".join(r.choice(good if i % 3 else bad) for _ in range(40))) for i in range(300)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 300, 2)]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_keeps_what_is_like_the_target(spark, graded):
    got = im.resample(spark, *graded, share=2 / 3).collect()
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert len(kept) == 200 and len([i for i in kept if i % 3]) >= 198


def test_top_k_is_exact(spark, graded, monkeypatch):
    monkeypatch.setattr(im, "_EXACT_ROWS", 5)
    got = im.resample(spark, *graded, share=0.31).collect()
    order = sorted(got, key=lambda r: (-r["key"], r["doc_id"]))
    assert [r["kept"] for r in order] == [True] * 93 + [False] * 207


def test_same_draw_whatever_the_order(spark, graded):
    docs, labels = graded
    a = sorted(map(tuple, im.resample(spark, docs, labels).collect()))
    assert a == sorted(map(tuple, im.resample(spark, docs.repartition(7), labels).collect()))


def test_edge_tables(spark, graded, nothing, odd):
    labels = graded[1]
    assert im.resample(spark, nothing, labels).count() == 0
    assert im.resample(spark, odd, labels, share=0.5).where("kept").count() in (3, 4)  # equal rows stay together
    none = labels.where("quality = 7")
    assert im.resample(spark, graded[0], none).where("log_weight <> 0 or kept").count() == 0


def test_weights_and_keys_against_counting(spark, graded):
    """Features, log ratios, noise and choice by plain dictionaries and arithmetic."""
    docs, labels = graded
    odd = spark.createDataFrame([(900, None), (901, ""), (902, " \n"), (903, "good1"), (903, "good1"), (904, "good1 new " * 30000), (None, "junk1 good2 junk3")], docs.schema)
    docs = docs.union(odd)
    labels = labels.union(spark.createDataFrame([(0, 1, 0), (2, 1, 1), (903, 1, None), (903, 0, 0), (5000, 1, 0), (None, 1, 0)], labels.schema))
    buckets, share, seed = 512, 0.4, 5

    def features(text):
        h = [int(im.word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0]) for w in (text or "").encode().split()]
        pairs = [int(im.ngram_hashes(np.array(p, np.uint64), 2)[0]) for p in zip(h, h[1:], strict=False)]
        return [x % buckets for x in h + pairs]

    bits = F.xxhash64(F.lit(seed), "doc_id", "text")
    rows = [(r["doc_id"], features(r["text"]), r["bits"] % 2**64 >> 11, r["tie"]) for r in docs.select("*", bits.alias("bits"), F.xxhash64("text").alias("tie")).collect()]
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and not r["toxic"]} - {None}
    raw, target = Counter(b for r in rows for b in r[1]), Counter(b for r in rows if r[0] in good for b in r[1])
    scale = target.total() / raw.total()
    ratio = {b: math.log((target[b] + im.LENT) / (raw[b] * scale + im.LENT)) for b in raw}
    want = []
    for doc, bs, noise, tie in rows:
        weight = sum(ratio[b] for b in bs)
        want.append([doc, len(bs), weight, weight - math.log(-math.log((noise + 0.5) / 2**53)), tie])
    want.sort(key=lambda r: (-r[3], -(2**63) if r[0] is None else r[0], r[4]))
    last = want[int(share * len(want)) - 1][3]
    got = sorted(im.resample(spark, docs, labels, share, seed, buckets).collect(), key=lambda r: (-r["key"], -(2**63) if r["doc_id"] is None else r["doc_id"]))
    assert [(r["doc_id"], r["n_features"], r["kept"]) for r in got] == [(w[0], w[1], w[3] >= last) for w in want]
    for r, w in zip(got, want, strict=True):
        assert r["log_weight"] == pytest.approx(w[2], rel=1e-9, abs=1e-9) and r["key"] == pytest.approx(w[3], rel=1e-9, abs=1e-9)


def test_clashing_columns_are_not_read(spark, documents):
    labels = documents.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("quality"), F.lit(0).alias("toxic"), F.lit(9).alias("key"), F.lit("x").alias("text"))
    got = im.resample(spark, documents.withColumn("log_weight", F.lit(1)).withColumn("tie", F.lit(2)).withColumn("noise", F.lit(3)), labels)
    assert got.columns == ["doc_id", "n_features", "log_weight", "key", "kept"]
    bare = im.resample(spark, documents.select("doc_id", "text"), labels.select("doc_id", "quality", "toxic"))
    assert sorted(map(str, got.collect())) == sorted(map(str, bare.collect()))
