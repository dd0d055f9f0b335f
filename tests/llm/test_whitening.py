from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallygrid.llm import whitening as wh
from tallygrid.llm.workspace import Workspace

SCHEMA = "vec_id long, embedding array<float>"


def sound(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def plain(rows, components=4):
    """Covariance of the distinct integer vectors, decomposed as a matrix."""
    x = {i: tuple(math.floor(256 * float(np.float32(c))) for c in v) for i, v in enumerate(v for _, v in rows) if sound(v)}
    fit = np.array(sorted(set(x.values())), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = np.array([[float(Fraction(int(n * c - s), n)) for c, s in zip(row, sums, strict=True)] for row in fit])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    out = {}
    for i, own in x.items():
        c = np.array([float(Fraction(int(n * a - s), n)) for a, s in zip(own, sums, strict=True)])
        far = sum(int(n * a - s) ** 2 for a, s in zip(own, sums, strict=True))
        for k in range(min(components, len(e))):
            out[(rows[i][0], k + 1)] = (n, far, c @ u[:, k] / math.sqrt(e[k]), e[k] / np.trace(v))
    return out


def against(got, want):
    assert sorted((r["vec_id"], r["component"]) for r in got) == sorted(want)
    turn = {}
    for r in got:
        n, far, white, explained = want[(r["vec_id"], r["component"])]
        assert (r["n"], r["deviation"]) == (n, far) and r["explained"] == pytest.approx(explained, rel=1e-9)
        assert r["identity_error"] == got[0]["identity_error"] < 1e-9
        if abs(white) > 1e-6:
            turn.setdefault(r["component"], set()).add(np.sign(white) == np.sign(r["whitened"]))
        assert abs(r["whitened"]) == pytest.approx(abs(white), abs=1e-7)
    assert all(len(s) == 1 for s in turn.values())


def vectors(seed=2, n=700, dim=12):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, dim)) * np.linspace(1, 0.1, dim) @ r.normal(size=(dim, dim)) * 0.3).astype(np.float32).tolist()


@pytest.mark.parametrize("partitions", [1, 3, 23])
def test_against_the_covariance(spark, partitions):
    v = vectors()
    rows = [(i, x) for i, x in enumerate(v)] + [(1000 + i, v[5]) for i in range(350)]  # a third are copies of one row
    rows += [(2000, None), (2001, [None, *v[0][1:]]), (2002, [float("nan"), *v[0][1:]]), (2003, [float("inf"), *v[0][1:]])]
    rows += [(3000, [c + 1 / 4096 if c * 256 % 1 < 0.5 else c for c in v[7]])]  # another vector that rounds to the same steps
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        against(wh.whiten(spark, df).collect(), plain(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5), st.lists(st.integers(1, 9), min_size=1, max_size=6), st.integers(0, 10**6))
def test_merging_loses_nothing(dim, parts, seed):
    r = np.random.default_rng(seed)
    blocks = [r.integers(-300, 300, (m, dim)) for m in parts]
    merged = wh.summary(blocks[0])
    for block in blocks[1:]:
        merged = wh.merge(merged, wh.summary(block))
    x = np.concatenate(blocks)
    assert merged.n == len(x) and list(merged.sums) == list(x.sum(axis=0))
    gram = (merged.values[:, None] * merged.vectors).T @ (merged.values[:, None] * merged.vectors)
    c = x - x.mean(axis=0)
    assert np.allclose(gram, c.T @ c, rtol=1e-10, atol=1e-7)


def test_levels(spark):
    x = np.random.default_rng(1).integers(-200, 200, (500, 6))
    rows = [(6, x[i].astype("<i2").tobytes()) for i in range(500)]
    df = spark.createDataFrame(rows, "dim int, x binary").repartition(70)  # three levels
    got = wh.fit(Workspace(spark), df, 6)
    want = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert got.n == 500 and np.allclose(got.values, want, rtol=1e-12)


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(2**50 * (i % 7)), float(i), 3e38 if i == 4 else 1.0]) for i in range(20)]
    got = wh.whiten(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=1).collect()
    x = [[min(math.floor(256 * c), 2**63 - 1) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    for r in got:
        far = sum((20 * a - s) ** 2 for a, s in zip(x[r["vec_id"]], sums, strict=True))
        assert r["deviation"] == (far if far < 2**63 else None)


def test_edge_tables(spark):
    assert wh.whiten(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    assert wh.whiten(spark, spark.createDataFrame([(1, None), (2, [float("nan")]), (3, [])], SCHEMA)).count() == 0
    one = wh.whiten(spark, spark.createDataFrame([(1, [0.5, 0.25]), (None, [0.5, 0.25])], SCHEMA)).collect()
    assert len(one) == 4 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, None, None, None)}
    line = wh.whiten(spark, spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)] + [(9, [1.0])], SCHEMA)).collect()
    assert len(line) == 15 and all((r["whitened"] is None) == (r["component"] > 1) for r in line)
    assert {r["explained"] for r in line if r["component"] == 1} == {1.0}
    clash = spark.createDataFrame([(i, v, 1, "a", 2, 3) for i, v in enumerate(vectors(n=40, dim=3))], "vec_id long, embedding array<float>, x int, dim string, n int, part int")
    against(wh.whiten(spark, clash).collect(), plain([(r["vec_id"], r["embedding"]) for r in clash.collect()]))
