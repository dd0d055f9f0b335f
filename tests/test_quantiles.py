"""Quantiles and build trees against plain sorting and comparing."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.operators import quantiles as qt
from tallygrid.sources import corpus as co


@pytest.mark.parametrize("few", [10_000, 50, 1])
def test_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(qt, "FEW", few)
    r = random.Random(few)
    groups = {
        "smooth": [r.random() for _ in range(6000)], "skewed": [r.expovariate(1) ** 4 for _ in range(3000)], "tied": [float(r.choice((0, 0, 0, 1, 2))) for _ in range(2000)],
        "almost": [1.0] * 1500 + [2.0, 0.5], "one": [3.5], "two": [1.0, 2.0], "none": [None, None], None: [4.0, 8.0, None],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = (0.0, 0.05, 0.5, 0.95, 0.99, 1.0)
    got = {(x["g"], x["p"]): x["quantile"] for x in qt.quantiles(df, "v", shares, "g").collect()}
    assert len(got) == len(groups) * len(shares)
    for g, vs in groups.items():
        vs = [v for v in vs if v is not None]
        for p in shares:
            assert got[g, p] == (pytest.approx(float(np.quantile(vs, p)), rel=1e-12) if vs else None), (g, p)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([], "v double")
    assert [r["quantile"] for r in qt.quantiles(empty, "v", (0.5,)).collect()] in ([], [None])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"d{i}", "clean" if i % 3 else "injected", f"text {i}") for i in range(500)] + [("n", None, None), ("e", "clean", "")]
    return spark.createDataFrame(rows, "id string, label string, text string")


def test_trees_know_what_changed(spark, docs):
    edited = docs.where("id <> 'd7'").withColumn("text", F.when(F.col("id").isin("d100", "n"), "new").otherwise(F.col("text")))
    edited = edited.union(spark.createDataFrame([("d900", "clean", None)], docs.schema))
    got = {r["id"]: r["change"] for r in co.changed_documents(docs, edited).collect()}
    assert got == {"d7": "removed", "d100": "edited", "n": "edited", "d900": "added"}
    nodes = {r["node"]: (r["n_before"], r["n_after"]) for r in co.changed_ranges(co.tree(docs), co.tree(edited)).collect()}
    assert 1 <= len(nodes) <= 4 and all(len(n) == co.DEPTH for n in nodes)
    assert co.changed_documents(docs, docs.repartition(9)).count() == 0
    assert co.fingerprint(docs).first() == co.fingerprint(docs.repartition(9)).first() != co.fingerprint(edited).first()
    assert co.fingerprint(docs.union(docs.limit(1))).first() != co.fingerprint(docs).first()


def test_nodes_are_hashes_of_their_children(docs):
    import hashlib

    nodes = {r["node"]: r for r in co.tree(docs).collect()}
    for name, node in nodes.items():
        children = sorted(n for n in nodes if len(n) == len(name) + 1 and n.startswith(name))
        if children:
            assert node["n"] == sum(nodes[c]["n"] for c in children)
            assert node["digest"] == hashlib.sha256(";".join(f"{c}={nodes[c]['digest']}" for c in children).encode()).hexdigest()
    assert nodes[""]["n"] == 502 and co.fingerprint(docs).first()[0] == nodes[""]["digest"][:16]
