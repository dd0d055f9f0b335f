from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallygrid.llm import near_dedup as nd
from tallygrid.llm import workspace
from tallygrid.llm.near_dedup import near_duplicates
from tallygrid.llm.workspace import Sieve, Workspace, components, linked_lists


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(docs, threshold=75):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            inverted[g].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in inverted[g] if j < i).items():
            if 100 * n >= threshold * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def rows(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_equals_brute_force(spark, documents, texts):
    assert rows(near_duplicates(spark, documents)) == brute([(i, t) for i, t, *_ in texts])


def test_long_lists_of_linked_and_unlinked(spark):
    """A hot passage in many documents, some near copies of each other and some not."""
    hot = " ".join(f"hot{i}" for i in range(60))
    docs = [(i, hot + " " + " ".join(f"own{i % 30}x{k}" for k in range(8 + 6 * (i % 4)))) for i in range(90)]
    docs += [(1000 + i, hot + f" tail{i}") for i in range(40)]
    got = rows(near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == brute(docs)


@pytest.mark.parametrize("n", [48, 49, 63, 64, 65, 200])
def test_edge_of_the_threshold(spark, n):
    words = [f"w{i}" for i in range(n + 4)]
    docs = []
    for k in range(0, n // 2, max(1, n // 24)):
        docs.append((len(docs), " ".join(words[: len(words) - k] + [f"z{k}_{i}" for i in range(k % 5)])))
    got = rows(near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string")))
    assert got == brute(docs)


def test_empty_and_odd(spark, nothing, odd):
    assert near_duplicates(spark, nothing).count() == 0
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_duplicates(spark, odd).collect())
    assert got == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["comp"] for r in components(Workspace(spark), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 140)}


def groups_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in nodes}


def test_lists_lose_no_link(spark):
    """Long lists against all pairs, for a relation that is not transitive."""
    nodes = [(k, 10 * i + k) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(nodes, "key long, node long")

    def verify(pairs):
        return pairs.where("(b - a) in (30, 50) or (a + b) % 97 = 0")

    sieve = Sieve(df.select("node").distinct(), lambda a, b: np.ones((a.num_rows, b.num_rows), bool))
    got = {r["node"]: r["comp"] for r in linked_lists(Workspace(spark), df, verify, sieve, short=4).collect()}
    links = [(a, b) for k, a in nodes for k2, b in nodes if k == k2 and a < b and ((b - a) in (30, 50) or (a + b) % 97 == 0)]
    want = groups_of({n for _, n in nodes}, links)
    assert {n: got.get(n, n) for n in want} == want


def test_unlike_members_take_two_rounds(spark, monkeypatch):
    """A list of 5,000 members, few of them linked, with leaders and earlier keys: tiles try all pairs, verify runs twice."""
    monkeypatch.setattr(workspace, "TILE", 512)
    n, rounds, tried = 5000, [], []
    df = spark.range(n).selectExpr("1L AS key", "id AS node", "id % 3 <> 1 AS lead", "if(id % 5 = 0, 7L, null) AS prev")
    df = df.union(spark.range(0, n, 5).selectExpr("7L AS key", "id AS node", "id % 3 <> 1 AS lead", "CAST(null AS long) AS prev"))

    def like(a, b):
        return (abs(a - b) == 977) | ((a + b) % 4999 == 0)

    def verify(pairs):
        rounds.append(1)
        tried.append(pairs.count())
        return pairs.where("b - a = 977 or (a + b) % 4999 = 0")

    def match(a, b):
        return like(a.column("node2").to_numpy()[:, None], b.column("node2").to_numpy()[None, :])

    sieve = Sieve(spark.range(n).selectExpr("id AS node", "id AS node2"), match)
    got = {r["node"]: r["comp"] for r in linked_lists(Workspace(spark), df, verify, sieve).collect()}
    want = groups_of(range(n), [(a, b) for a in range(n) for b in {a + 977, *(x - a for x in (4999, 9998))} if a < b < n and like(a, b) and (a % 3 != 1 or b % 3 != 1)])
    assert {k: got.get(k, k) for k in want} == want
    assert len(rounds) == 2 and tried[1] < 10 * n


def test_tiles_let_every_pair_at_the_threshold_through():
    r = np.random.default_rng(3)
    base = np.unique(r.integers(0, 2**62, 3000).astype(np.uint64))
    sets = [np.sort(r.choice(base[: r.integers(20, 2900)], r.integers(3, 20))) for _ in range(40)]
    for s in list(sets) + [base[:400], base[:80]]:
        for _ in range(4):
            sets.append(np.unique(np.concatenate((s[: max(1, int(len(s) * r.uniform(0.8, 1)))], r.integers(0, 2**62, 2).astype(np.uint64)))))
    table = pa.table({"n_shingles": [len(s) for s in sets], "low": pa.array([s[: nd.K].astype(np.int64).tolist() for s in sets], pa.list_(pa.int64()))})
    ok = nd._by_low(75)(table, table)
    hits = 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            both = len(np.intersect1d(x, y))
            if 100 * both >= 75 * (len(x) + len(y) - both):
                hits += 1
                assert ok[i, j]
    assert hits > 300 and ok.sum() < len(sets) ** 2 / 4
