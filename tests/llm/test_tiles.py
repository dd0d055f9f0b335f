from __future__ import annotations

import itertools
import random

import numpy as np

from tallygrid.llm import lines as ln
from tallygrid.llm import workspace as ws_
from tallygrid.llm.workspace import Sieve, Workspace, linked_lists


def test_long_lists_hand_no_pairs_of_two_components_to_verify(spark, monkeypatch):
    """Members of nine groups in three lists of the same kind: the tiles join the groups, so verify sees about a pair a member."""
    monkeypatch.setattr(ws_, "TILE", 64)
    n, tried = 180, []
    df = spark.range(3 * n).selectExpr("id % 3 AS key", "id DIV 3 AS node")

    def verify(pairs):
        tried.append(pairs.count())
        return pairs.where("a % 9 = b % 9").select("a", "b")

    def texts(nodes):
        return nodes.where("node % 20 <> 3").selectExpr("node", "string(node) AS text")

    sieve = Sieve(spark.range(n).selectExpr("id AS node", "id AS node2"), lambda a, b: np.ones((a.num_rows, b.num_rows), bool), texts, lambda x, y: np.array([int(a) % 9 == int(b) % 9 for a, b in zip(x, y, strict=True)], bool))
    got = {r["node"]: r["comp"] for r in linked_lists(Workspace(spark), df, verify, sieve, short=2, hubs=1).collect()}
    assert got == {i: i % 9 for i in range(n)}
    bare = n // 20  # members without a text are tried with all others, once
    assert tried[0] < n and tried[1] <= bare * n


def test_met_before():
    r = random.Random(2)
    for _ in range(30):
        x, y = ([np.array(sorted(r.sample(range(-20, 40), r.randint(1, 6))), np.int64) for _ in range(r.randint(1, 12))] for _ in range(2))
        key = r.randint(-20, 40)
        want = [[any(k < key for k in set(a) & set(b)) for b in y] for a in x]
        assert ws_._met_before(x, y, key).tolist() == want


def test_pairs_of_neighbouring_length_classes_meet_in_one_list():
    r = random.Random(6)
    rows = np.array([(k, n, r.randint(0, 6)) for k in range(60) for n in r.sample(range(50), r.randint(1, 5))], ln._PAIR)
    rows = ln._distinct(rows)
    out = ln._by_length(rows, True)
    lists = {}
    for key, node, spare in out.tolist():
        if not spare:
            lists.setdefault(key, []).append(node)
    met = sorted(p for m in lists.values() for p in itertools.combinations(sorted(m), 2))
    want = []
    for k in range(60):
        some = [(n, c) for key, n, c in rows.tolist() if key == k]
        want += [tuple(sorted((a, b))) for (a, c), (b, d) in itertools.combinations(some, 2) if abs(c - d) <= 1]
    assert set(met) == set(want)
    # a pair of one class meets twice only if the classes on both sides have members
    assert len(met) < 1.3 * len(want)
