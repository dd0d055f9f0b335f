from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallygrid.llm.packing import Bins, pack


def check(docs, out, capacity, per_source, clusters=None):
    """Every token once, no bin too full, no conflict."""
    want = {i: len((t or "").encode().split()) + 1 for i, t, *_ in docs}
    got, bins = Counter(), defaultdict(list)
    for r in out:
        got[r["doc_id"]] += r["n_tokens"]
        bins[r["shard"], r["bin"]].append(r)
    assert dict(got) == want
    about = {i: (s, clusters[i] if clusters else t) for i, t, _, s in docs}
    for rows in bins.values():
        assert sum(r["n_tokens"] for r in rows) == rows[0]["used"] <= capacity
        assert sorted(r["position"] for r in rows) == list(range(len(rows)))
        sources = Counter(about[r["doc_id"]][0] for r in rows if about[r["doc_id"]][0])
        assert not sources or max(sources.values()) <= per_source
        kinds = Counter(about[r["doc_id"]][1] for r in rows if about[r["doc_id"]][1] is not None)
        assert not kinds or max(kinds.values()) == 1
    return bins


def test_whole_and_without_conflict(spark, documents, texts):
    for capacity, per_source, shard in ((64, 1, 10**6), (200, 2, 500), (7, 3, 10**6)):
        out = pack(spark, documents, None, capacity, per_source, shard).collect()
        check(texts, out, capacity, per_source)


def test_given_clusters(spark, documents, texts):
    clusters = {i: i % 4 for i, *_ in texts}
    df = spark.createDataFrame(list(clusters.items()), "doc_id long, cluster long")
    check(texts, pack(spark, documents, df, 300, 5).collect(), 300, 5, clusters)


def test_best_fit_takes_the_tightest_compatible_bin():
    b = Bins(10, 1)
    assert [b.place(7, 1, 0), b.place(6, 2, 0), b.place(5, 4, 0)] == [0, 1, 2]
    assert b.place(3, 8, 0) == 0  # residuals 3, 4, 5: the exact one
    assert b.place(4, 2, 0) == 2  # residual 4 holds the source already, the next larger one does not
    assert b.place(4, 16, 0) == 1


def plain(pieces, capacity, per_source):
    """The same rule by scanning all bins: the least residual, at equal ones the bin opened first."""
    bins, out = [], []
    for size, s, c in pieces:
        fit = [(capacity - u, k) for k, (u, ss, cc) in enumerate(bins) if capacity - u >= size and (s is None or ss.count(s) < per_source) and (c is None or c not in cc)]
        k = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append((0, [], []))
        u, ss, cc = bins[k]
        bins[k] = (u + size, ss + [s], cc + [c])
        out.append(k)
    return out


def bit(x):
    return 0 if x is None else 1 << x


@pytest.mark.parametrize("frequent", [0, 0b111, (1 << 40) - 1])
@pytest.mark.parametrize("nulls", [False, True])
def test_each_piece_goes_where_a_scan_of_all_bins_puts_it(frequent, nulls):
    for seed in range(60):
        r = random.Random(seed)
        sources, per_source = r.choice([1, 2, 4, 9]), r.choice([1, 2, 3])
        maybe = lambda n: None if nulls and r.random() < 0.2 else r.randrange(n)
        pieces = sorted(((r.randint(1, r.choice([3, 20])), maybe(sources), maybe(r.choice([2, 15, 40]))) for _ in range(120)), key=lambda x: -x[0])
        every = 0 if any(s is None for _, s, _ in pieces) else sum({1 << s for _, s, _ in pieces})
        b = Bins(30, per_source, every, frequent)
        assert [b.place(size, bit(s), bit(c)) for size, s, c in pieces] == plain(pieces, 30, per_source)


@pytest.mark.parametrize("sources, clusters", [(1, 0), (3, 0), (6, 1), (40, 1), (40, 9)])
def test_search_does_not_grow_with_conflicting_bins(sources, clusters):
    def steps(n):
        seen = 0
        b = Bins(2048, 2, (1 << sources) - 1, (1 << clusters) - 1)
        real = b._take

        def counting(*args):
            nonlocal seen
            seen += 1 + len(b.tops[args[0]])
            return real(*args)

        b._take = counting
        for k in range(n):
            b.place(21, 1 << k % sources, 1 << k % clusters if clusters else 0)
        return seen

    assert steps(8000) < 3 * steps(4000) + 100_000  # four times as many if every bin were tried


def test_rows_without_any_difference_are_spread(spark):
    rows = [(None, "same words in all of them", "en", "s")] * 5000 + [(7, "other words", "en", "s")] * 5000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = pack(spark, docs, shard_tokens=2000)
    assert out.groupBy("doc_id").agg(F.sum("n_tokens").alias("t")).orderBy("doc_id").collect() == [(None, 5000 * 7), (7, 5000 * 3)]
    per = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert len(per) == 1 + 50000 // 2000 and max(per) < 2 * 10000 / len(per)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, pack(spark, docs.repartition(5), shard_tokens=2000).collect()), key=str)


def test_empty_and_odd(spark, nothing, odd):
    assert pack(spark, nothing).count() == 0
    assert pack(spark, odd).groupBy().sum("n_tokens").first()[0] == 20 * 3 + 21 + 4 + 6 + 1 - 1
