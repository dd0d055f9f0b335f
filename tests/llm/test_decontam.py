from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tallygrid.llm import decontam as dc

ITEM = "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old crooked tree near town"


@pytest.fixture(scope="module")
def case(spark):
    w = ITEM.split()
    edited = " ".join(x if i % 6 else "altered" for i, x in enumerate(w))
    gapped = " ".join(w[:8] + ["some", "extra", "words"] + w[8:])
    pad = " ".join(f"pad{i}" for i in range(80))
    docs = {
        1: f"{pad} {ITEM.upper()}! {pad}", 2: f"{pad} {edited} {pad}", 3: f"{gapped} {pad}", 4: pad, 5: "the quick brown dog " + pad,
        6: " ".join(reversed(w)), 7: ITEM, 8: "", 10: " ".join(w[:9]) + " " + pad,
    }
    rows = [(i, t, "clash") for i, t in docs.items()] + [(9, None, "clash"), (None, ITEM, "clash")]
    items = [(1, ITEM), (2, "tiny item"), (3, None), (4, "!!! ..."), (5, ITEM)]
    return spark.createDataFrame(rows, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")


def test_finds_exact_edited_and_gapped(spark, case):
    got = {(r["doc_id"], r["item_id"]) for r in dc.leaks(spark, *case).collect()}
    assert got == {(d, i) for d in (1, 2, 3, 7, None) for i in (1, 5)}


def test_places(spark, case):
    r = {(x["doc_id"], x["item_id"]): x for x in dc.leaks(spark, *case).collect()}[1, 1]
    assert (r["start_word"], r["end_word"], r["score"]) == (80, 80 + len(ITEM.split()), 1.0)


def test_parts_of_items_do_not_matter(spark, case):
    want = sorted(map(str, dc.leaks(spark, *case).collect()))
    assert sorted(map(str, dc.leaks(spark, *case, item_bytes=60).collect())) == want


def test_filter(spark, case, nothing):
    left = dc.without_leaks(spark, *case)
    assert left.columns == ["doc_id", "text", "item_id"]
    assert {r["doc_id"] for r in left.collect()} == {4, 5, 6, 8, 9, 10, None}
    assert dc.leaks(spark, nothing, case[1]).count() == 0 and dc.leaks(spark, case[0], case[1].limit(0)).count() == 0


def test_alignment_against_table():
    rng = np.random.default_rng(5)
    for _ in range(200):
        q, t = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(1, 14))
        h = np.zeros((len(q) + 1, len(t) + 1), int)
        for i in range(1, len(q) + 1):
            for j in range(1, len(t) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if q[i - 1] == t[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert dc.align(q.astype(np.uint64), t.astype(np.uint64))[0] == h.max()


def hashed(text):
    return dc._words_of(*dc.column_bytes(pa.array([text])))[0]


def skewed(r, n):
    """Words of a vocabulary in which few words are very common."""
    return [f"w{int(r.paretovariate(0.7)) % 4000}" for _ in range(n)]


def edited(r, w, share, how):
    w = list(w)
    n = round(len(w) * share)
    at = [int((i + 0.5) * len(w) / n) for i in range(n)] if how == "even" else r.sample(range(len(w)), n)
    for k in sorted(at, reverse=True):
        w[k : k + 1] = r.choice([[f"edit{r.randrange(10**6)}"], [f"edit{r.randrange(10**6)}"], []]) if how != "even" else [f"edit{r.randrange(10**6)}"]
    return w


@pytest.mark.parametrize("how", ["even", "random"])
def test_edited_copies_against_all_pairs(spark, how):
    """Items of 5 to 60 words, copies with 10 to 27 % of the words edited; all pairs are aligned."""
    r = random.Random(11)
    items = [(k, skewed(r, n)) for k, n in enumerate([5, 7, 9, 12, 12, 25, 25, 40, 60, 60])]
    docs = []
    for share in (0.1, 0.15, 0.2, 0.22, 0.25, 0.27):
        for k, w in items:
            docs.append(" ".join(skewed(r, 40) + edited(r, w, share, how) + skewed(r, 40)))
    docs += [" ".join(skewed(r, 100)) for _ in range(30)] + [None, "", docs[0], " ".join(items[5][1])]
    want = set()
    for i, t in enumerate(docs):
        h = hashed(t or "")
        for k, w in items:
            q = hashed(" ".join(w))
            if len(h) and dc.align(q, h)[0] >= dc.MIN_SCORE * 2 * len(q):
                want.add((i, k))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    out = dc.leaks(spark, df, spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")).collect()
    got = {(x["doc_id"], x["item_id"]) for x in out}
    assert len(out) == len(got) and got <= want and len(got) >= 0.97 * len(want) and len(want) > 40


def test_long_text_and_repeated_rows(spark):
    r = random.Random(2)
    item = " ".join(skewed(r, 30))
    long = " ".join(skewed(r, 150_000) + item.split() + skewed(r, 150_000))
    rows = [(1, long), (2, item), (2, item), (3, " ".join(skewed(r, 3000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = dc.leaks(spark, df, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert sorted((x["doc_id"], x["start_word"], x["end_word"]) for x in out) == [(1, 150_000, 150_030), (2, 0, 30), (2, 0, 30)]
