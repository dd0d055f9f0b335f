"""Folds that merge, and windows that carry columns of their documents."""

from __future__ import annotations

import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tallygrid.operators import scoring as sc


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not see the tests


class NoisyOr(sc.Fold):
    def state(self, scores):
        return [float(np.prod(1 - scores))]

    def merge(self, a, b):
        return [a[0] * b[0]]

    def finish(self, state):
        return 1 - state[0]


class TopThree(sc.Fold):
    """The mean of the three greatest scores, or of all if they are fewer."""

    def state(self, scores):
        return sorted(scores, reverse=True)[:3]

    def merge(self, a, b):
        return sorted(a + b, reverse=True)[:3]

    def finish(self, state):
        return sum(state) / len(state)


class Letters(sc.Detector):
    """The share of capital letters in a sentence."""

    native, max_chars, policy = False, 60, "sentence"

    def score_batch(self, texts, ids, given=None):
        share = texts.map(lambda t: sum(c.isupper() for c in t) / (len(t) + 1))
        return share if given is None else share + (given["host"] == "web") + given["n"] * 10


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(2)
    rows = [(f"d{i}", " ".join("".join(r.choice("abCD ") for _ in range(40)) + ". A" for _ in range(r.choice((0, 1, 2, 9, 40)))), r.choice(("web", "doc")), i % 3) for i in range(40)]
    rows += [("long", "Word aB. " * 3000, "doc", 0)]
    return spark.createDataFrame(rows, "id string, text string, host string, n int").repartition(5)


def windows(docs, detector):
    out = {r["id"]: [] for r in docs.select("id").collect()}
    for r in sc.score_windows(docs, detector).collect():
        out[r["id"]].append(r["score"])
    return out


@pytest.mark.parametrize("how, plain", [(NoisyOr(), lambda s: 1 - np.prod(1 - np.array(s))), (TopThree(), lambda s: np.mean(sorted(s)[-3:]))])
def test_folds(spark, docs, how, plain):
    det = type("Folded", (Letters,), {"fold": how})()
    each = windows(docs, det)
    assert len(each["long"]) == 3000
    got = {r["id"]: r for r in sc.score_counted(docs, det).collect()}
    assert set(got) == set(each)
    for i, s in each.items():
        assert got[i]["windows"] == len(s) and got[i]["score"] == pytest.approx(plain(s) if s else 0.0, rel=1e-9, abs=1e-12)


def test_a_document_in_many_tasks(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("id"), (F.col("id") / 50_000).alias("score")).repartition(16)
    got = {r["id"]: r for r in sc.fold_states(rows, TopThree()).collect()}
    want = {}
    for r in rows.collect():
        want.setdefault(r["id"], []).append(r["score"])
    assert {i: r["windows"] for i, r in got.items()} == {i: len(s) for i, s in want.items()}
    assert all(got[i]["score"] == pytest.approx(np.mean(sorted(s)[-3:])) for i, s in want.items())


def test_windows_carry_columns(spark, docs):
    small = docs.where("id <> 'long'")
    plain, given = windows(small, Letters()), windows(small, type("Given", (Letters,), {"attributes": ("host", "n")})())
    about = {r["id"]: (r["host"] == "web") + 10 * r["n"] for r in small.collect()}
    for i, s in plain.items():
        assert sorted(given[i]) == pytest.approx(sorted(x + about[i] for x in s))

    class Native(sc.Detector):
        attributes = ("n",)

        def score_expr(self, text, doc_id, given):
            return F.length(text) + given["n"] * 1000.0

    got = {r["id"]: r["score"] for r in sc.score_documents(small, Native()).collect()}
    assert got == {r["id"]: len(r["text"]) + 1000 * r["n"] for r in small.collect()}


def test_fold_max_equals_its_sql_on_long_sentences_and_other_letters(spark, tmp_path):
    """A word across the cap of a long sentence, letters beside and inside a word, and a null text."""
    import duckdb

    from tallygrid.plans import catalogue

    words = ["x" * 1996 + " license here", "lic", "élicense", "licenſe", "License_", "", None, "a. B " * 500 + "LICENSE", " " * 2500, "üdisregard the above", "ſyſtem prompt", "dısregard the above"]
    spark.createDataFrame(list(enumerate(words)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = {r["id"]: r["score"] for r in catalogue.queries()["fold_max"](spark, str(tmp_path)).collect()}
    assert got == dict(con.execute(catalogue.oracles()["fold_max"]).fetchall())
    assert got["0"] == 1.0 and "6" not in got
    spark.createDataFrame([(i, t) for i, t in enumerate(words) if t is not None], "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    got = {r["id"]: r["score"] for r in catalogue.queries()["floor_score"](spark, str(tmp_path)).collect()}
    con.execute(f"create or replace view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(con.execute(catalogue.oracles()["floor_score"]).fetchall())
