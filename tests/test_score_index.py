"""The index of scores against ranks and counts over plain lists."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import score_index as si

RATES = (0.0, 0.00001, 0.001, 0.01, 0.05, 0.25, 0.5, 0.999, 1.0)


def plain_tau(clean, rate):
    if not clean:
        return math.inf
    k = int(len(clean) * rate)
    return sorted(clean, reverse=True)[k] if k < len(clean) else min(clean) + 1e-12


@pytest.fixture(scope="module")
def runs():
    r = random.Random(3)
    out = {
        "smooth": ([r.random() for _ in range(9000)], [r.random() + 0.3 for _ in range(900)]),
        "tied": ([r.choice((0.0, 0.0, 0.0, 0.5, r.random())) for _ in range(3000)], [r.choice((0.0, 0.5, 1.0)) for _ in range(500)]),
        "one": ([0.25], [0.25, 0.1]),
        "flat": ([1.5] * 400, [1.5, 2.0, 1.0]),
        "no clean": ([], [0.5, 0.7]),
        "no injected": ([0.1, 0.2], []),
        "wide": ([r.gauss(0, 1) * 10 ** r.randint(-9, 9) for _ in range(5000)], [r.gauss(1, 1) for _ in range(300)]),
    }
    return out


@pytest.fixture(scope="module")
def index(spark, runs, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    rows = [(run, f"{label}{i}", label, s, f"f{i % 3}") for run, sides in runs.items() for label, side in zip(("clean", "injected"), sides, strict=True) for i, s in enumerate(side)]
    df = spark.createDataFrame(rows, "run_id string, id string, label string, score double, family string").repartition(4)
    si.write(df.where("run_id <> 'wide'"), root)
    si.write(df, root)  # adds the run that is new, leaves the others
    return si.read(spark, root)


def test_counts_cover_all_scores(index, runs):
    got = {(r["run_id"], r["label"]): r["n"] for r in index.counts.groupBy("run_id", "label").agg(F.sum("n").alias("n")).collect()}
    assert got == {(run, label): len(side) for run, sides in runs.items() for label, side in zip(("clean", "injected"), sides, strict=True) if side}
    fullest = index.counts.where("run_id = 'smooth' and label = 'clean'").agg(F.max("n")).first()[0]
    assert fullest <= 9000 / si.BUCKETS * 2 + 2


def test_thresholds_and_recalls(spark, index, runs):
    wanted = spark.createDataFrame([(run, t) for run in runs for t in RATES], "run_id string, rate double")
    got = {(r["run_id"], r["rate"]): r for r in si.moved_to(index, wanted).collect()}
    assert len(got) == len(runs) * len(RATES)
    for (run, t), r in got.items():
        clean, injected = runs[run]
        tau = plain_tau(clean, t)
        want = (tau, sum(s >= tau for s in clean), len(clean), sum(s >= tau for s in injected), len(injected))
        assert tuple(r[2:]) == want, (run, t)


def test_fixed_thresholds(spark, index, runs):
    taus = spark.createDataFrame([("tied", 0.5, "x"), ("tied", 0.5, "y"), ("flat", 1.6, "x"), ("flat", float("inf"), "x"), ("wide", float("-inf"), "x")], "run_id string, tau double, why string")
    got = {(r["run_id"], r["tau"], r["why"]): (r["clean_hits"], r["hits"]) for r in si.counted(index, taus).collect()}
    assert got == {(run, tau, why): tuple(sum(s >= tau for s in side) for side in runs[run]) for run, tau, why in map(tuple, taus.collect())}


def test_only_buckets_are_read(index):
    plan = si.bucket_scores(index, {("smooth", 4000), ("wide", 17)})._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "run_id" in plan.split("PartitionFilters")[1][:200]
    assert "In(bucket, [17,4000])" in plan or "EqualTo(bucket,4000)" in plan
    assert si.bucket_scores(index, {("smooth", 4000), ("wide", 17)}).count() <= 40


def test_peers(spark, index, runs):
    who = spark.createDataFrame([("smooth", "a"), ("tied", "b"), ("wide", "a"), ("no injected", "c")], "run_id string, detector string")
    subject = spark.createDataFrame([("s1", "a", 0.01), ("s2", "z", 0.3)], "run_id string, detector string, fpr_pooled double")
    got = {(r["subject"], r["run_id"]): r["recall"] for r in si.peers(index, who, subject).collect()}
    assert set(got) == {("s1", "tied"), ("s2", "smooth"), ("s2", "tied"), ("s2", "wide")}
    for (s, run), recall in got.items():
        tau = plain_tau(runs[run][0], 0.01 if s == "s1" else 0.3)
        assert recall == sum(x >= tau for x in runs[run][1]) / len(runs[run][1])
    assert si.peers(index, who, subject, True).where("subject = 's1'").count() == 3
    assert si.peers(index, who, subject.where("false")).count() == 0


def test_bad_scores_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([("r", "a", "clean", None)], "run_id string, id string, label string, score double")
    with pytest.raises(ValueError, match="numbers"):
        si.write(rows, str(tmp_path / "x"))


def test_an_empty_index(spark, tmp_path):
    empty = si.read(spark, str(tmp_path / "none"))
    assert si.thresholds(empty, spark.createDataFrame([("r", 0.1)], "run_id string, rate double")).count() == 0
