"""Rates and edits answered by scans, against plain lists."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallygrid.operators import backfill as bf
from tallygrid.operators import evaluate as ev
from tallygrid.operators import scan as sn
from tallygrid.operators import score_index as si
from tallygrid.plans import catalogue

RATES = (0.0, 0.001, 0.05, 0.5, 1.0)


def plain(clean, injected, rate):
    ranked = sorted(clean, reverse=True)
    k = int(len(clean) * rate)
    tau = (ranked[k] if k < len(clean) else ranked[-1] + 1e-12) if clean else float("inf")
    return tau, sum(x >= tau for x in clean), len(clean), sum(x >= tau for x in injected), len(injected)


def test_moved_to_with_rows_that_came_and_went(spark):
    r = random.Random(5)
    runs = {"smooth": [r.random() for _ in range(3000)], "tied": [r.choice((0.0, 0.5, -1.0)) for _ in range(900)], "one": [0.25], "none": []}
    injected = {run: [r.random(), 0.5, 0.25] for run in runs}
    gone = {run: sorted(x)[: len(x) // 10] for run, x in runs.items()}  # the least go, so that they bound nothing
    rows = [(run, side, x, 1) for run in runs for side, xs in (("clean", runs[run]), ("injected", injected[run])) for x in xs]
    rows += [(run, "clean", x, -1) for run in runs for x in gone[run]] + [(run, "clean", 2.0, 1) for run in runs]
    df = spark.createDataFrame(rows, "run_id string, label string, score double, weight int")
    wanted = spark.createDataFrame([(run, t) for run in [*runs, "unknown"] for t in RATES], "run_id string, rate double")
    got = {(x["run_id"], x["rate"]): tuple(x)[2:] for x in sn.moved_to(df, wanted).collect()}
    for run, xs in runs.items():
        left = [*sorted(xs)[len(gone[run]) :], 2.0]
        for t in RATES:
            assert got.pop((run, t)) == plain(left, injected[run], t)
    assert not got
    bare = df.where("weight = 1 and score < 2").drop("weight")
    got = {(x["run_id"], x["rate"]): tuple(x)[2:] for x in sn.moved_to(bare, wanted).collect()}
    assert all(got[run, t] == plain(runs[run], injected[run], t) for run in runs for t in RATES)
    with pytest.raises(ValueError):
        sn.levels(spark.createDataFrame([("a", "injected", float("nan"))], "run_id string, label string, score double"), spark.createDataFrame([("a", 0.5)], "run_id string, tau double"))


@pytest.mark.parametrize("name", ["peers_at", "own_point", "peers_ranked", "own_point_ranked", "moved_to_rates", "delta_points", "delta_curve", "delta_cells", "delta_marginals", "delta_rates"])
def test_queries_write_no_scores(spark, sf, monkeypatch, name):
    """Their shuffles hold counts, not scores: an index of all scores was written for each before."""

    def refuse(*_, **__):
        raise AssertionError("scores are written")

    monkeypatch.setattr(si, "write", refuse)
    monkeypatch.setattr(si, "read", refuse)
    assert catalogue.queries()[name](spark, sf).count()


def test_collapse_apertures_looks_for_no_threshold(spark, sf, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("verdict runs have the threshold 0.5")

    monkeypatch.setattr(ev, "thresholds", refuse)
    assert catalogue.queries()["collapse_apertures"](spark, sf).count()


def test_thresholds_sort_no_scores(spark, monkeypatch):
    kind = type(spark.range(1))
    plans, collect = [], kind.collect

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return collect(df)

    monkeypatch.setattr(kind, "collect", kept)
    rows = spark.range(50_000).select((F.col("id") % 977).cast("double").alias("score"))
    assert ev.thresholds(rows, (0.01, 0.5))[None, 0.5] == sorted((i % 977 for i in range(50_000)), reverse=True)[25_000]
    assert len(plans) > 1 and not any("SortAggregate" in p for p in plans)


def test_curves_equal_those_of_the_cube(spark, sf, monkeypatch):
    from tallygrid.sources import tables as tb

    rows = tb.scores(spark, sf, ("r01", "r05", "r06")).where("run_id <> 'r05' or label = 'clean'").withColumn("score", F.round("score", -2))
    taus = bf.points(rows, [("r01", False, None), ("r05", False, None), ("r06", True, None)])
    want = bf.tables(bf.cube(rows, taus), taus)["curve"]
    key = lambda df: sorted(map(tuple, df.select("run_id", "target", "threshold", "fpr", "recall").collect()))
    assert key(bf.curves(rows, taus)) == key(want) and want.count() == len(ev.CURVE)
    monkeypatch.setattr(bf, "cube", None)  # the query counts by run and side alone
    assert catalogue.queries()["filled_curves"](spark, sf).count()
