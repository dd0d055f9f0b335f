from __future__ import annotations

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallygrid.functions.stats import interval_area
from tallygrid.operators import evaluate as ev


def plain(scores, target):
    if not scores:
        return math.inf
    k = int(len(scores) * target)
    return sorted(scores, reverse=True)[k] if k < len(scores) else min(scores) + 1e-12


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.floats(-5, 5), st.sampled_from([0.0, 1.0])), max_size=80), st.lists(st.sampled_from([0.0, 0.01, 0.1, 0.5, 0.99, 1.0]), min_size=1, max_size=4, unique=True))
def test_threshold_is_the_ranked_score(spark, scores, targets):
    df = spark.createDataFrame([(float(s),) for s in scores], "score double")
    got = ev.thresholds(df, targets)
    assert got == {(None, t): plain(scores, t) for t in targets}


def test_whole_ranks_and_narrowing(spark, monkeypatch):
    monkeypatch.setattr(ev, "_FEW", 3)
    monkeypatch.setattr(ev, "_CELLS", 4)
    df = spark.range(1000).select(F.col("id").cast("double").alias("score"), (F.col("id") % 2).cast("string").alias("g"))
    assert ev.thresholds(df, (0.001, 0.01, 0.1)) == {(None, 0.001): 998.0, (None, 0.01): 989.0, (None, 0.1): 899.0}
    assert ev.thresholds(df, (0.01,), by="g") == {("0", 0.01): 988.0, ("1", 0.01): 989.0}


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_bad_scores_are_refused(spark, bad):
    with pytest.raises(ValueError, match="numbers"):
        ev.thresholds(spark.createDataFrame([(1.0,), (bad,)], "score double"), (0.1,))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(7)
    rows = []
    for i in range(72):
        rows.append((f"pos-{i}", "injected", ("email", "doc", "web")[i % 3], ("bare", "frame", "keep")[i // 24], ("disclose", "send")[i % 2], None if i % 9 == 0 else "end", r.random() + 0.4))
    for i in range(120):
        rows.append((f"neg-{i}", "clean", ("email", "doc", "web")[i % 3], None, None, None, r.random()))
    return spark.createDataFrame(rows, "id string, label string, host_type string, family string, action string, spliced_at string, score double").withColumn("host_source", F.col("host_type")).withColumn("obfuscation", F.when(F.col("label") == "injected", "none"))


def test_grid_and_marginals(docs):
    injected, clean = docs.where("label = 'injected'"), docs.where("label = 'clean'")
    taus = ev.budgets(clean, ev.POINTS)
    cells = ev.cell_grid(injected, taus).collect()
    assert sum(r["n"] for r in cells if r["budget"] == 0.01) == 72 and len(cells) == 12
    m = ev.marginals(injected, taus).collect()
    assert {r["key"] for r in m if r["axis"] == "spliced_at"} == {"end"}
    assert all(0 <= r["lo"] <= r["recall"] <= r["hi"] <= 1 for r in m)
    for axis in ("family", "action", "host_type"):
        assert sum(r["n"] for r in m if r["axis"] == axis and r["budget"] == 0.001) == 72


def test_curve_is_monotone_and_meets_the_points(docs):
    curve = {r["target"]: r for r in ev.recall_curve(docs).collect()}
    order = [curve[t]["recall"] for t in ev.CURVE]
    assert order == sorted(order) and len(curve) == 13
    tau = ev.thresholds(docs.where("label = 'clean'"), (0.01,))[None, 0.01]
    hits = docs.where("label = 'injected'").where(ev.fires(tau)).count()
    assert curve[0.01]["recall"] == pytest.approx(hits / 72)


def test_empty_sides(spark, docs):
    none = docs.where("label = 'clean'").limit(0)
    assert ev.thresholds(none, (0.1,)) == {(None, 0.1): math.inf}
    assert ev.recall_curve(docs.where("label = 'injected'")).count() == 0
    r = ev.score_floor(none).first()
    assert (r["ties"], r["n"], r["share"]) == (0, 0, 0.0)
    got = ev.cell_grid(docs.where("label = 'injected'"), [(0.1, math.inf)])
    assert got.where("recall <> 0").count() == 0


def test_guards(spark):
    tied = spark.createDataFrame([(1.0,)] * 30 + [(0.5,)] * 70, "score double")
    with pytest.raises(ValueError, match="share"):
        ev.check_score_floor(tied, 0.01)
    ev.check_score_floor(tied, 0.01, binary=True)
    ev.check_score_floor(spark.createDataFrame([(1.0,), (0.5,)], "score double"), 0.01)
    verdicts = spark.createDataFrame([(1.0,), (0.0,)], "score double")
    with pytest.raises(ValueError, match="binary"):
        ev.check_score_type(verdicts, False)
    assert ev.check_score_type(verdicts, True) is None and ev.check_score_type(tied, True)


def test_verdicts_keep_their_point(docs):
    assert ev.budgets(docs, ev.POINTS, binary=True) == [(None, 0.5)]


def test_interval_area():
    assert interval_area([], 0.01) is None and interval_area([(0.5, 1.0)], 0.01) is None
    assert interval_area([(0.001, 0.3)], 0.01) == 0.3
    assert interval_area([(0.001, 0.2), (0.01, 0.4), (0.1, 0.9)], 0.01) == pytest.approx(0.3)
