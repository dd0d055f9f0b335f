"""Derived tables of saved runs: what is missing or out of date is made anew, and nothing else."""

from __future__ import annotations

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tallygrid import cli
from tallygrid.operators import backfill as bf
from tallygrid.operators import evaluate as ev
from tallygrid.operators import scoring as sc
from tallygrid.sources import store as st

from test_lifecycle import write_corpus


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    """Three runs at three target rates, with the tables that \"run\" itself measured."""
    root = tmp_path_factory.mktemp("backfill")
    write_corpus(root / "data")
    sc.register("graded", "test")(sc.Graded)
    args = ["--data", str(root / "data"), "--out", str(root / "out"), "--no-report"]
    cli.main(["run", "--detector", "graded", *args])
    cli.main(["run", "--detector", "graded", "--window", "300", "--overlap", "2", "--fpr", "0.05", *args])
    cli.main(["run", "--detector", "floor", *args])
    return root / "out"


@pytest.fixture
def out(store, tmp_path):
    shutil.copytree(store, tmp_path / "out")
    return tmp_path / "out"


def rows(spark, out, table):
    return {str(r) for r in spark.read.parquet(f"{out}/{table}").select("*").collect()}


def times(out, table):
    return {str(p): p.stat().st_mtime_ns for p in (out / table).rglob("part-*")}


def drop(out, table, run_id):
    shutil.rmtree(out / table / f"run_id={run_id}")


def ids(spark, out, binary):
    return sorted(r[0] for r in st.read_runs(spark, str(out)).where(F.col("verdict") == binary).select("run_id").collect())


def forget(spark, out, pairs):
    """The store as it was before some (run_id, table) were noted."""
    kept = [tuple(r) for r in bf.notes(spark, str(out)).collect() if (r["run_id"], r["table"]) not in pairs]
    shutil.rmtree(out / "derived")
    spark.createDataFrame(kept, bf._NOTES).write.parquet(f"{out}/derived")


def test_a_fresh_store_lacks_nothing(spark, out, capsys):
    cli.main(["backfill", "--results", str(out), "--dry-run"])
    assert capsys.readouterr().out == ""
    assert bf.fill(spark, str(out), st.read_runs(spark, str(out))) == ([], {})


def test_tables_made_together_are_those_of_each_run(spark, out):
    before = {t: rows(spark, out, t) for t in bf.DERIVED}
    for t in (*bf.DERIVED, "derived"):
        shutil.rmtree(out / t)
    done, refused = bf.fill(spark, str(out), st.read_runs(spark, str(out)))
    assert not refused and {x[2] for x in done} == {"missing"}
    assert len(done) == 2 * 5 + 4  # a verdict has no curve
    assert {t: rows(spark, out, t) for t in bf.DERIVED} == before


def test_only_what_is_missing_is_written(spark, out):
    a, b = ids(spark, out, False)
    (v,) = ids(spark, out, True)
    before = {t: rows(spark, out, t) for t in bf.DERIVED}
    gone = {(a, "curve"), (b, "cells"), (v, "rates")}
    for run_id, table in gone:
        drop(out, table, run_id)
    forget(spark, out, gone)
    old = {t: times(out, t) for t in bf.DERIVED}
    done, _ = bf.fill(spark, str(out), st.read_runs(spark, str(out)))
    assert {x[:2] for x in done} == gone
    for t in bf.DERIVED:
        assert rows(spark, out, t) == before[t]
        assert old[t].items() <= times(out, t).items()  # no file of a current table was touched
    assert bf.fill(spark, str(out), st.read_runs(spark, str(out))) == ([], {})


def test_another_definition_makes_one_table_out_of_date(spark, out, monkeypatch):
    kept = {t: times(out, t) for t in bf.DERIVED if t != "curve"}
    monkeypatch.setitem(bf.DERIVED, "curve", {"targets": ev.CURVE, "more": 1})
    done, _ = bf.fill(spark, str(out), st.read_runs(spark, str(out)))
    assert sorted(done) == [(r, "curve", "out of date") for r in ids(spark, out, False)]
    assert kept == {t: times(out, t) for t in kept}
    monkeypatch.undo()  # and back: the newest note counts, not any
    done, _ = bf.fill(spark, str(out), st.read_runs(spark, str(out)))
    assert {x[1:] for x in done} == {("curve", "out of date")}


def test_a_fill_that_was_cut_off_goes_on(spark, out, monkeypatch):
    for t in (*bf.DERIVED, "derived"):
        shutil.rmtree(out / t)
    real, calls = bf.note, []

    def dies(*args):
        if len(calls) == 2:
            raise RuntimeError("lost")
        calls.append(1)
        real(*args)

    monkeypatch.setattr(bf, "note", dies)
    with pytest.raises(RuntimeError):
        bf.fill(spark, str(out), st.read_runs(spark, str(out)))
    monkeypatch.undo()
    had = {(r["run_id"], r["table"]) for r in bf.notes(spark, str(out)).collect()}
    done, _ = bf.fill(spark, str(out), st.read_runs(spark, str(out)))
    assert had and not had & {x[:2] for x in done} and len(had) + len(done) == 14


def test_runs_that_cannot_be_filled_are_named(spark, out, capsys):
    a, b = ids(spark, out, False)
    (v,) = ids(spark, out, True)
    shutil.rmtree(out / "derived")
    shutil.rmtree(out / "scores" / f"run_id={a}")
    spark.createDataFrame([("stranger", 0.5)], "id string, score double").write.mode("append").parquet(f"{out}/scores/run_id={b}")
    cli.main(["backfill", "--results", str(out)])
    printed = capsys.readouterr().out
    assert f"{a}: no scores" in printed and f"{b}: 1 scores of documents" in printed and "made 4 tables of 1 runs" in printed
    record = st.read_runs(spark, str(out)).where(F.col("run_id") == v).withColumn("dataset", F.lit(None).cast("string"))
    shutil.rmtree(out / "derived")
    assert bf.fill(spark, str(out), record) == ([], {v: "its build is not laid out in the store"})


def test_jobs_do_not_follow_the_runs(spark, out):
    def jobs(tag):
        shutil.rmtree(out / "derived")
        spark.sparkContext.setJobGroup(tag, tag)
        bf.fill(spark, str(out), st.read_runs(spark, str(out)))
        spark.sparkContext.setJobGroup("", "")
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))

    few = jobs("few")
    for r in [r.asDict() for r in st.read_runs(spark, str(out)).collect()]:
        for k in range(8):
            st.save_run(spark, r, str(out), f"{r['run_id']}-{k}")
            shutil.copytree(out / "scores" / f"run_id={r['run_id']}", out / "scores" / f"run_id={r['run_id']}-{k}")
            shutil.copytree(out / "index/counts" / f"run_id={r['run_id']}", out / "index/counts" / f"run_id={r['run_id']}-{k}")
    assert jobs("many") <= few + 4
    assert len(os.listdir(out / "cells")) >= 27


def test_no_runs_and_no_rows(spark, tmp_path):
    runs = spark.createDataFrame([], "run_id string, dataset string, verdict boolean, target_fpr double")
    assert bf.fill(spark, str(tmp_path), runs) == ([], {})
    nothing = spark.createDataFrame([], "run_id string, label string, score double, " + ", ".join(f"{a} string" for a in ev.AXES))
    taus = bf.points(nothing, [("x", False, None), ("y", True, None)])
    got = bf.tables(bf.cube(nothing, taus), taus)
    assert got["taus"].count() == 3 and not any(got[t].count() for t in got if t != "taus")
