"""Derived tables of saved runs, kept up to date.

Scores are saved, so a run that lacks a table, or has one made by another
definition, needs no detector: notes(run_id, table, definition, made) say how
each table was made, and what they do not cover is made anew.  All runs go
together: thresholds by narrowing histograms over all of them, one pass that
counts hits by run, side and axes, and every table from these counts.  The
number of jobs follows the batches of RUNS_AT_ONCE runs, not the runs.
"""

from __future__ import annotations

import hashlib
import json
import math
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import corpus as co
from ..sources import files as fl
from ..sources import store as st
from . import evaluate as ev
from . import score_index as si

#: To be raised when tables are measured in another way, so that old ones count as out of date.
REVISION = 1
#: Runs filled at once; the table of their thresholds is broadcast.
RUNS_AT_ONCE = 500
#: What each table depends on.
DERIVED = {
    "taus": {"points": ev.POINTS},
    "cells": {"points": ev.POINTS},
    "marginals": {"points": ev.POINTS, "axes": ev.AXES},
    "rates": {"points": ev.POINTS, "by": "host_type"},
    "curve": {"targets": ev.CURVE},
}
_NOTES = "run_id string, table string, definition string, made long"
_POINTS = "run_id string, points array<struct<budget:double,tau:double>>, curve array<struct<target:double,tau:double>>"


def definitions() -> dict[str, str]:
    """A digest for each table of all that it depends on."""
    return {t: hashlib.sha256(json.dumps([t, REVISION, how], sort_keys=True).encode()).hexdigest()[:12] for t, how in DERIVED.items()}


def notes(spark: SparkSession, root: str) -> DataFrame:
    where = f"{root}/derived"
    return spark.read.schema(_NOTES).parquet(where) if fl.exists(spark, where) else spark.createDataFrame([], _NOTES)


def note(spark: SparkSession, root: str, made: Iterable[tuple[str, str]]) -> None:
    """Record that tables of runs, (run_id, table), now follow today's definitions; other tables are not recorded."""
    now, how = time.time_ns(), definitions()
    rows = [(r, t, how[t], now) for r, t in made if t in how]
    if rows:
        spark.createDataFrame(rows, _NOTES).coalesce(1).write.mode("append").parquet(f"{root}/derived")


def todo(runs: DataFrame, made: DataFrame, how: dict[str, str]) -> DataFrame:
    """(run_id, table, definition, state): tables of runs(run_id, verdict) that are missing or out of date by notes.

    The newest note of a run's table counts, at equal times the one with the
    greater definition.  Verdict runs have no curve; a null verdict is none.
    """
    each = F.array(*[F.struct(F.lit(t).alias("table"), F.lit(d).alias("definition")) for t, d in sorted(how.items())])
    want = runs.select("run_id", F.coalesce("verdict", F.lit(False)).alias("verdict"), F.explode(each).alias("x")).select("run_id", "verdict", "x.*")
    want = want.where("not (verdict and table = 'curve')").drop("verdict")
    newest = made.groupBy("run_id", "table").agg(F.max_by("definition", F.struct("made", "definition")).alias("had"))
    state = F.when(F.col("had").isNull(), "missing").otherwise("out of date")
    return want.join(newest, ["run_id", "table"], "left").where("had is null or had <> definition").select("run_id", "table", "definition", state.alias("state"))


def points(rows: DataFrame, runs: Iterable[tuple[str, bool, float | None]], targets: Iterable[float] = ev.CURVE) -> DataFrame:
    """(run_id, points, curve): thresholds of every run of rows(run_id, label, score) at its budgets and along the curve.

    ``runs`` gives (run_id, verdict, target rate or null); a verdict has 0.5 without a budget and no curve.
    """
    runs, targets = list(runs), list(targets)
    asked = {r: sorted({*ev.POINTS, 0.001 if t is None else t}) for r, v, t in runs if not v}
    clean = rows.where((F.col("label") == "clean") & F.col("run_id").isin(sorted(asked)))
    tau = ev.thresholds(clean, sorted({*targets, *(t for ts in asked.values() for t in ts)}), by="run_id") if asked else {}
    at = lambda r, ts: [(t, tau.get((r, t), math.inf)) for t in ts]
    table = [(r, at(r, asked[r]), at(r, targets)) if not v else (r, [(None, 0.5)], []) for r, v, _ in runs]
    return rows.sparkSession.createDataFrame(table, _POINTS)


def cube(rows: DataFrame, taus: DataFrame, width: int = len(ev.POINTS) + 1, length: int = len(ev.CURVE)) -> DataFrame:
    """Rows(run_id, label, score, axes) counted by run, side and all axes: n, hits at each point (h) and along the curve (c).

    The one pass over the scores; it holds as many rows as combinations of axes occur.
    """
    both = rows.join(F.broadcast(taus), "run_id")
    fired = lambda name, i: F.count_if(F.col("score") >= F.get(name, F.lit(i))["tau"])
    h, c = F.array(*[fired("points", i) for i in range(width)]), F.array(*[fired("curve", i) for i in range(length)])
    return both.groupBy("run_id", "label", *ev.AXES).agg(F.count("*").alias("n"), h.alias("h"), c.alias("c"))


def _summed(counts: DataFrame, taus: DataFrame, *by: str, width: int = len(ev.POINTS) + 1) -> DataFrame:
    """(run_id, budget, by, hits, n) from the counts."""
    sums = counts.groupBy("run_id", *by).agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("h")[i]) for i in range(width)]).alias("h"))
    each = sums.join(F.broadcast(taus.select("run_id", "points")), "run_id")
    each = each.select("run_id", *by, "n", "h", F.posexplode("points").alias("i", "p"))
    return each.select("run_id", "p.budget", *by, F.get("h", F.col("i")).alias("hits"), "n")


def tables(counts: DataFrame, taus: DataFrame) -> dict[str, DataFrame]:
    """All derived tables of all runs, each with its run_id, from the counts alone."""
    clean, injected = counts.where("label = 'clean'"), counts.where("label = 'injected'")
    axis = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("key")) for a in ev.AXES]))
    by_axis = injected.select("run_id", "n", "h", axis.alias("x")).select("run_id", "n", "h", "x.*").where("key is not null")
    side = lambda x, v: F.sum(F.when(F.col("label") == x, v).otherwise(0))
    length = len(ev.CURVE)
    hits = [F.array(*[side(x, F.col("c")[i]) for i in range(length)]).alias(name) for x, name in (("clean", "fp"), ("injected", "tp"))]
    sums = counts.groupBy("run_id").agg(side("clean", F.col("n")).alias("clean"), side("injected", F.col("n")).alias("injected"), *hits)
    line = sums.where("clean > 0 and injected > 0").join(F.broadcast(taus.select("run_id", "curve")), "run_id")
    line = line.select("run_id", "clean", "injected", "fp", "tp", F.posexplode("curve").alias("i", "p"))
    share = lambda a, b: F.get(a, F.col("i")) / F.col(b)
    return {
        "taus": taus.select("run_id", F.explode("points").alias("p")).select("run_id", "p.budget", "p.tau"),
        "cells": ev.with_interval(_summed(injected.where("family is not null"), taus, "family", "action")),
        "marginals": ev.with_interval(_summed(by_axis, taus, "axis", "key")),
        "rates": ev.with_interval(_summed(clean, taus, "host_type"), "fpr"),
        "curve": line.select("run_id", "p.target", F.col("p.tau").alias("threshold"), share("fp", "clean").alias("fpr"), share("tp", "injected").alias("recall")),
    }


def curves(rows: DataFrame, taus: DataFrame, length: int = len(ev.CURVE)) -> DataFrame:
    """The table of curves alone: scores are counted by run, side and how many of the run's thresholds they reach, not by axes."""
    reach = lambda i: F.when(F.col("score") >= F.get("limits", F.lit(i)), 1).otherwise(0)
    limits = taus.where(F.size("curve") > 0).select("run_id", F.col("curve.tau").alias("limits"))
    own = rows.select("run_id", "label", "score").join(F.broadcast(limits), "run_id")
    counts = own.select("run_id", "label", sum((reach(i) for i in range(length)), F.lit(0)).alias("level")).groupBy("run_id", "label", "level").agg(F.count("*").alias("n"))
    each = taus.select("run_id", "curve", F.explode("curve").alias("p"))
    # a score that reaches a threshold reaches all that are no greater
    each = each.select("run_id", "p", F.size(F.filter("curve", lambda x: x["tau"] <= F.col("p.tau"))).alias("need"))
    side = lambda x, when=F.lit(True): F.sum(F.when((F.col("label") == x) & when, F.col("n")).otherwise(0))
    hit = F.col("level") >= F.col("need")
    sums = counts.join(F.broadcast(each), "run_id").groupBy("run_id", "p.target", F.col("p.tau").alias("threshold"))
    got = sums.agg(side("clean", hit).alias("fp"), side("injected", hit).alias("tp"), side("clean").alias("clean"), side("injected").alias("injected"))
    got = got.where("clean > 0 and injected > 0")
    return got.select("run_id", "target", "threshold", (F.col("fp") / F.col("clean")).alias("fpr"), (F.col("tp") / F.col("injected")).alias("recall"))


def refusal() -> Column:
    """Why a run's tables cannot be made; null if they can.  Needs has_scores and has_build."""
    return F.when(~F.col("has_scores"), "no scores of it are in the store").when(~F.col("has_build"), "its build is not laid out in the store")


def _rows(spark: SparkSession, root: str, runs: list) -> DataFrame:
    """(run_id, id, label, score, axes) of runs, each beside the documents of its own build; label null where the build lacks the id."""
    names = spark.createDataFrame([(r["run_id"], r["dataset"]) for r in runs], "run_id string, dataset string")
    docs = None
    for build in sorted({r["dataset"] for r in runs}):
        one = co.without_text(co.project(spark.read.schema(co.RAW).parquet(f"{root}/builds/{build}")))
        one = one.select(F.lit(build).alias("dataset"), "id", "label", *ev.AXES)
        docs = one if docs is None else docs.unionByName(one)
    scores = st.read_scores(spark, root).where(F.col("run_id").isin([r["run_id"] for r in runs]))
    return scores.join(F.broadcast(names), "run_id").join(docs, ["dataset", "id"], "left").drop("dataset")


def fill(spark: SparkSession, root: str, runs: DataFrame) -> tuple[list[tuple[str, str, str]], dict[str, str]]:
    """Make what runs(run_id, dataset, verdict, target_fpr) lack: [(run_id, table, state)] as found, and why others were refused.

    A table that is up to date is not touched.  A table's note is written
    after the table, so that a fill that was cut off goes on with what is left.
    Runs that scored ids unknown to their build are refused whole.
    """
    here = lambda folder, prefix="": [f.removeprefix(prefix) for f in fl.folders(spark, f"{root}/{folder}")]
    scored, builds = here("scores", "run_id="), here("builds")
    lacking = todo(runs, notes(spark, root), definitions()).groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("table", "state"))).alias("lack"))
    known = runs.select("run_id", "dataset", F.coalesce("verdict", F.lit(False)).alias("verdict"), "target_fpr")
    known = known.withColumn("has_scores", F.col("run_id").isin(scored)).withColumn("has_build", F.coalesce(F.col("dataset").isin(builds), F.lit(False)))
    found = known.join(lacking, "run_id").select("*", refusal().alias("why")).orderBy("run_id").collect()
    refused = {r["run_id"]: r["why"] for r in found if r["why"]}
    able, done = [r for r in found if not r["why"]], []
    for k in range(0, len(able), RUNS_AT_ONCE):
        some = able[k : k + RUNS_AT_ONCE]
        rows = _rows(spark, root, some)
        taus = points(rows, [(r["run_id"], r["verdict"], r["target_fpr"]) for r in some])
        staged = f"{root}/filling/{uuid.uuid4().hex}"
        cube(rows, taus).write.parquet(staged)
        counts = spark.read.parquet(staged)
        strange = {r["run_id"]: r["n"] for r in counts.where("label is null").groupBy("run_id").agg(F.sum("n").alias("n")).collect()}
        refused |= {r: f"{n} scores of documents that its build lacks" for r, n in strange.items()}
        for name, df in tables(counts, taus).items():
            mine = [(r["run_id"], name, x["state"]) for r in some for x in r["lack"] if x["table"] == name and r["run_id"] not in strange]
            if mine:
                own = df.where(F.col("run_id").isin([r for r, *_ in mine])).repartition("run_id")
                own.write.partitionBy("run_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{root}/{name}")
                note(spark, root, [(r, name) for r, *_ in mine])
                done += mine
        si.write(rows.where("label is not null"), f"{root}/index", [r["run_id"] for r in some if r["run_id"] not in strange])
        fl.remove(spark, staged)
    return done, refused
