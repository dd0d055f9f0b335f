"""Questions across runs: apertures, winners, orders of axes, peers at one rate."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import files as fl
from . import score_index as si
from .evaluate import CURVE, thresholds

#: How far over a budget a verdict may lie; leads that count as clear in small and in large cells.
TOLERANCE = 0.25
SMALL_CELL, CLEAR_SMALL, CLEAR_LARGE = 80, 0.12, 0.08


def within_budget(fpr: Column, budget: Column) -> Column:
    """Whether a verdict detector may stand beside the others at a budget."""
    return F.coalesce(fpr, F.lit(0.0)) <= budget * (1 + TOLERANCE)


def run_curves(rows: DataFrame, targets: Iterable[float] = CURVE) -> DataFrame:
    """(run_id, target, fpr, recall) of all runs in rows(run_id, label, score), in one pass without more rows."""
    targets = list(targets)
    tau = thresholds(rows.where("label = 'clean'"), targets, by="run_id")
    table = rows.sparkSession.createDataFrame([(g, [tau[g, t] for t in targets]) for g in sorted({g for g, _ in tau})], "run_id string, taus array<double>")
    both = rows.join(F.broadcast(table), "run_id")
    fired = lambda side, i: F.count_if((F.col("label") == side) & (F.col("score") >= F.col("taus")[i]))
    points = [F.struct(F.lit(t).alias("target"), fired("clean", i).alias("fp"), fired("injected", i).alias("tp")) for i, t in enumerate(targets)]
    sizes = [F.count_if(F.col("label") == x).alias(x) for x in ("clean", "injected")]
    got = both.groupBy("run_id").agg(F.array(*points).alias("points"), *sizes).where("clean > 0 and injected > 0")
    got = got.select("run_id", "clean", "injected", F.explode("points").alias("p"))
    return got.select("run_id", "p.target", (F.col("p.fp") / F.col("clean")).alias("fpr"), (F.col("p.tp") / F.col("injected")).alias("recall"))


def peers(rows: DataFrame, runs: DataFrame, subjects: DataFrame, same_detector: bool = False) -> DataFrame:
    """(subject, run_id, recall): every run of rows(run_id, label, score) moved to the rate of each of subjects(run_id, detector, fpr_pooled).

    runs(run_id, detector) names the scored runs; those of a subject's own
    detector take part only with ``same_detector``.
    """
    rates = [tuple(r) for r in subjects.select("run_id", "detector", "fpr_pooled").collect()]
    who = {r["run_id"]: r["detector"] for r in runs.select("run_id", "detector").collect()}
    tau = thresholds(rows.where("label = 'clean'"), sorted({r[2] for r in rates}), by="run_id")
    moved = [(s, g, tau[g, t]) for s, det, t in rates for g in who if (g, t) in tau and (same_detector or who[g] != det)]
    table = F.broadcast(rows.sparkSession.createDataFrame(moved, "subject string, run_id string, tau double"))
    got = rows.where("label = 'injected'").join(table, "run_id").groupBy("subject", "run_id")
    return got.agg((F.count_if(F.col("score") >= F.col("tau")) / F.count("*")).alias("recall"))


def roster(registry: DataFrame, runs: DataFrame) -> DataFrame:
    """(detector, run_id, status) of every registered detector with its whole measurements."""
    whole = runs.where(F.coalesce("limit_n", F.lit(0)) == 0).select("detector", "run_id")
    both = registry.join(whole, "detector", "left")
    return both.select("detector", "run_id", F.when(F.col("run_id").isNull(), "not measured").otherwise("measured").alias("status"))


def interval_auc(curve: DataFrame, hi: float = 0.01, by: str = "run_id") -> DataFrame:
    """Mean recall over log10(fpr) of each run's curve points with 0 < fpr <= hi; null without points."""
    inside = curve.where((F.col("fpr") > 0) & (F.col("fpr") <= hi))
    w = Window.partitionBy(by).orderBy("fpr", "target")
    nxt = inside.withColumn("f2", F.lead("fpr").over(w)).withColumn("r2", F.lead("recall").over(w))
    step = F.log10("f2") - F.log10("fpr")
    last = F.max_by("recall", F.struct("fpr", "target"))
    got = nxt.groupBy(by).agg(F.sum(step * (F.col("recall") + F.col("r2")) / 2).alias("area"), F.sum(step).alias("width"), last.alias("last"))
    auc = F.when(F.coalesce("width", F.lit(0.0)) > 0, F.col("area") / F.col("width")).otherwise(F.col("last"))
    return curve.select(by).distinct().join(got.select(by, auc.alias("auc")), by, "left")


def choose_aperture(runs: DataFrame, aucs: DataFrame) -> DataFrame:
    """(detector, run_id, chosen): declared apertures before forced ones, then the greatest area.

    Detectors without any area keep all their rows.
    """
    all_ = runs.join(aucs, "run_id", "left")
    d = Window.partitionBy("detector")
    declared = F.max((~F.col("forced")).cast("int")).over(d) == 1
    left = all_.withColumn("in", ~declared | ~F.col("forced"))
    some = F.max(F.when(F.col("in"), F.col("auc").isNotNull().cast("int"))).over(d)
    rank = F.row_number().over(d.orderBy(F.desc("in"), F.col("auc").desc_nulls_last(), "run_id"))
    left = left.withColumn("some", some).withColumn("rn", rank)
    return left.select("detector", "run_id", F.when(F.col("some") == 1, F.col("rn") == 1).otherwise(F.col("in")).alias("chosen"))


def collapse_apertures(runs: DataFrame, cells: DataFrame, rates: DataFrame) -> DataFrame:
    """(detector, kept, same): verdict runs of a detector as one row where cells and rates are identical."""
    digest = lambda df, cols: df.groupBy("run_id").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct(*cols)))), 256).alias("d"))
    a = digest(cells, ("family", "action", "hits", "n")).withColumnRenamed("d", "dc")
    b = digest(rates, ("host_type", "hits", "n")).withColumnRenamed("d", "dr")
    both = runs.join(a, "run_id").join(b, "run_id").groupBy("detector")
    got = both.agg(F.count_distinct("dc", "dr").alias("kinds"), F.count("*").alias("runs"), F.sort_array(F.collect_list("run_id")).alias("ids"))
    one = (F.col("kinds") == 1) & (F.col("runs") > 1)
    kept = F.when(one, F.slice("ids", 1, 1)).otherwise(F.col("ids"))
    return got.select("detector", F.explode(kept).alias("run_id"), one.alias("same"))


def cell_winner(cells: DataFrame) -> DataFrame:
    """For each cell the detector with the greatest recall, its lead and whether the lead is clear."""
    w = Window.partitionBy("family", "action").orderBy(F.desc("recall"), "detector")
    got = cells.withColumn("second", F.lead("recall", 1, 0.0).over(w)).withColumn("rn", F.row_number().over(w))
    size = F.first("n").over(Window.partitionBy("family", "action").orderBy("detector"))
    gap = F.when(size <= SMALL_CELL, CLEAR_SMALL).otherwise(CLEAR_LARGE)
    got = got.withColumn("gap", gap).where("rn = 1")
    lead = F.col("recall") - F.col("second")
    return got.select("family", "action", "detector", "recall", lead.alias("margin"), (lead >= F.col("gap")).alias("clear"))


def cell_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select("family", "action", F.col("recall").alias("ra"))
    return left.join(b.select("family", "action", F.col("recall").alias("rb")), ["family", "action"]).select("family", "action", (F.col("ra") - F.col("rb")).alias("diff"))


def axis_order_run(cells: DataFrame, axis: str) -> DataFrame:
    """Keys of an axis by unweighted mean cell recall of one run, greatest first."""
    got = cells.groupBy(F.col(axis).alias("key")).agg(F.avg("recall").alias("mean"))
    return got.withColumn("pos", F.row_number().over(Window.orderBy(F.desc(F.round("mean", 12)), "key")))


def axis_order_field(cells: DataFrame, axis: str, other: str) -> DataFrame:
    """Keys of an axis by pooled recall times the filled share of the grid, over all runs."""
    full = cells.agg(F.count_distinct(other).alias("full"), F.count_distinct("run_id").alias("runs"))
    got = cells.groupBy(F.col(axis).alias("key")).agg(F.sum("hits").alias("h"), F.sum("n").alias("m"), F.count("*").alias("c"))
    score = F.when(F.col("m") == 0, 0.0).otherwise(F.col("h") / F.nullif("m", F.lit(0)) * (F.col("c") / (F.col("full") * F.col("runs"))))
    got = got.crossJoin(F.broadcast(full)).select("key", score.alias("score"))
    return got.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "key")))


def worst_cells(cells: DataFrame) -> DataFrame:
    """The tenth of the cells with the least recall, at least one."""
    w = Window.partitionBy("budget").orderBy("recall", "family", "action")
    n = F.count("*").over(Window.partitionBy("budget"))
    got = cells.withColumn("pos", F.row_number().over(w)).withColumn("n_cells", n)
    return got.where(F.col("pos") <= F.greatest(F.lit(1), F.floor(F.col("n_cells") / 10))).drop("n_cells")


_TABLES = {
    "cells": "budget double, family string, action string, hits long, n long, recall double, lo double, hi double, run_id string",
    "rates": "budget double, host_type string, hits long, n long, fpr double, lo double, hi double, run_id string",
    "curve": "target double, threshold double, fpr double, recall double, run_id string",
}


def saved(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A derived table of all runs; only the folders of the runs it is joined with are read.  Empty if no run has it."""
    kind = _TABLES[table]
    if not fl.exists(spark, f"{root}/{table}"):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).option("basePath", f"{root}/{table}").parquet(f"{root}/{table}")


def chosen_runs(runs: DataFrame, curve: DataFrame, cells: DataFrame, rates: DataFrame) -> DataFrame:
    """runs(run_id, detector, forced, verdict, ...) with auc: a scored detector's best aperture, a verdict's apertures that differ."""
    aucs = interval_auc(curve.join(runs.where("not verdict").select("run_id"), "run_id", "left_semi"))
    best = choose_aperture(runs.where("not verdict").select("run_id", "detector", "forced"), aucs).where("chosen").select("run_id")
    verdicts = runs.where("verdict").select("run_id", "detector")
    apart = collapse_apertures(verdicts, cells.join(verdicts, "run_id", "left_semi"), rates.join(verdicts, "run_id", "left_semi")).select("run_id")
    return runs.join(best.union(apart), "run_id").join(aucs, "run_id", "left")


def headline(runs: DataFrame, cells: DataFrame, rates: DataFrame) -> DataFrame:
    """(title, aperture, verdict, recall, fpr) of each run, the last two as maps of budgets, from one pass over both tables."""
    both = cells.select("run_id", "budget", F.lit("r").alias("side"), "hits", "n").union(rates.select("run_id", "budget", F.lit("f"), "hits", "n"))
    sums = both.join(runs.select("run_id"), "run_id", "left_semi").groupBy("run_id", "budget", "side").agg((F.sum("hits") / F.sum("n")).alias("v"))
    side = lambda x: F.collect_list(F.when(F.col("side") == x, F.struct("budget", "v")))
    wide = sums.groupBy("run_id").agg(side("r").alias("recall"), side("f").alias("fpr"))
    title = F.coalesce(F.nullif("display", F.lit("")), "detector")
    return runs.select("run_id", title.alias("title"), "aperture", "verdict").join(wide, "run_id", "left")


def shared_order(runs: DataFrame, cells: DataFrame, axis: str = "family") -> DataFrame:
    """(budget, key, title, recall, pos): the axis of every run, its keys in the order of the run with the greatest area, best first.

    A key that the reference run lacks stands as if it had recall 0.
    """
    reference = runs.orderBy(F.col("auc").desc_nulls_last(), "run_id").limit(1).select("run_id", F.lit(True).alias("is_reference"))
    by_key = cells.join(runs.select("run_id", "title"), "run_id").groupBy("run_id", "title", "budget", F.col(axis).alias("key")).agg((F.sum("hits") / F.sum("n")).alias("recall"))
    marked = by_key.join(F.broadcast(reference), "run_id", "left")
    own = F.max(F.when(F.col("is_reference"), F.col("recall"))).over(Window.partitionBy("budget", "key"))
    ranked = marked.withColumn("own", F.coalesce(own, F.lit(0.0)))
    return ranked.withColumn("pos", F.dense_rank().over(Window.partitionBy("budget").orderBy(F.desc("own"), "key"))).drop("is_reference", "own")


def overview(spark: SparkSession, root: str, runs: DataFrame, budgets: Iterable[float], registered: Iterable[str]) -> dict[str, DataFrame | None]:
    """What a comparison shows of runs(run_id, detector, display, aperture, forced, verdict, fpr_pooled) saved at root.

    Every part is a query over one read of all runs' tables; none goes run by run.
    """
    mine = runs.select("run_id")
    cells, rates, curve = (saved(spark, root, t).join(F.broadcast(mine), "run_id", "left_semi") for t in ("cells", "rates", "curve"))
    chosen = chosen_runs(runs, curve, cells, rates).withColumn("title", F.coalesce(F.nullif("display", F.lit("")), "detector")).cache()
    budgets = list(budgets)
    own = cells.join(chosen.where("not verdict").select("run_id", "detector"), "run_id").where(F.col("budget").isin(budgets))
    w = Window.partitionBy("budget", "family", "action")
    best = own.withColumn("second", F.lead("recall", 1, 0.0).over(w.orderBy(F.desc("recall"), "detector"))).withColumn("rn", F.row_number().over(w.orderBy(F.desc("recall"), "detector")))
    gap = F.when(F.min("n").over(w) <= SMALL_CELL, CLEAR_SMALL).otherwise(CLEAR_LARGE)
    lead = F.col("recall") - F.col("second")
    winners = best.withColumn("gap", gap).where("rn = 1").select("budget", "family", "action", "detector", "recall", lead.alias("margin"), (lead >= F.col("gap")).alias("clear"))
    late = chosen.where(F.col("verdict") & ~within_budget(F.col("fpr_pooled"), F.lit(max(budgets)))).select("run_id", "detector", "fpr_pooled")
    index = si.read(spark, f"{root}/index")
    movable = chosen.where("not verdict").select("run_id", "detector").join(index.counts.select("run_id").distinct(), "run_id", "left_semi")
    known = spark.createDataFrame([(k,) for k in registered], "detector string")
    return {
        "headline": headline(chosen, cells, rates).orderBy("title", "run_id"),
        "winners": winners.orderBy("budget", "family", "action"),
        "axes": shared_order(chosen.where("not verdict"), cells.where(F.col("budget").isin(budgets))).orderBy("budget", "pos", "title"),
        "peers": si.peers(index, movable, late, True).orderBy("subject", F.desc("recall"), "run_id") if not late.isEmpty() else None,
        "roster": roster(known, runs.withColumn("limit_n", F.lit(None).cast("int"))).where("run_id is null").orderBy("detector"),
    }
