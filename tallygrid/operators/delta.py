"""Measurements of a run carried over an edit by differences.

An edit of k documents takes k rows out of the index of scores and puts k in.
Corrected counts say where each budget's threshold lies now (one bucket is
read); a table of hits changes by the k rows, and, only at a budget whose
threshold moved, by the scores between the old threshold and the new one.
Nothing else is read, and the tables are those of a recount.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import score_index as si
from .evaluate import AXES, CURVE, with_interval

#: Edited documents whose ids are sent to the scan as a filter; more are joined.
PUSHED = 2000


def _of(rows: DataFrame, ids: DataFrame, named: list[str] | None) -> DataFrame:
    return rows.where(F.col("id").isin(named)) if named is not None else rows.join(ids.select("id"), "id", "left_semi")


def corrections(index: si.Index, run_id: str, old: DataFrame, fresh: DataFrame, docs: DataFrame) -> DataFrame:
    """(run_id, bucket, id, label, score, axes, weight): what the edit takes out (-1) and puts in (1).

    old(id, score) are the run's scores, fresh(id, score) those of the edited
    and added documents, and docs the edited corpus with label and axes.  What goes
    is found in the index: by the ids and the buckets of their old scores.
    """
    spark = fresh.sparkSession
    ids = fresh.select("id").distinct()
    named = [r["id"] for r in ids.limit(PUSHED + 1).collect()]
    named = named if len(named) <= PUSHED else None
    limits = index.bounds.where(F.col("run_id") == run_id)
    spot = si.placed(_of(old, ids, named).select(F.lit(run_id).alias("run_id"), "id", "score"), limits)
    rows = index.scores.where(F.col("run_id") == run_id)
    if named is not None:
        rows = si.bucket_scores(index, {(run_id, r["bucket"]) for r in spot.select("bucket").distinct().collect()})
    kept = ["run_id", "bucket", "id", "label", "score", *si.KEEP]
    went = _of(rows, ids, named).select(*kept).withColumn("weight", F.lit(-1))
    axes = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in si.KEEP]
    about = _of(docs, ids, named).select("id", "label", *axes)
    came = si.placed(fresh.select(F.lit(run_id).alias("run_id"), "id", F.col("score").cast("double").alias("score")).join(about, "id"), limits)
    both = went.union(came.select(*kept).withColumn("weight", F.lit(1)))
    return spark.createDataFrame(both.collect(), both.schema) if named is not None else both


def corrected(index: si.Index, changes: DataFrame) -> si.Index:
    """The index with its counts as they are after the changes; scores stay (see ``overlay``).  Bounds of values may be too wide."""
    tally = changes.groupBy("run_id", "bucket", "label").agg(F.sum("weight").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    runs = [r["run_id"] for r in changes.select("run_id").distinct().collect()]
    columns = ["run_id", "bucket", "label", "n", "lo", "hi"]
    all_ = index.counts.where(F.col("run_id").isin(runs)).select(*columns).union(tally.select(*columns))
    counts = all_.groupBy("run_id", "bucket", "label").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return index._replace(counts=counts.where("n > 0"))


def points(index: si.Index, changes: DataFrame, run_id: str, targets: Iterable[float]) -> DataFrame:
    """(target, tau, clean_hits, clean, hits, injected) of the run after the changes."""
    wanted = changes.sparkSession.createDataFrame([(run_id, t) for t in targets], "run_id string, rate double")
    return si.moved_to(corrected(index, changes), wanted, changes).withColumnRenamed("rate", "target").drop("run_id")


def curve(moved: DataFrame, targets: Iterable[float] = CURVE) -> DataFrame:
    """The curve from points; empty if either side is."""
    both = moved.where(F.col("target").isin(list(targets))).where("clean > 0 and injected > 0")
    return both.select("target", F.col("tau").alias("threshold"), (F.col("clean_hits") / F.col("clean")).alias("fpr"), (F.col("hits") / F.col("injected")).alias("recall"))


def differences(index: si.Index, changes: DataFrame, run_id: str, before: dict, after: dict) -> DataFrame:
    """(budget, label, axes, hits, n): what every budget's hits and sizes gain and lose.

    before and after give the threshold of each budget.  Where they differ,
    the scores between them, whole buckets or parts of two, change sides.
    """
    spark = changes.sparkSession
    taus = spark.createDataFrame([(b, float(after[b]), float(before[b])) for b in after], "budget double, tau double, old double")
    fired = lambda w: F.when(F.col("score") >= F.col("tau"), w).otherwise(0)
    own = changes.join(F.broadcast(taus)).select("budget", "label", *si.KEEP, fired(F.col("weight")).cast("long").alias("hits"), F.col("weight").cast("long").alias("n"))
    moved = si.placed(taus.where("tau <> old").select(F.lit(run_id).alias("run_id"), "*", F.explode(F.array("tau", "old")).alias("score")), index.bounds)
    spans = moved.groupBy("budget", "tau", "old").agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).collect()
    for s in spans:
        rows = index.scores.where((F.col("run_id") == run_id) & F.col("bucket").between(s["a"], s["b"]))
        low, high, sign = min(s["tau"], s["old"]), max(s["tau"], s["old"]), 1 if s["tau"] < s["old"] else -1
        rows = rows.where((F.col("score") >= low) & (F.col("score") < high))
        own = own.union(rows.select(F.lit(s["budget"]).cast("double"), "label", *si.KEEP, F.lit(sign).cast("long"), F.lit(0).cast("long")))
    return own.groupBy("budget", "label", *si.KEEP).agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))


def _adjusted(table: DataFrame, gains: DataFrame, keys: list[str], value: str) -> DataFrame:
    both = table.select(*keys, "hits", "n").union(gains.select(*keys, "hits", "n"))
    out = both.groupBy(*keys).agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).where("n > 0")
    return with_interval(out, value)


def cells(table: DataFrame, gains: DataFrame) -> DataFrame:
    """The grid after the differences; a cell that loses its last document goes, new ones come."""
    return _adjusted(table, gains.where("label = 'injected' and family is not null"), ["budget", "family", "action"], "recall")


def marginals(table: DataFrame, gains: DataFrame, axes: tuple[str, ...] = AXES) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("key")) for a in axes])).alias("x")
    rows = gains.where("label = 'injected'").select("budget", each, "hits", "n").select("budget", "x.axis", "x.key", "hits", "n")
    return _adjusted(table, rows.where("key is not null"), ["budget", "axis", "key"], "recall")


def rates(table: DataFrame, gains: DataFrame, by: str = "host_type") -> DataFrame:
    return _adjusted(table, gains.where("label = 'clean'"), ["budget", by], "fpr")
