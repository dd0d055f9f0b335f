"""Questions about scores that are asked once, answered by scans of the scores.

An index (see ``score_index``) writes every score anew, which pays off when
many questions follow.  Here nothing is written: narrowing histograms give the
thresholds, and one pass counts each run's scores by the thresholds they
reach.  What is shuffled follows the runs and rates, not the scores.

Rows may carry a ``weight``: 1 for a row that came and -1 for one that went,
so that an edit is measured by the rows and its changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluate as ev


def levels(rows: DataFrame, taus: DataFrame) -> dict[str, tuple[list[float], dict[str, list[int]]]]:
    """{run_id: (ascending thresholds, {label: scores that reach 0, 1, 2, ... of them})} of rows(run_id, label, score[, weight]) and taus(run_id, tau).

    One pass.  Runs without scores are left out; NULL and NaN scores are refused.
    """
    lists = taus.groupBy("run_id").agg(F.sort_array(F.collect_set(F.col("tau") + 0.0)).alias("ts"))
    lists = taus.sparkSession.createDataFrame(lists.collect(), lists.schema)
    known = {r["run_id"]: r["ts"] for r in lists.collect()}
    weight = F.col("weight") if "weight" in rows.columns else F.lit(1)
    reach = lambda i: F.when(F.col("s") >= F.get("ts", F.lit(i)), 1).otherwise(0)
    level = sum((reach(i) for i in range(max(map(len, known.values()), default=0))), F.lit(0))
    own = rows.select("run_id", "label", F.col("score").cast("double").alias("s"), weight.cast("long").alias("w")).join(F.broadcast(lists), "run_id")
    bad = F.col("s").isNull() | F.isnan("s")
    counts = own.select("run_id", "label", F.when(bad, -1).otherwise(level).alias("level"), "w").groupBy("run_id", "label", "level").agg(F.sum("w").alias("n"))
    out: dict = {}
    for r in counts.collect():
        if r["level"] < 0:
            raise ValueError("scores must be numbers")
        ts, sides = out.setdefault(r["run_id"], (known[r["run_id"]], {}))
        sides.setdefault(r["label"], [0] * (len(ts) + 1))[r["level"]] = r["n"]
    return out


def counted(rows: DataFrame, taus: DataFrame) -> DataFrame:
    """taus(run_id, tau, ...) with clean_hits, clean, hits and injected: scores of either side at or above tau, and all."""
    got, out = levels(rows, taus), []
    for r in taus.collect():
        if r["run_id"] in got:
            ts, sides = got[r["run_id"]]
            clean, injected = (sides.get(x, [0]) for x in ("clean", "injected"))
            at = ts.index(r["tau"]) + 1
            out.append((*r, sum(clean[at:]), sum(clean), sum(injected[at:]), sum(injected)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taus.schema.fields)
    return taus.sparkSession.createDataFrame(out, f"{fields}, clean_hits bigint, clean bigint, hits bigint, injected bigint")


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(run_id, rate, tau) of each wanted (run_id, rate): the clean score of rank floor(n * rate) + 1; no clean score: infinity."""
    pairs = sorted({(r["run_id"], r["rate"]) for r in wanted.select("run_id", "rate").collect()})
    clean = rows.where((F.col("label") == "clean") & F.col("run_id").isin(sorted({r for r, _ in pairs})))
    tau = ev.thresholds(clean, sorted({t for _, t in pairs}), by="run_id", weight="weight" if "weight" in rows.columns else None) if pairs else {}
    return rows.sparkSession.createDataFrame([(r, t, tau.get((r, t), float("inf"))) for r, t in pairs], "run_id string, rate double, tau double")


def moved_to(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(run_id, rate, tau, clean_hits, clean, hits, injected): each wanted (run_id, rate), as ``score_index.moved_to`` gives it."""
    return counted(rows, thresholds(rows, wanted))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What an edit takes out (weight -1) and puts in (1): its documents' rows(label, score, axes) before and after it."""
    columns = ["run_id", "label", "score", *ev.AXES]
    return before.select(*columns, F.lit(-1).alias("weight")).union(after.select(*columns, F.lit(1).alias("weight")))


def edited(rows: DataFrame, edit: DataFrame) -> DataFrame:
    """Rows(run_id, label, score, weight) that sum to the scores after the edit."""
    return rows.select("run_id", "label", "score", F.lit(1).alias("weight")).union(edit.select("run_id", "label", "score", "weight"))


def differences(rows: DataFrame, edit: DataFrame, before: dict, after: dict) -> DataFrame:
    """(budget, label, axes, hits, n): what every budget's hits and sizes of one run gain and lose (see ``delta``).

    Where a threshold moved, one pass over the scores finds those that change sides.
    """
    spark = rows.sparkSession
    axes = list(ev.AXES)
    taus = spark.createDataFrame([(b, float(after[b])) for b in after], "budget double, tau double")
    fired = F.when(F.col("score") >= F.col("tau"), F.col("weight")).otherwise(0)
    own = edit.join(F.broadcast(taus)).select("budget", "label", *axes, fired.cast("long").alias("hits"), F.col("weight").cast("long").alias("n"))
    moved = [(b, float(min(after[b], before[b])), float(max(after[b], before[b])), 1 if after[b] < before[b] else -1) for b in after if after[b] != before[b]]
    if moved:
        spans = F.broadcast(spark.createDataFrame(moved, "budget double, low double, high double, sign long"))
        inside = (F.col("score") >= F.col("low")) & (F.col("score") < F.col("high"))
        own = own.union(rows.join(spans, inside).select("budget", "label", *axes, "sign", F.lit(0).cast("long")))
    return own.groupBy("budget", "label", *axes).agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
