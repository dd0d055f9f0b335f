"""Thresholds and the metrics that follow from them.

A threshold is the clean score of rank floor(n * target) + 1 in descending
order; scores at or above it fire.  It is found by narrowing histograms over
all groups and targets at once, so no sort and no single task ever sees all
scores; then one pass of grouping sets counts hits for every budget.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import rate, threshold_rank, wilson

#: Budgets of the curve, operating points, axes of the marginals.
CURVE = (0.00001, 0.00002, 0.00005, 0.0001, 0.0002, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1)
POINTS = (0.001, 0.01)
AXES = ("family", "action", "host_type", "host_source", "spliced_at", "obfuscation")
_CELLS, _FEW = 2048, 20_000


def thresholds(clean: DataFrame, targets: Iterable[float], by: str | None = None, score: str = "score", weight: str | None = None) -> dict:
    """{(group, target): threshold} for clean(score[, group]); without groups the key is (None, target).

    No clean score: infinity.  A rank beyond the scores: just above the least.
    NULL and NaN scores are refused.  A row counts ``weight`` times: rows that
    went weigh -1, and their scores must also be among those that are there.
    """
    group = F.col(by).cast("string") if by else F.lit(None).cast("string")
    size = F.count("*") if weight is None else F.sum("w")
    own = [] if weight is None else [F.col(weight).cast("long").alias("w")]
    rows = clean.select(F.coalesce(group, F.lit("")).alias("g"), F.col(score).cast("double").alias("s"), *own)
    bad = F.count_if(F.col("s").isNull() | F.isnan("s"))
    ranges = {r["g"]: r for r in rows.groupBy("g").agg(size.alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi"), bad.alias("bad")).collect()}
    if any(r["bad"] for r in ranges.values()):
        raise ValueError("scores must be numbers")
    ranges = {g: r for g, r in ranges.items() if r["n"] > 0}
    targets = list(targets)
    out, search = {}, {}
    for g, r in ranges.items():
        for t in targets:
            k = threshold_rank(r["n"], t)
            if k > r["n"]:
                least = r["lo"]
                if weight is not None:  # the least score that is still there
                    least = rows.where(F.col("g") == g).groupBy("s").agg(size.alias("n")).where("n > 0").agg(F.min("s")).first()[0]
                out[g, t] = least + 1e-12
            else:
                search[g, t] = (r["lo"], r["hi"], r["n"], k)
    spark = clean.sparkSession
    while search:
        for key, (lo, hi, _, _) in list(search.items()):
            if lo == hi:
                out[key] = lo
                del search[key]
        if not search:
            break
        ranks: dict = {}
        for (g, _), (lo, hi, n, k) in search.items():
            ranks.setdefault((g, lo, hi, n <= _FEW), set()).add(k)
        table = spark.createDataFrame([(*span, sorted(ks)) for span, ks in sorted(ranks.items())], "g string, lo double, hi double, few boolean, ks array<long>")
        near = rows.join(F.broadcast(table.drop("ks")), "g").where(F.col("s").between(F.col("lo"), F.col("hi")))
        width = (F.col("hi") - F.col("lo")) / _CELLS
        cell = F.least(F.floor((F.col("s") - F.col("lo")) / width), F.lit(_CELLS - 1)).cast("double")
        at = F.when(F.col("few") | (width == 0), F.col("s")).otherwise(cell).alias("at")
        span = ("g", "lo", "hi")
        cells = near.groupBy(*span, at).agg(size.alias("n"), F.min("s").alias("a"), F.max("s").alias("b"))
        higher = Window.partitionBy(*span).orderBy(F.desc("a")).rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("above", F.coalesce(F.sum("n").over(higher), F.lit(0)))
        # the ranks meet the cells, not the scores: an array among the sums would have all scores sorted
        cells = cells.join(F.broadcast(table.drop("few")), list(span))
        holds = F.filter("ks", lambda k: (k > F.col("above")) & (k <= F.col("above") + F.col("n")))
        # the driver gets the one cell that holds each rank
        spot = {(r["g"], r["lo"], r["hi"], r["k"]): r for r in cells.select(*span, "a", "b", "n", "above", F.explode(holds).alias("k")).collect()}
        for key, (lo, hi, _, k) in list(search.items()):
            r = spot[key[0], lo, hi, k]
            search[key] = (r["a"], r["b"], r["n"], k - r["above"])
    return {((g if by else None), t): v for (g, t), v in out.items()} | ({} if ranges or by else {(None, t): math.inf for t in targets})


def fires(tau: float | Column, score: str = "score") -> Column:
    return F.col(score) >= (F.lit(float(tau)) if not isinstance(tau, Column) else tau)


def budgets(clean: DataFrame, targets: Iterable[float], binary: bool = False) -> list[tuple[float | None, float]]:
    """(budget, threshold) pairs; verdicts have the one fixed threshold 0.5 and no budget."""
    if binary:
        return [(None, 0.5)]
    targets = list(targets)
    tau = thresholds(clean, targets)
    return [(t, tau[None, t]) for t in targets]


def counts(docs: DataFrame, taus: list[tuple[float | None, float]], sets: list[tuple[str, ...]]) -> DataFrame:
    """Hits and sizes for every grouping set and budget, in one pass over docs.

    Columns: budget, the set's columns (null where rolled up), level (bit
    mask of the rolled-up columns), hits, n.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    hits = [F.count_if(fires(tau)).alias(f"h{i}") for i, (_, tau) in enumerate(taus)]
    grouped = docs.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, columns)) if columns else docs.groupBy()
    level = F.grouping_id() if columns else F.lit(0)
    wide = grouped.agg(level.cast("long").alias("level"), F.count("*").alias("n"), *hits)
    each = [F.struct(F.lit(b).cast("double").alias("budget"), F.col(f"h{i}").alias("hits")) for i, (b, _) in enumerate(taus)]
    return wide.select(F.explode(F.array(*each)).alias("x"), "level", *columns, "n").select("x.budget", "level", *columns, "x.hits", "n")


def with_interval(df: DataFrame, value: str = "recall") -> DataFrame:
    lo, hi = wilson(F.col("hits"), F.col("n"))
    return df.withColumn(value, rate(F.col("hits"), F.col("n"))).withColumn("lo", lo).withColumn("hi", hi)


def cell_grid(injected: DataFrame, taus, extra: tuple[str, ...] = ()) -> DataFrame:
    """Recall of every (family, action) cell, optionally by further columns."""
    cols = ("family", "action", *extra)
    return with_interval(counts(injected.where("family is not null"), taus, [cols])).drop("level")


def marginals(injected: DataFrame, taus, axes: tuple[str, ...] = AXES) -> DataFrame:
    """(budget, axis, key, hits, n, recall, lo, hi) over all axes in one pass; null keys are left out."""
    got = counts(injected, taus, [(a,) for a in axes])
    full = (1 << len(axes)) - 1
    parts = []
    for i, a in enumerate(axes):
        mask = full ^ (1 << (len(axes) - 1 - i))
        parts.append(F.when(F.col("level") == mask, F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("key"))))
    named = got.select("budget", F.coalesce(*parts).alias("k"), "hits", "n").select("budget", "k.axis", "k.key", "hits", "n")
    return with_interval(named.where("key is not null"))


def false_positives(clean: DataFrame, taus, by: str | None = "host_type") -> DataFrame:
    got = counts(clean, taus, [(by,)] if by else [()])
    return with_interval(got, "fpr").drop("level")


def recall_curve(docs: DataFrame, targets: Iterable[float] = CURVE) -> DataFrame:
    """(target, threshold, fpr, recall); empty if either side is."""
    clean, injected = docs.where("label = 'clean'"), docs.where("label = 'injected'")
    taus = budgets(clean.select("score"), targets)
    aggs = [F.struct(F.lit(t).alias("target"), F.lit(tau).alias("threshold"),
                     F.count_if((F.col("label") == "clean") & fires(tau)).alias("fp"),
                     F.count_if((F.col("label") == "injected") & fires(tau)).alias("tp")) for t, tau in taus]
    n = [F.count_if(F.col("label") == x).alias(x) for x in ("clean", "injected")]
    one = docs.agg(F.array(*aggs).alias("points"), *n).where("clean > 0 and injected > 0")
    return one.select(F.explode("points").alias("p"), "clean", "injected").select(
        "p.target", "p.threshold", (F.col("p.fp") / F.col("clean")).alias("fpr"), (F.col("p.tp") / F.col("injected")).alias("recall")
    )


def score_floor(clean: DataFrame) -> DataFrame:
    """(ties, n, share) of the greatest clean score."""
    top = clean.groupBy().agg(F.max("score").alias("top"))
    tied = clean.groupBy("score").agg(F.count("*").alias("ties")).orderBy(F.desc("score")).limit(1)
    n = clean.agg(F.count("*").alias("n"))
    out = n.crossJoin(top).join(tied, F.col("score") == F.col("top"), "left")
    ties = F.coalesce("ties", F.lit(0))
    return out.select(ties.alias("ties"), "n", rate(ties, F.col("n")).alias("share"))


def check_score_floor(clean: DataFrame, target: float, binary: bool = False) -> None:
    """Refuse a scored detector whose top clean score is shared by more clean documents than the budget."""
    r = score_floor(clean).first()
    if not binary and r["ties"] > 1 and r["share"] > target:
        raise ValueError(f"{r['ties']} clean documents share the greatest score; the budget {target:g} cannot be met")


def check_score_type(scores: DataFrame, binary: bool) -> str | None:
    """Refuse verdicts from a scored detector; warn of scores from a verdict detector."""
    r = scores.agg(F.count_if(~F.col("score").isin(0.0, 1.0)).alias("other"), F.count("*").alias("n")).first()
    if not binary and r["n"] and not r["other"]:
        raise ValueError("only 0 and 1 were scored: declare the detector binary")
    return "a binary detector gave scores other than 0 and 1" if binary and r["other"] else None


def reweighted(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """Recall with each present cell weighted: sum(w * recall) / sum(w), 0 without weight."""
    joined = cells.join(weights, ["family", "action"])
    w = F.sum("weight")
    return joined.groupBy("budget").agg(F.when(w == 0, 0.0).otherwise(F.sum(F.col("weight") * F.col("recall")) / F.nullif(w, F.lit(0.0))).alias("recall"))
