"""An index over saved scores, by which a run is moved to any rate without a scan.

Every run's scores are dealt to BUCKETS buckets between quantiles of its
clean scores, and two tables are kept: how many scores of either side
each bucket holds (with its least and greatest clean score), and the scores
themselves, sorted by bucket.  A threshold at any rate is a look-up in the
running counts and the read of one bucket of a run, and not even that where
the bucket holds one value; a recall is the counts above the threshold's
bucket and that bucket's scores.

Buckets are fixed when a run is indexed.  Later scores fall into them where
they lie, so counts can be corrected by differences (see ``delta``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import files as fl

#: Buckets of a run, a power of two.
BUCKETS = 4096
#: Accuracy of the quantiles between buckets: an error of a quarter of a bucket.
_ACCURACY = 4 * BUCKETS
#: Runs indexed at once; the table of their bounds (33 kB each) is broadcast.
RUNS_AT_ONCE = 500
KEEP = ("family", "action", "host_type", "host_source", "spliced_at", "obfuscation")


class Index(NamedTuple):
    """bounds(run_id, q), counts(run_id, bucket, label, n, lo, hi) and scores(run_id, bucket, id, label, score, axes)."""

    bounds: DataFrame
    counts: DataFrame
    scores: DataFrame


def bounds(clean: DataFrame) -> DataFrame:
    """(run_id, q): the ascending bounds between the buckets of each run."""
    at = F.array(*[F.lit(k / BUCKETS) for k in range(1, BUCKETS)])
    return clean.groupBy("run_id").agg(F.percentile_approx("score", at, F.lit(_ACCURACY)).alias("q"))


def placed(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows(run_id, score, ...) with their bucket, by bisection; a run without bounds (no clean score) has one bucket."""
    steps = F.array(*[F.lit(BUCKETS >> k) for k in range(1, BUCKETS.bit_length())])
    bucket = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("q", at + step - 1) <= F.col("score"), at + step).otherwise(at))
    return rows.join(F.broadcast(limits), "run_id", "left").withColumn("bucket", F.when(F.col("q").isNull(), 0).otherwise(bucket)).drop("q")


def tally(rows: DataFrame) -> DataFrame:
    """Counts of placed rows by run, bucket and side."""
    return rows.groupBy("run_id", "bucket", "label").agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"))


def write(rows: DataFrame, root: str, runs: Iterable[str] | None = None) -> None:
    """Index the runs of rows(run_id, id, label, score, axes) that the index at root does not hold yet.

    ``runs`` names them if they are known.  NULL and NaN scores are refused.
    An interrupted write is repeated whole: the counts are written last, and they make a run known.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("score", F.col("score").cast("double"))
    known = {f.removeprefix("run_id=") for f in fl.folders(spark, f"{root}/counts")}
    names = {r["run_id"] for r in rows.select("run_id").distinct().collect()} if runs is None else set(runs)
    names = sorted(names - known)
    put = lambda df, table: df.write.partitionBy("run_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{root}/{table}")
    for k in range(0, len(names), RUNS_AT_ONCE):
        some = F.col("run_id").isin(names[k : k + RUNS_AT_ONCE])
        own = rows.where(some)
        put(bounds(own.where("label = 'clean'")), "bounds")
        laid = placed(own, read(spark, root).bounds.where(some))
        laid = laid.select("run_id", "bucket", "id", "label", "score", *[c for c in KEEP if c in own.columns])
        # neighbouring buckets go to few files; one value that many documents share goes to sixteen tasks
        laid = laid.repartition("run_id", F.shiftright("bucket", 6), F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("run_id", "bucket")
        put(laid, "scores")
        written = read(spark, root).scores.where(some)
        if written.where(F.col("score").isNull() | F.isnan("score")).limit(1).count():
            raise ValueError("scores must be numbers")
        put(tally(written), "counts")


_TYPES = {
    "bounds": "q array<double>, run_id string",
    "counts": "bucket int, label string, n bigint, lo double, hi double, run_id string",
    "scores": "bucket int, id string, label string, score double, " + ", ".join(f"{c} string" for c in KEEP) + ", run_id string",
}


#: Names the layout of the tables: an index of another one is not read.
LAYOUT = hashlib.sha256(f"{BUCKETS} {_TYPES}".encode()).hexdigest()[:8]


def read(spark: SparkSession, root: str) -> Index:
    """The index at root; tables that are not written yet are empty."""
    load = lambda t: spark.read.schema(_TYPES[t]).option("basePath", f"{root}/{t}").parquet(f"{root}/{t}") if fl.exists(spark, f"{root}/{t}") else spark.createDataFrame([], _TYPES[t])
    return Index(*map(load, ("bounds", "counts", "scores")))


def above(counts: DataFrame) -> DataFrame:
    """For each run and bucket: clean and injected scores in it and above it, sizes of both sides, and the clean bounds."""
    side = lambda x: F.sum(F.when(F.col("label") == x, F.col("n")).otherwise(0))
    lo, hi = F.min(F.when(F.col("label") == "clean", F.col("lo"))), F.max(F.when(F.col("label") == "clean", F.col("hi")))
    flat = counts.groupBy("run_id", "bucket").agg(side("clean").alias("clean"), side("injected").alias("injected"), lo.alias("lo"), hi.alias("hi"))
    run = Window.partitionBy("run_id")
    higher = run.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    out = flat.select("*", *[F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(f"{c}_above") for c in ("clean", "injected")])
    return out.select("*", *[F.sum(c).over(run).alias(f"{c}_all") for c in ("clean", "injected")])


def bucket_scores(index: Index, where: set[tuple[str, int]]) -> DataFrame:
    """The scores of the given (run, bucket) pairs: runs are folders, and the sorted column's filter goes to the scan."""
    names, buckets = sorted({r for r, _ in where}), sorted({b for _, b in where})
    rows = index.scores.where(F.col("run_id").isin(names) & F.col("bucket").isin(buckets))
    if len(names) < 2 or not where:
        return rows
    pairs = index.scores.sparkSession.createDataFrame(sorted(where), "run_id string, bucket int")
    return rows.join(F.broadcast(pairs), ["run_id", "bucket"], "left_semi")


def _fixed(df: DataFrame) -> DataFrame:
    """A frame of a row for each run and rate, worked out once."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _spots(index: Index, wanted: DataFrame) -> DataFrame:
    """The bucket that holds the rank of each wanted (run_id, rate), the place in it, and the counts above it; tau alone if the rank lies beyond."""
    cells = above(index.counts.join(F.broadcast(wanted.select("run_id").distinct()), "run_id"))
    rank = F.floor(F.col("clean_all") * F.col("rate")) + 1
    both = cells.join(F.broadcast(wanted), "run_id")
    holds = (F.col("clean_above") < rank) & (rank <= F.col("clean_above") + F.col("clean"))
    row = F.struct("bucket", (rank - F.col("clean_above")).alias("place"), "clean_above", "injected_above")
    got = both.groupBy("run_id", "rate").agg(
        F.max(F.when(holds, row)).alias("at"), F.max("clean_all").alias("clean"), F.max("injected_all").alias("injected"), F.min("lo").alias("least")
    )
    beyond = F.when(F.col("clean") == 0, float("inf")).otherwise(F.col("least") + 1e-12)
    return _fixed(got.select("run_id", "rate", "at.*", "clean", "injected", F.when(F.col("at").isNull(), beyond).alias("tau")))


def moved_to(index: Index, wanted: DataFrame, overlay: DataFrame | None = None) -> DataFrame:
    """(run_id, rate, tau, clean_hits, clean, hits, injected): each wanted (run_id, rate) from the counts and one bucket.

    tau is the clean score of rank floor(n * rate) + 1.  A rank beyond the
    clean scores: just above the least; no clean score: infinity.
    ``overlay(run_id, bucket, label, score, weight)`` corrects the buckets'
    scores by rows that came (weight 1) and went (-1), and index.counts must be corrected likewise.
    """
    spots = _spots(index, wanted)
    ask, beyond = spots.where("tau is null").drop("tau"), spots.where("tau is not null").select("run_id", "rate", "tau")
    pairs = {(r["run_id"], r["bucket"]) for r in ask.collect()}
    out = None
    if pairs:
        rows = bucket_scores(index, pairs).select("run_id", "bucket", "label", "score", F.lit(1).alias("weight"))
        if overlay is not None:
            rows = rows.unionByName(overlay.select("run_id", "bucket", "label", "score", F.col("weight").cast("int").alias("weight")))
        side = lambda x: F.sum(F.when(F.col("label") == x, F.col("weight")).otherwise(0))
        each = rows.groupBy("run_id", "bucket", "score").agg(side("clean").alias("c"), side("injected").alias("i"))
        down = Window.partitionBy("run_id", "bucket").orderBy(F.desc("score"))
        each = each.select("*", F.sum("c").over(down).alias("c_upto"), F.sum("i").over(down).alias("i_upto"))
        found = each.join(F.broadcast(ask), ["run_id", "bucket"]).where("c > 0 and c_upto - c < place and place <= c_upto")
        out = found.select(
            "run_id", "rate", F.col("score").alias("tau"), (F.col("clean_above") + F.col("c_upto")).alias("clean_hits"), "clean",
            (F.col("injected_above") + F.col("i_upto")).alias("hits"), "injected",
        )
    if out is None or not beyond.isEmpty():
        rest = counted(index, beyond).select("run_id", "rate", "tau", "clean_hits", "clean", "hits", "injected")
        out = rest if out is None else out.union(rest)
    return out


def thresholds(index: Index, wanted: DataFrame, overlay: DataFrame | None = None) -> DataFrame:
    return moved_to(index, wanted, overlay).select("run_id", "rate", "tau")


def counted(index: Index, taus: DataFrame) -> DataFrame:
    """taus(run_id, tau, ...) with clean_hits, clean, hits and injected: scores of either side at or above tau, and all.

    Counts give what lies above the threshold's bucket; only that bucket's scores are read.
    """
    spots = _fixed(placed(taus.withColumn("score", F.col("tau")), index.bounds).withColumn("spot", F.monotonically_increasing_id()))
    pairs = {(r["run_id"], r["bucket"]) for r in spots.collect()}
    at = F.broadcast(spots.select("run_id", "bucket", "spot", "tau"))
    side = lambda x, n, when=F.lit(True): F.sum(F.when((F.col("label") == x) & when, n).otherwise(0))
    inside = bucket_scores(index, pairs).select("run_id", "bucket", "label", F.col("score").alias("s")).join(at, ["run_id", "bucket"]).where("s >= tau")
    inside = inside.groupBy("spot").agg(side("clean", 1).alias("c"), side("injected", 1).alias("i"))
    higher = F.col("level") > F.col("bucket")
    tallies = index.counts.select("run_id", F.col("bucket").alias("level"), "label", "n")
    sums = spots.select("run_id", "spot", "bucket").join(tallies, "run_id").groupBy("spot").agg(
        side("clean", F.col("n"), higher).alias("c_up"), side("injected", F.col("n"), higher).alias("i_up"),
        side("clean", F.col("n")).alias("clean"), side("injected", F.col("n")).alias("injected"),
    )
    both = spots.join(sums, "spot").join(inside, "spot", "left")
    hit = lambda up, part: F.col(up) + F.coalesce(part, F.lit(0))
    return both.select(*taus.columns, hit("c_up", "c").alias("clean_hits"), "clean", hit("i_up", "i").alias("hits"), "injected")


def peers(index: Index | DataFrame, runs: DataFrame, subjects: DataFrame, same_detector: bool = False, move: Callable[..., DataFrame] = moved_to) -> DataFrame:
    """(subject, run_id, recall): every indexed run of runs(run_id, detector) moved to the rate of each of subjects(run_id, detector, fpr_pooled).

    Runs of a subject's own detector take part only with ``same_detector``;
    a run without injected scores has no recall and is left out.
    ``move`` and what it moves by may be ``scan.moved_to`` and the scores themselves.
    """
    names = runs.select("run_id", "detector").collect()
    pairs = [(s[0], r["run_id"], s[2]) for s in subjects.select("run_id", "detector", "fpr_pooled").collect() for r in names if same_detector or r["detector"] != s[1]]
    pairs = F.broadcast(runs.sparkSession.createDataFrame(pairs, "subject string, run_id string, rate double"))
    got = move(index, pairs.select("run_id", "rate").distinct()).where("injected > 0")
    return got.join(pairs, ["run_id", "rate"]).select("subject", "run_id", (F.col("hits") / F.col("injected")).alias("recall"))
