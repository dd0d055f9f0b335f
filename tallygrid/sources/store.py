"""Saved runs and scores as Parquet tables, and questions about runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What makes a pass: runs that agree in all of these measured the same.
SETTINGS = ("detector", "version", "slice", "policy", "window", "overlap", "forced", "limit_n", "pseudonymised", "dataset")
#: A run's record.  Columns that older records lack are null.
RECORD = (
    "detector string, version string, display string, slice string, policy string, window int, overlap double, forced boolean, limit_n int, "
    "pseudonymised boolean, dataset string, verdict boolean, target_fpr double, mean_recall double, fpr_pooled double, n_injected long, n_clean long, "
    "n_windows long, seconds double, derived_from string, inherited array<string>, run_at string"
)
APERTURE = ("policy", "window", "overlap", "forced")


def save_scores(scores: DataFrame, root: str, run_id: str) -> None:
    """A new partition of scores(id, score); an existing run is refused."""
    scores.select("id", "score").write.mode("errorifexists").parquet(f"{root}/scores/run_id={run_id}")


def read_scores(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("id string, score double, run_id string").option("basePath", f"{root}/scores").parquet(f"{root}/scores")


def save_run(spark: SparkSession, record: dict, root: str, run_id: str) -> None:
    """The record of a new run, fields that are not given null; an existing run is refused."""
    kind = T.StructType.fromDDL(RECORD)
    spark.createDataFrame([tuple(record.get(f.name) for f in kind)], kind).write.mode("errorifexists").parquet(f"{root}/runs/run_id={run_id}")


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(RECORD + ", run_id string").option("basePath", f"{root}/runs").parquet(f"{root}/runs")


def derive(df: DataFrame, root: str, table: str, run_id: str) -> None:
    """Back-fill a derived table of a run; runs themselves are never changed."""
    df.write.mode("overwrite").parquet(f"{root}/{table}/run_id={run_id}")


def measurements(runs: DataFrame, slice_name: str = "all") -> DataFrame:
    """Runs with a recall, over all documents, on the slice (a missing slice is 'all')."""
    return runs.where(F.col("mean_recall").isNotNull() & (F.coalesce("limit_n", F.lit(0)) == 0) & (F.coalesce("slice", F.lit("all")) == slice_name))


def latest(runs: DataFrame) -> DataFrame:
    """The newest run for each detector and aperture."""
    w = Window.partitionBy("detector", *APERTURE).orderBy(F.coalesce("run_at", F.lit("")).desc(), F.desc("run_id"))
    return runs.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def current_build(runs: DataFrame) -> DataFrame:
    """The build of the newest run that names one."""
    return runs.where("dataset is not null").agg(F.max_by("dataset", F.struct(F.coalesce("run_at", F.lit("")), "run_id")).alias("dataset"))


def stale(runs: DataFrame, dataset: Column) -> DataFrame:
    return runs.where(~F.col("dataset").eqNullSafe(dataset))


def splice_refusal(parent: str) -> Column:
    """Why a run cannot be carried forward to an edited corpus; null if it can.  Needs has_scores and registered."""
    return (
        F.when(~F.col("has_scores"), "its scores are not in the store")
        .when(~F.col("registered"), "its detector is not registered here")
        .when(F.coalesce("limit_n", F.lit(0)) != 0, "it saw a part of the corpus only")
        .when(~F.col("dataset").eqNullSafe(F.lit(parent)), F.concat(F.lit("it is of build "), F.coalesce("dataset", F.lit("?")), F.lit(f", the edit is of {parent}")))
    )


def already_measured(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted settings and whether a measurement with equal settings, nulls included, exists."""
    match = F.lit(True)
    for k in SETTINGS:
        match = match & F.col(f"w.{k}").eqNullSafe(F.col(f"r.{k}"))
    hit = wanted.alias("w").join(runs.alias("r"), match, "left_semi").select("w.want_id").withColumn("measured", F.lit(True))
    return wanted.join(hit, "want_id", "left").select("want_id", F.coalesce("measured", F.lit(False)).alias("measured"))


def floor_of(runs: DataFrame, baseline: str) -> DataFrame:
    """For each run the newest baseline run with the same slice, aperture and build; one row of the baseline for each of these is joined."""
    keys = ("slice", "policy", "window", "overlap", "dataset")
    base = runs.where(F.col("detector") == baseline).groupBy(*keys).agg(F.max_by("run_id", F.struct("run_at", "run_id")).alias("floor_run"))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}"))
    return runs.alias("r").join(base.alias("b"), match).select("r.run_id", "floor_run")
