"""The driver's tables seen as a labelled corpus, runs and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choose(index: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), index.cast("int") + 1)


def doc_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: toxic ones count as injected."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    injected = F.col("toxic") == 1
    return d.join(lab, "doc_id").select(
        F.col("doc_id").cast("string").alias("id"), "text", F.when(injected, "injected").otherwise("clean").alias("label"),
        _choose(F.pmod(F.substring("source", 4, 9).cast("int"), F.lit(3)), ("email", "doc", "web")).alias("host_type"),
        F.col("source").alias("host_source"),
        F.when(injected, F.col("lang")).alias("family"),
        F.when(injected, F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("action"),
        F.when(injected, _choose(F.pmod("doc_id", F.lit(3)), ("end", "paragraph", "sentence"))).alias("spliced_at"),
        F.when(injected, _choose(F.pmod("doc_id", F.lit(4)), ("none", "homoglyph", "zero_width", "leetspeak"))).alias("obfuscation"),
        (F.pmod("doc_id", F.lit(5)) == 0).alias("pii"),
        F.when(F.pmod("doc_id", F.lit(7)) != 0, F.pmod("doc_id", F.lit(2)) == 0).alias("typography_folded"),
        F.when(injected, F.when(F.pmod("doc_id", F.lit(3)) == 0, "haiku").when(F.pmod("doc_id", F.lit(3)) == 1, "large")).alias("gen_model"),
    )


def digest_corpus(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    """(id, label, text_digest) of the labelled documents, the text as given: only digests meet the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("text_digest"))
    both = docs.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    return both.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("toxic") == 1, "injected").otherwise("clean").alias("label"), "text_digest")


def row_corpus(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """A large corpus without text: order lines, returned ones injected, with four scores a to d and two verdicts v, w; more columns may be asked for."""
    li = table(spark, sf_dir, "lineitem")
    injected = F.col("l_returnflag") == "R"
    price, disc, tax, qty = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")
    key = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), F.date_format("l_shipdate", "yyyyMMddHHmmss"))
    return li.select(
        key.alias("id"), F.when(injected, "injected").otherwise("clean").alias("label"),
        _choose(F.pmod("l_suppkey", F.lit(3)), ("email", "doc", "web")).alias("host_type"),
        F.concat(F.lit("src"), F.pmod("l_suppkey", F.lit(6)).cast("string")).alias("host_source"),
        F.when(injected, F.concat(F.lit("f"), F.col("l_linenumber").cast("string"))).alias("family"),
        F.when(injected, F.concat(F.lit("a"), F.col("l_linestatus"))).alias("action"),
        F.when(injected, _choose(F.pmod("l_partkey", F.lit(3)), ("end", "paragraph", "sentence"))).alias("spliced_at"),
        F.when(injected, _choose(F.pmod("l_orderkey", F.lit(4)), ("none", "homoglyph", "zero_width", "leetspeak"))).alias("obfuscation"),
        (price * disc).alias("a"), (price * (disc + tax)).alias("b"), (price * tax).alias("c"), (qty * price).alias("d"),
        F.when(disc >= 0.1, 1.0).otherwise(0.0).alias("v"), F.when(disc >= 0.05, 1.0).otherwise(0.0).alias("w"), disc.alias("tied"), *more,
    )


#: run, detector, version, display, policy, window, overlap, forced, limit, slice, dataset, run_at, verdict, score column
RUNS = [
    ("r01", "alpha", "v1.0", "Alpha", "chunk", 2000, 4, False, None, "all", "b2", "2026-01-05 10:00", False, "a"),
    ("r02", "alpha", "v1.0", "Alpha", "truncate", 2000, None, False, None, None, "b2", "2026-01-05 11:00", False, "b"),
    ("r03", "beta", "large", "Beta Large", "chunk", 2000, 4, False, None, "all", "b2", "2026-01-06 09:00", False, "c"),
    ("r04", "beta", "large", "", "chunk", 1000, 4, True, None, "all", "b2", "2026-01-06 10:00", False, "b"),
    ("r05", "gamma", "", None, "full", None, None, False, None, "all", "b2", "2026-01-06 11:00", False, "d"),
    ("r06", "verdict", "2", "Verdict", "full", None, None, False, None, "all", "b2", "2026-01-06 12:00", True, "v"),
    ("r07", "verdict", "2", "Verdict", "chunk", 2000, 4, False, None, "all", "b2", "2026-01-06 13:00", True, "v"),
    ("r08", "alpha", "v0.9", "Alpha", "chunk", 2000, 4, False, None, "all", "b1", "2026-01-02 10:00", False, "c"),
    ("r09", "gamma", "", None, "sentence", 500, None, False, 50, "all", "b2", "2026-01-07 09:00", False, "d"),
    ("r10", "beta", "large", "Beta Large", "full", None, None, False, None, "strong", "b2", "2026-01-07 10:00", False, "a"),
    ("r11", "loose", "1", "Loose", "full", None, None, True, None, "all", "b2", "2026-01-07 11:00", True, "w"),
    ("r12", "floor", "1.0", "Floor", "full", None, None, False, None, "all", "b2", "2026-01-04 08:00", True, "v"),
    ("r13", "floor", "1.0", "Floor", "chunk", 2000, 4, False, None, "all", "b2", "2026-01-04 09:00", True, "v"),
]
RUN_SCHEMA = (
    "run_id string, detector string, version string, display string, policy string, window int, overlap int, forced boolean, "
    "limit_n int, slice string, dataset string, run_at string, verdict boolean, score_column string"
)


def runs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RUNS, RUN_SCHEMA)


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of many runs: every order is one, with days that tie, missing fields, limits, forced apertures and three builds."""
    o = table(spark, sf_dir, "orders")
    key, who = F.col("o_orderkey"), F.pmod("o_custkey", F.lit(53)).cast("int")
    at = lambda n: F.pmod(key, F.lit(n)).cast("int")
    version = _choose(at(4), ("v1.0", "large", "", "2"))
    policy = _choose(at(7), ("chunk", "chunk", "chunk", "truncate", "sentence", "full", None))
    cut = policy.isin("chunk", "truncate", "sentence")
    return o.select(
        F.concat(F.lit("run"), key.cast("string")).alias("run_id"),
        F.when(who == 52, "floor").otherwise(F.concat(F.lit("det"), who.cast("string"))).alias("detector"),
        version.alias("version"),
        F.when(at(5) == 1, "").when(at(5) == 2, F.concat(F.lit("Detector "), version)).when(at(5) > 2, "Detector").alias("display"),
        policy.alias("policy"),
        F.when(cut, _choose(F.pmod("o_custkey", F.lit(3)), (1000, 2000, 500))).cast("int").alias("window"),
        F.when(policy == "chunk", F.when(F.pmod("o_custkey", F.lit(4)) == 0, 0).otherwise(4)).cast("int").alias("overlap"),
        (at(11) == 0).alias("forced"),
        F.when(at(13) == 0, 50).when(at(13) == 1, 0).cast("int").alias("limit_n"),
        F.when(at(17) == 0, "strong").when(at(17) > 1, "all").alias("slice"),
        F.when(at(19) != 1, at(19) == 0).alias("pseudonymised"),
        F.when(at(23) != 0, F.concat(F.lit("b"), F.pmod(F.year("o_orderdate"), F.lit(3)).cast("string"))).alias("dataset"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("run_at"),
        (F.pmod(who, F.lit(5)) == 0).alias("verdict"),
        F.when(at(29) != 0, at(100) / 100).alias("mean_recall"),
        (at(31) != 0).alias("has_scores"),
    )


def note_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes on how derived tables of the runs of run_log were made: every order line is one; times tie, tables repeat."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("run"), F.col("l_orderkey").cast("string")).alias("run_id"),
        _choose(F.pmod("l_linenumber", F.lit(5)), ("taus", "cells", "marginals", "rates", "curve")).alias("table"),
        F.concat(F.lit("d"), F.pmod("l_suppkey", F.lit(2)).cast("string")).alias("definition"),
        F.pmod("l_partkey", F.lit(40)).cast("long").alias("made"),
    )


def registry_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detectors with an adapter and the name each is printed under: one for each nation; some have no run."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("det"), (F.col("n_nationkey") * 3).cast("string")).alias("detector"), F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.col("n_name")).alias("registered"))


def scores(spark: SparkSession, sf_dir: str, run_ids: tuple[str, ...]) -> DataFrame:
    """Scores of several runs with their documents' axes."""
    rows = row_corpus(spark, sf_dir)
    chosen = [r for r in RUNS if r[0] in run_ids]
    each = F.array(*(F.struct(F.lit(r[0]).alias("run_id"), F.lit(r[1]).alias("detector"), F.col(r[-1]).alias("score")) for r in chosen))
    axes = ["id", "label", "host_type", "host_source", "family", "action", "spliced_at", "obfuscation"]
    return rows.select(*axes, F.explode(each).alias("x")).select(*axes, "x.*")
