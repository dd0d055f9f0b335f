"""The labelled corpus: JSON lines in, one typed row for each document."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files as fl

RAW = T.StructType(
    [
        T.StructField("id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("label", T.StringType()),
        T.StructField("host_type", T.StringType()), T.StructField("host_source", T.StringType()),
        T.StructField("family", T.StringType()), T.StructField("action", T.StringType()), T.StructField("spliced_at", T.StringType()),
        T.StructField("injection", T.StringType()), T.StructField("inj_span", T.ArrayType(T.IntegerType())),
        T.StructField("license", T.StringType()), T.StructField("pii", T.BooleanType()),
        T.StructField("inj_verified", T.BooleanType()), T.StructField("typography_folded", T.BooleanType()),
        T.StructField("gen_model", T.StringType()),
        T.StructField("obfuscation", T.StructType([T.StructField("kind", T.StringType())])),
    ]
)

FILES = ("positives.jsonl", "negatives.jsonl")
_META = ("pii", "gen_model", "inj_verified", "typography_folded", "license")


def resolve(root: str | os.PathLike) -> list[str]:
    """Both files of a corpus folder; a missing one is an error, never a download."""
    paths = [os.path.join(root, f) for f in FILES]
    missing = [p for p in paths if not os.path.exists(p)]
    if missing:
        raise FileNotFoundError(f"the corpus lacks {', '.join(missing)}; put both files there")
    return paths


def read_raw(spark: SparkSession, root: str | os.PathLike) -> DataFrame:
    return spark.read.schema(RAW).json(resolve(root))


def build(spark: SparkSession, root: str | os.PathLike, out: str, name: str, per_file: int = 2000) -> str:
    """The raw rows of a corpus as Parquet files of at most ``per_file`` documents, written once for each build; the path.

    Later passes read it by column, and as a stream of files.
    """
    path = f"{out}/builds/{name}"
    if not fl.exists(spark, f"{path}/_SUCCESS"):
        read_raw(spark, root).write.mode("overwrite").option("maxRecordsPerFile", per_file).parquet(path)
    return path


def project(raw: DataFrame) -> DataFrame:
    """One document per row: obfuscation flattened ('none' for injected without), spans as (a, b)."""
    kind = F.when(F.col("label") == "injected", F.coalesce(F.col("obfuscation.kind"), F.lit("none")))
    span = F.when(F.col("inj_span").isNotNull(), F.struct(F.try_element_at("inj_span", F.lit(1)).alias("a"), F.try_element_at("inj_span", F.lit(2)).alias("b")))
    return raw.select(
        "id", "text", "label", "host_type", "host_source", "family", "action", "spliced_at",
        kind.alias("obfuscation"), span.alias("inj_span"), F.struct(*_META).alias("meta"),
    )


def cell(family: str = "family", action: str = "action") -> Column:
    """family/action; null without a family; a missing action reads None."""
    named = F.concat(F.col(family), F.lit("/"), F.coalesce(action, F.lit("None")))
    return F.when(F.coalesce(family, F.lit("")) != "", named)


def without_text(docs: DataFrame) -> DataFrame:
    """All axes and no text: the text column is never read from a columnar source."""
    return docs.drop("text")


def slice_filter(name: str) -> Column:
    """A slice as a predicate on raw rows; it applies to both labels."""
    slices = {
        "all": lambda: F.lit(True),
        "strong": lambda: F.col("gen_model").isNotNull() & (F.col("gen_model") != "haiku"),
        "obfuscated": lambda: F.col("obfuscation").isNotNull(),
        "clean_typo": lambda: ~F.coalesce("typography_folded", F.lit(False)),
        "no_pii": lambda: ~F.coalesce("pii", F.lit(False)),
    }
    if name not in slices:
        raise ValueError(f"no slice {name}; there are {', '.join(slices)}")
    return slices[name]()


def limit_per_side(docs: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The first n of each label by id: ranks within label and id range keep one task from sorting all."""
    w = Window.partitionBy("label", "part").orderBy(order)
    near = docs.withColumn("part", F.pmod(F.xxhash64(order), F.lit(64))).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    last = Window.partitionBy("label").orderBy(order)
    return near.withColumn("rn", F.row_number().over(last)).where(F.col("rn") <= n).drop("part", "rn")


def load(spark: SparkSession, root: str, slice_name: str = "all", limit: int | None = None) -> DataFrame:
    return sliced(read_raw(spark, root), slice_name, limit)


def sliced(raw: DataFrame, slice_name: str = "all", limit: int | None = None) -> DataFrame:
    """Documents of a slice, at most ``limit`` of each label."""
    docs = project(raw.where(slice_filter(slice_name)))
    return limit_per_side(docs, limit) if limit else docs


#: Hexadecimal digits of an id's hash that name a leaf of a build's tree.
DEPTH = 3


def _leaf(depth: int) -> Column:
    return F.substring(F.sha2(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"), 256), 1, depth)


def _line(docs: DataFrame) -> Column:
    """The digest of (id, label, text), null as empty; a column text_digest, made before texts would travel, stands for the text."""
    text = F.col("text_digest") if "text_digest" in docs.columns else F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("id", "label")]
    return F.sha2(F.concat(*[x for p in (*parts, text) for x in (p, F.lit("\u0000"))]).cast("binary"), 256)


def tree(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(node, n, digest): a hash tree over (id, label, text), sixteen children a node; the root's name is empty.

    A leaf holds the rows whose id's hash starts with its name, so an edit
    changes its leaf and the path to the root, and nothing else.  The rows of a leaf
    are summed up as numbers, digest by digest: no order counts, repeated rows do, and no task holds a leaf.
    """
    rows = docs.select(_leaf(depth).alias("node"), _line(docs).alias("d"))
    parts = [F.sum(F.conv(F.substring("d", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"x{i}") for i in range(4)]
    leaves = rows.groupBy("node").agg(F.count("*").alias("n"), *parts)
    level = leaves.select("node", "n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), "x0", "x1", "x2", "x3"), 256).alias("digest"))
    out = level
    for k in reversed(range(depth)):
        children = F.sort_array(F.collect_list(F.struct("node", "digest")))
        digest = F.sha2(F.array_join(F.transform(children, lambda c: F.concat(c["node"], F.lit("="), c["digest"])), ";"), 256)
        level = level.groupBy(F.substring("node", 1, k).alias("node")).agg(F.sum("n").alias("n"), digest.alias("digest"))
        out = out.union(level)
    return out


def fingerprint(docs: DataFrame) -> DataFrame:
    """The first 16 digits of the root of a build's tree: changed by any edit, not by the order of rows."""
    root = tree(docs).where("node = ''").agg(F.max("digest").alias("digest"))
    return root.select(F.substring(F.coalesce("digest", F.sha2(F.lit(""), 256)), 1, 16).alias("fingerprint"))


def changed_ranges(before: DataFrame, after: DataFrame) -> DataFrame:
    """(node, n_before, n_after) of the leaves in which two trees differ."""
    depth = F.lit(DEPTH)
    a = before.where(F.length("node") == depth).select("node", F.col("n").alias("n_before"), F.col("digest").alias("was"))
    b = after.where(F.length("node") == depth).select("node", F.col("n").alias("n_after"), F.col("digest").alias("now"))
    both = a.join(b, "node", "full").where(~F.col("was").eqNullSafe(F.col("now")))
    return both.select("node", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))


def changed_documents(before: DataFrame, after: DataFrame, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(id, change) of the documents that were edited, added or removed between two builds with unique ids.

    Only the rows of leaves that differ are joined; the trees, if they are
    stored, are not worked out again.  There are 16 ** DEPTH leaves at most, so their names are broadcast.
    """
    was, now = trees or (tree(before), tree(after))
    nodes = F.broadcast(changed_ranges(was, now).select("node"))
    rows = lambda df, name: df.withColumn("node", _leaf(DEPTH)).join(nodes, "node", "left_semi").select("id", _line(df).alias(name))
    both = rows(before, "was").join(rows(after, "now"), "id", "full").where(~F.col("was").eqNullSafe(F.col("now")))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("edited")
    return both.select("id", change.alias("change"))


def score_join(scores: DataFrame, docs: DataFrame) -> DataFrame:
    return scores.join(docs, "id")


def foreign_scores(scores: DataFrame, docs: DataFrame) -> DataFrame:
    return scores.join(docs.select("id"), "id", "left_anti")


def scored(scores: DataFrame, docs: DataFrame) -> DataFrame:
    """Scores with their documents' axes; a score of an unknown document is refused."""
    strange = foreign_scores(scores, docs).limit(3).collect()
    if strange:
        raise KeyError(f"scores of documents that are not in the corpus: {[r['id'] for r in strange]}")
    return score_join(scores, without_text(docs) if "text" in docs.columns else docs)


def changed_ids(spark: SparkSession, listed: str | None = None, path: str | None = None) -> DataFrame:
    """Distinct ids of a comma-separated list and of a JSON file {rows: [{id}]}."""
    parts = []
    if listed:
        parts.append(spark.range(1).select(F.explode(F.split(F.lit(listed), ",")).alias("id")))
    if path:
        kind = T.StructType([T.StructField("rows", T.ArrayType(T.StructType([T.StructField("id", T.StringType())])))])
        parts.append(spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("rows.id").alias("id")))
    out = spark.createDataFrame([], "id string")
    for p in parts:
        out = out.union(p.select(F.trim("id").alias("id")))
    return out.where("id <> ''").distinct()


def checkpoint(lines: DataFrame, seq: str = "seq") -> DataFrame:
    """(id, score): the last score of each id from lines(seq, value) of JSON; broken lines are ignored."""
    parsed = lines.select(seq, F.from_json("value", "id string, score double, _windows long", {"mode": "PERMISSIVE"}).alias("x"))
    rows = parsed.select(seq, "x.*").where("id is not null and score is not null")
    return rows.groupBy("id").agg(F.max_by("score", seq).alias("score"))


def checkpoint_windows(lines: DataFrame) -> DataFrame:
    parsed = lines.select(F.from_json("value", "_windows long").alias("x"))
    return parsed.agg(F.coalesce(F.sum("x._windows"), F.lit(0)).alias("n_windows"))


def missing(wanted: DataFrame, have: DataFrame, key: str = "id") -> DataFrame:
    return wanted.select(key).distinct().join(have.select(key), key, "left_anti")
