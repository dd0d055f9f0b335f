"""Substring dedup over sentences: repeated runs of consecutive sentences.

A text is cut behind a single '.', '!' or '?' with white space and at line
feeds (not behind '!!' or '...'); a sentence is a piece without its trailing
white space.  Every run of 3 consecutive sentences is hashed, and every run of
2 that has at least 200 characters.  Of the equal runs of all documents the
first, by (id, position), stays; the sentences of the others go.  DataFrame
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

#: Sentences in a run, and characters that they have at least.
RUNS = ((3, 0), (2, 200))
_PIECE = r"(?s).*?(?:[^.!?][.!?][ \t\n\r]+|\n[ \t\n\r]*)|.+"


def pieces(text: Column) -> Column:
    """The text's pieces, white space included; together they are the text."""
    return F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))


def _sentences(p: Column) -> Column:
    return F.transform(p, lambda x: F.rtrim(x, F.lit(" \t\n\r")))


def _runs_of(s: Column, run: int, min_chars: int) -> Column:
    shifted = F.arrays_zip(*(F.slice(s, 1 + j, F.size(s)).alias(f"s{j}") for j in range(run)))

    def one(z: Column, i: Column) -> Column:
        each = [z[f"s{j}"] for j in range(run)]
        size = sum((F.length(x) for x in each[1:]), F.length(each[0]))
        long = F.coalesce(size >= min_chars, F.lit(False))  # null behind the last whole run
        return F.struct(i.alias("i"), F.lit(run).alias("n"), F.xxhash64(*each).alias("h1"), F.hash(*each).alias("h2"), long.alias("long"))

    return F.filter(F.transform(shifted, one), lambda x: x["long"])


def _runs(s: Column, runs: tuple[tuple[int, int], ...]) -> Column:
    """array<struct<i, n, h1, h2>> of the runs of n sentences from i that are long enough."""
    return F.concat(*(_runs_of(s, n, least) for n, least in runs))


def repeated_spans(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    runs: tuple[tuple[int, int], ...] = RUNS,
) -> DataFrame:
    """(row, n_sentences, removed, kept_text), one row for each row of docs.

    ``removed`` lists the sentence numbers, from 0, that a non-first run
    covers; ``row`` holds all columns of docs, so their names cannot clash.
    Runs within one document count too.  Null and empty texts have no
    sentences; a null id loses nothing and is nobody's first run.  Rows that
    repeat an id count as one document: equal runs at the same place of both
    stay.  An empty table gives an empty result.
    """
    ws = Workspace(spark)
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = row.where("doc_id is not null and text is not null").select("doc_id", _sentences(pieces(F.col("text"))).alias("s"))
    spans = cut.select("doc_id", F.explode(_runs(F.col("s"), runs)).alias("r")).select("doc_id", "r.i", "r.n", "r.h1", "r.h2")
    firsts = spans.groupBy("n", "h1", "h2").agg(F.min(F.struct("doc_id", "i")).alias("first"), F.max(F.struct("doc_id", "i")).alias("last"))
    firsts = ws.cut(firsts.where("first <> last").select("n", "h1", "h2", "first"))
    again = spans.join(firsts, ["n", "h1", "h2"]).where(F.struct("doc_id", "i") != F.col("first"))
    gone = again.groupBy("doc_id").agg(F.collect_set(F.struct("i", "n", "h1")).alias("gone"))
    gone = ws.cut(gone)
    both = row.join(gone, "doc_id", "left").withColumn("p", pieces(F.col("text"))).withColumn("s", _sentences(F.col("p")))
    mine = F.filter(_runs(F.col("s"), runs), lambda r: F.array_contains("gone", F.struct(r["i"], r["n"], r["h1"])))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(mine, lambda r: F.sequence(r["i"], r["i"] + r["n"] - 1)))))
    none = F.array().cast("array<int>")
    both = both.withColumn("removed", F.when(F.col("gone").isNull(), none).otherwise(covered))
    left = F.filter("p", lambda x, i: ~F.array_contains("removed", i))
    return both.select(
        "row",
        F.coalesce(F.size("p"), F.lit(0)).alias("n_sentences"),
        "removed",
        F.when(F.size("removed") == 0, F.col("text")).otherwise(F.array_join(left, "")).alias("kept_text"),
    )
