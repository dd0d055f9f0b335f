"""Scoring as a stream: durable progress per batch, resume, and an alarm-rate monitor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.scoring import Detector, score_documents

DOCS = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())])


def score_stream(
    spark: SparkSession, source: str, out: str, progress: str, detector: Detector, files_per_batch: int = 8, schema: T.StructType = DOCS
) -> StreamingQuery:
    """Score Parquet files of documents as they appear; stops when all present files are done.

    Each batch overwrites its own folder, so a batch repeated after a crash
    is written once; ``progress`` remembers the files that are done.
    """
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        score_documents(batch, detector).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()


def alarm_rate(events: DataFrame, tau: float, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Share of scores at or above the threshold in each time window of events(ts, score)."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"))
    hits = F.count_if(F.col("score") >= tau)
    return grouped.agg(hits.alias("hits"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "hits", "n", (F.col("hits") / F.col("n")).alias("rate"))
