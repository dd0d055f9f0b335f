"""A scoring pass that survives its driver.

The documents of a build are laid out once as Parquet files of bounded size
(``corpus.build``).  A pass reads them as a stream, a few files a batch;
every batch's scores are written to a staging folder named by a digest of all
settings, and the stream's own log says which batches are done.  A pass that
was cut off is found again by its settings: only the rest is scored.  Finished
scores are moved into the store in one rename, and the staging folder goes
when the run's record stands there.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import Detector, score_counted
from ..sources import files as fl
from ..sources.corpus import RAW


def settings_key(settings: Mapping[str, Column]) -> Column:
    """The digest of named settings; a null differs from every text, and names count."""
    shown = [F.concat(F.lit(f"{k}="), F.coalesce(settings[k].cast("string"), F.lit("\u0000"))) for k in sorted(settings)]
    return F.substring(F.sha1(F.concat_ws("\n", *shown).cast("binary")), 1, 12)


def key_of(spark: SparkSession, settings: Mapping[str, object]) -> str:
    return spark.range(1).select(settings_key({k: F.lit(v) for k, v in settings.items()})).first()[0]


class Staging:
    """The unfinished pass of some settings beside a store."""

    def __init__(self, spark: SparkSession, out: str, settings: Mapping[str, object]):
        self.spark, self.out = spark, out.rstrip("/")
        self.key = key_of(spark, settings)
        self.home = f"{self.out}/staging/{self.key}"

    def claim(self, run_id: str) -> str:
        """The id of the run: that of the pass which was cut off, else the given one."""
        had = fl.read_text(self.spark, f"{self.home}/run.json")
        if had is not None:
            return json.loads(had)["run_id"]
        fl.write_text(self.spark, f"{self.home}/run.json", json.dumps({"run_id": run_id}))
        return run_id

    def batches(self) -> DataFrame | None:
        """(id, score, windows) of the batches that stand, finished ones and one that may be repeated."""
        folders = [f for f in fl.folders(self.spark, f"{self.home}/batches") if fl.exists(self.spark, f"{self.home}/batches/{f}/_SUCCESS")]
        return self.spark.read.schema("id string, score double, windows long").parquet(*[f"{self.home}/batches/{f}" for f in folders]) if folders else None

    def done(self) -> int:
        had = self.batches()
        return had.count() if had is not None else 0

    def score(self, build: str, prepare: Callable[[DataFrame], DataFrame], detector: Detector, files_per_batch: int = 8) -> None:
        """Score the build's documents that no finished batch holds; ``prepare`` makes (id, text) of raw rows.

        A batch overwrites its own folder, so one that was written but not
        logged before a crash is written again, not twice.
        """
        raw = self.spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).parquet(build)

        def write(batch: DataFrame, number: int) -> None:
            score_counted(batch, detector).write.mode("overwrite").parquet(f"{self.home}/batches/{number:06d}")

        query = prepare(raw).select("id", "text").writeStream.foreachBatch(write)
        query.option("checkpointLocation", f"{self.home}/log").trigger(availableNow=True).start().awaitTermination()

    def promote(self, run_id: str, wanted: DataFrame) -> None:
        """Move the scores into the store, whole or not at all; wanted(id) must be what was scored.

        Done already, it does nothing.
        """
        target = f"{self.out}/scores/run_id={run_id}"
        if fl.exists(self.spark, target):
            return
        scores = self.batches()
        if scores is None:
            scores = self.spark.createDataFrame([], "id string, score double, windows long")
        # both sides counted in one shuffle: every id once in either
        both = scores.select("id", F.lit(1).alias("s"), F.lit(0).alias("w")).union(wanted.select("id", F.lit(0), F.lit(1)))
        odd = both.groupBy("id").agg(F.sum("s").alias("s"), F.sum("w").alias("w")).where("s <> w or w <> 1")
        bad = odd.limit(3).collect()
        if bad:
            raise ValueError(f"scores and documents differ: {[tuple(r) for r in bad]}")
        scores.select("id", "score").write.mode("overwrite").parquet(f"{self.home}/whole")
        fl.rename(self.spark, f"{self.home}/whole", target)

    def windows(self) -> int | None:
        had = self.batches()
        return had.agg(F.sum("windows")).first()[0] if had is not None else 0

    def clear(self) -> None:
        fl.remove(self.spark, self.home)
