"""Exact quantiles of many groups in bounded memory.

A mergeable sketch brackets every wanted rank; what lies below a bracket is
counted and what lies inside is sketched again, until few values are left.
Then one pass counts these values, and the two neighbours of a rank are read
off for the interpolation.  No task holds the values of a group.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of a sketch: an error of this part of the values, either way.
ACCURACY = 2000
#: Values of a bracket that are counted one by one.
FEW = 10_000


def quantiles(rows: DataFrame, value: str, shares: Iterable[float], by: str | None = None) -> DataFrame:
    """(by, p, quantile) of rows(value[, by]): the value at place (n - 1) * p, interpolated between its neighbours.

    Null values are left out; a group without values has null; a null group is a group.
    """
    shares = sorted(shares)
    group = F.struct(F.col(by).alias("by")) if by else F.struct(F.lit(0).alias("by"))
    own = rows.select(group.alias("g"), F.col(value).cast("double").alias("v"))
    place = (F.col("n") - 1) * F.col("p")
    wanted = own.groupBy("g").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = wanted.withColumn("p", F.explode(F.array(*map(F.lit, shares))))
    wanted = wanted.select("g", "p", "lo", "hi", "n", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), (F.floor(place) + 1).alias("k"), (place - F.floor(place)).alias("rest"))
    while wanted.where((F.col("inside") > FEW) & (F.col("lo") < F.col("hi"))).limit(1).count():
        # two errors of the sketch on either side of the rank, which then lies inside whatever the sketch holds
        near = own.join(wanted, "g").where(F.col("v").between(F.col("lo"), F.col("hi")))
        sketch = F.percentile_approx("v", F.array(*[F.lit(i / 1000) for i in range(1001)]), F.lit(ACCURACY))
        marks = near.groupBy("g", "p").agg(sketch.alias("q"))
        at = (F.col("k") - F.col("below")) / F.nullif("inside", F.lit(0)) * 1000
        low = F.when(at >= 4, F.get("q", (F.floor(at) - 3).cast("int"))).otherwise(F.col("lo"))
        high = F.when(at <= 995, F.get("q", (F.ceil(at) + 4).cast("int"))).otherwise(F.col("hi"))
        tight = wanted.join(marks, ["g", "p"], "left").select(*wanted.columns, low.alias("a"), high.alias("b"))
        # counts of the narrower bracket; one that would miss the rank or its neighbour stays as it was
        again = own.join(tight.where("inside > 0"), "g").groupBy("g", "p").agg(F.count_if(F.col("v") < F.col("a")).alias("under"), F.count_if(F.col("v").between(F.col("a"), F.col("b"))).alias("within"))
        both = tight.join(again, ["g", "p"], "left")
        good = (F.col("under") < F.col("k")) & (F.least(F.col("k") + 1, F.col("n")) <= F.col("under") + F.col("within")) & (F.col("within") < F.col("inside"))
        pick = lambda new, old: F.when(good, F.col(new)).otherwise(F.col(old)).alias(old)
        before = wanted.agg(F.sum("inside")).first()[0]
        wanted = both.select("g", "p", pick("a", "lo"), pick("b", "hi"), "n", pick("under", "below"), pick("within", "inside"), "k", "rest")
        wanted = wanted.sparkSession.createDataFrame(wanted.collect(), wanted.schema) if wanted.count() <= 100_000 else wanted.checkpoint()
        if wanted.agg(F.sum("inside")).first()[0] == before:
            break  # what is left is one value with many copies beside few others
    each = own.join(wanted, "g").where(F.col("v").between(F.col("lo"), F.col("hi"))).groupBy("g", "p", "k", "below", "rest", "v").agg(F.count("*").alias("c"))
    upto = F.col("below") + F.sum("c").over(Window.partitionBy("g", "p").orderBy("v"))
    each = each.withColumn("upto", upto)
    first = F.min(F.when(F.col("upto") >= F.col("k"), F.col("v")))
    then = F.min(F.when(F.col("upto") >= F.col("k") + 1, F.col("v")))
    got = each.groupBy("g", "p", "rest").agg(first.alias("x"), F.coalesce(then, first).alias("y"))
    out = wanted.select("g", "p").join(got, ["g", "p"], "left").select("g.by", "p", (F.col("x") + (F.col("y") - F.col("x")) * F.col("rest")).alias("quantile"))
    return out.withColumnRenamed("by", by) if by else out.drop("by")
