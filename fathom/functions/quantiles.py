"""Exact quantiles of groups of any size, by selection: no task holds a group's values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written

BINS = 256


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(*keys, n, q): n values that aren't null and an array of their quantiles, between neighbours by their distance.

    A quantile lies at one or two ranks. A round counts a group's values in BINS equal parts between the bounds of each
    rank, and the smallest and largest value of the part that holds the rank are its next bounds, until they are equal.
    The ends lie in different parts, so bounds always close in. What is shuffled is a row for each part, rank and task.
    """
    spark, keys = rows.sparkSession, list(keys)
    values = written(spark, rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("x")), "values")
    sizes = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    ranks = F.array(*[F.struct(F.lit(i).alias("share"), f(p).cast("long").alias("rank")) for i, p in enumerate(at) for f in (F.floor, F.ceil)])
    wanted = sizes.select(*keys, "n", "lo", "hi", F.explode(F.array_distinct(ranks)).alias("w")).select(*keys, "n", "w.share", "w.rank", "lo", "hi", F.lit(0).cast("long").alias("below"))
    wanted = written(spark, wanted, "ranks")
    target = [*keys, "share", "rank"]
    before = Window.partitionBy(*target).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows
    while wanted.where("lo < hi").take(1):
        open_ = wanted.where("lo < hi").withColumnsRenamed({"n": "size"})
        inside = values.join(open_, keys).where("x >= lo and x <= hi")
        x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
        half = (x / 2 - lo / 2) / (hi / 2 - lo / 2)  # the difference of large numbers is infinite, half of the least ones nothing
        part = F.least(F.floor(F.when(hi - lo == float("inf"), half).otherwise((x - lo) / (hi - lo)) * BINS), F.lit(BINS - 1)).cast("int")
        parts = inside.groupBy(*target, "size", "below", part.alias("part")).agg(F.count(F.lit(1)).alias("here"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        summed = parts.withColumn("below", F.col("below") + F.coalesce(F.sum("here").over(before), F.lit(0)))
        chosen = summed.where("below <= rank and rank < below + here").select(*keys, F.col("size").alias("n"), "share", "rank", "lo", "hi", "below")
        wanted = written(spark, wanted.where("lo >= hi").unionByName(chosen), "ranks")
    low, high = F.min_by("lo", "rank"), F.max_by("lo", "rank")
    weight = F.get(F.array(*at), F.col("share")) - F.min("rank")
    each = wanted.groupBy(*keys, "n", "share").agg((low + (high - low) * weight).alias("q"))
    return each.groupBy(*keys, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("share", "q"))), lambda s: s.q).alias("q"))
