"""Daily bars from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_path


def daily_bars(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(ticker, date, n, high, low, volume) of a stream (or table) of (event_type, ts, value).

    A day is one of the session's time zone. Of a stream it is final once the stream is late beyond its end. Spark
    combines a type's events before the shuffle. Events without a value or a time are left out.
    """
    rows = events.where("value is not null and ts is not null").select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), "value")
    rows = rows.select("ticker", F.date_trunc("day", "ts").alias("day"), "value")
    by = (rows.withWatermark("day", late) if events.isStreaming else rows).groupBy("ticker", "day")
    bars = by.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("high"), F.min("value").alias("low"), F.sum("value").alias("volume"))
    return bars.select("ticker", F.col("day").cast("date").alias("date"), "n", "high", "low", "volume")


def bars_once(spark: SparkSession, path: str) -> DataFrame:
    """The bars of all events of the Parquet table at path, through a stream that reads what is there and ends.

    Days that may still get events when it ends wait in the state, which a next run would go on from; for the whole
    result each batch's bars replace those of the same days, as written to Parquet below the shared folder.
    """
    folder, name = path.rstrip("/").rsplit("/", 1)
    is_file = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").limit(2).collect()
    one = len(is_file) == 1 and is_file[0].path.rsplit("/", 1)[1] == name
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    events = reader.option("pathGlobFilter", name).parquet(folder) if one else reader.parquet(path)
    to = shared_path(spark, "bars")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{to}/bars/batch={number}")

    query = daily_bars(events).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not sum(p.numInputRows for p in query.recentProgress):
        return daily_bars(spark.read.parquet(path))
    bars = spark.read.parquet(f"{to}/bars")
    last = bars.groupBy("ticker", "date").agg(F.max_by(F.struct("n", "high", "low", "volume"), "batch").alias("b"))
    return last.select("ticker", "date", "b.*")
