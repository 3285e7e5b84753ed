"""Tables that a query uses several times, written to the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path below spark.checkpoint.dir; in a local session without one (tests) below the warehouse. On a cluster no folder of one machine would do."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not told and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(told or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet and read back: what it is made from is read once, and a lost executor costs nothing."""
    path = shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
