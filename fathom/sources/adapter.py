"""Prices from the sales tables: a brand is a ticker, its dearest unit price of a day the close, its quantity the volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sales_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, close, volume); Spark chooses between broadcasting part and shuffling it by its size."""
    sales = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    joined = sales.join(part, sales.l_partkey == part.p_partkey)
    return joined.groupBy(F.col("p_brand").alias("ticker"), F.col("l_shipdate").cast("date").alias("date")).agg(
        F.max(F.try_divide("l_extendedprice", "l_quantity")).alias("close"), F.sum("l_quantity").alias("volume")
    )
