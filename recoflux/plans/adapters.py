"""The test tables as ratings and items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, item_id, rating, ts, k1, k2 of line items: k1, k2 make the order total."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), (F.ceil(F.col("l_quantity") / 5) * 0.5).cast("double").alias("rating"), F.col("l_shipdate").alias("ts"), F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("director"), F.col("p_type").alias("genres"), F.split("p_name", " ").alias("cast"), F.col("p_size").alias("year"), F.col("p_retailprice").alias("runtime"), F.col("p_retailprice").alias("rating"))
