"""Panels of return series from the order tables: readers that prune columns and keep plans short."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vartide.operators import returns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str, kind: str = "a") -> DataFrame:
    """Returns by order priority (a), market segment (b) or nation (c)."""
    orders = table(spark, sf_dir, "orders")
    if kind == "a":
        return returns.log_returns(returns.daily_prices(orders, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice")))
    joined = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    if kind == "b":
        return returns.log_returns(returns.daily_prices(joined, F.col("c_mktsegment"), F.col("o_orderdate"), F.col("o_totalprice")))
    # daily sums by nation key first: the names join the short result
    daily = returns.daily_prices(joined, F.col("c_nationkey"), F.col("o_orderdate"), F.col("o_totalprice")).withColumnRenamed("asset", "n_nationkey")
    named = daily.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return returns.log_returns(named.select(F.col("n_name").alias("asset"), "date", "p"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset, class: nations by region."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nation.select(F.col("n_name").alias("asset"), F.col("r_name").alias("class"))
