"""Daily market tables out of the order tables, one series for each market segment.

The tables hold no prices, so their daily averages stand in: a day's mean order
price is the close, and the first line item shipped that day (in a total order)
gives an index level of realistic size. Sums are kept in whole cents, so no
average depends on the order of its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshots import _filesystem

#: Scale that brings returns to the size of a stock index's.
RETURN_SCALE = 0.02


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def state(spark: SparkSession, sf_dir: str) -> tuple:
    """Length and modification time of each table that ``snapshot`` reads; None where it is missing."""
    found = []
    for name in ("customer", "orders", "lineitem"):
        system, target = _filesystem(spark, f"{sf_dir}/{name}.parquet")
        status = system.getFileStatus(target) if system.exists(target) else None
        found.append(status and (status.getLen(), status.getModificationTime()))
    return tuple(found)


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, d, close, vix, skew) on days that have all three."""
    segments = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("series_id"))
    orders = _table(spark, sf_dir, "orders").join(segments, "o_custkey")
    cents = lambda c, unit: F.sum(F.round(F.col(c) * 100).cast("long")).cast("double") / (F.count(F.lit(1)) * unit)
    prices = orders.groupBy("series_id", F.to_date("o_orderdate").alias("d")).agg(cents("o_totalprice", 100.0).alias("close"))
    items = _table(spark, sf_dir, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "series_id"), "l_orderkey")
    first = F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))["l_quantity"]
    levels = items.groupBy("series_id", F.to_date("l_shipdate").alias("d")).agg((10 + 0.5 * first).alias("vix"), (100 + 10.0 * (cents("l_discount", 1.0))).alias("skew"))
    return prices.join(levels, ["series_id", "d"])
