"""Locked wide snapshots of daily closes: one dated Parquet table, a column for each ticker.

A snapshot is read as it is, never fetched or filled. Changing a column writes a
new table beside the old one and swaps them, so no table is overwritten while it
is read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import nan_to_null


class MissingSnapshot(FileNotFoundError):
    """The locked snapshot, or a ticker's column in it, is not there."""


def ticker_column(ticker: str) -> str:
    return re.sub(r"^\^+", "", ticker)


def snapshot_path(folder: str, day: str) -> str:
    return f"{folder.rstrip('/')}/raw_snapshot_{day}.parquet"


def _filesystem(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _filesystem(spark, path)
    return system.exists(target)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise MissingSnapshot(path)
    return spark.read.parquet(path)


def closes(spark: SparkSession, path: str, ticker: str, start: str | None = None) -> DataFrame:
    """(d, close) of one ticker: days without a quote are left out, times of day are cut off; only its column is read."""
    table, column = read_snapshot(spark, path), ticker_column(ticker)
    if column not in table.columns:
        raise MissingSnapshot(f"{path} has no column {column}")
    rows = table.select(F.to_date("date").alias("d"), nan_to_null(F.col(column).cast("double")).alias("close")).where("close IS NOT NULL")
    return rows.where(F.col("d") >= F.lit(start).cast("date")) if start else rows


def long_closes(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, d, close) of all tickers."""
    table = read_snapshot(spark, path)
    tickers = [c for c in table.columns if c != "date"]
    rows = table.select(F.to_date("date").alias("d"), *[F.col(c).cast("double").alias(c) for c in tickers]).unpivot("d", tickers, "series_id", "close")
    return rows.select("series_id", "d", nan_to_null(F.col("close")).alias("close")).where("close IS NOT NULL")


def with_column(snapshot: DataFrame, ticker: str, fresh: DataFrame) -> DataFrame:
    """The snapshot with a ticker's column replaced by ``fresh`` (d, close), over the union of days."""
    column = ticker_column(ticker)
    days = snapshot.drop(column).withColumn("date", F.to_date("date"))
    return days.join(fresh.select(F.col("d").alias("date"), F.col("close").alias(column)), "date", "full")


def upsert(spark: SparkSession, path: str, ticker: str, fresh: DataFrame) -> None:
    """Write the snapshot with a ticker's new column, then swap it in; an absent snapshot is created.

    The old table is moved aside and goes only when the new one is in place, so
    one of them is there whenever the swap ends early; the next call finds it.
    """
    recover(spark, path)
    system, target = _filesystem(spark, path)
    column = ticker_column(ticker)
    first = fresh.select(F.col("d").alias("date"), F.col("close").alias(column))
    table = with_column(spark.read.parquet(path), ticker, fresh) if system.exists(target) else first
    _, beside = _filesystem(spark, path + ".next")
    _, aside = _filesystem(spark, path + ".old")
    table.write.mode("overwrite").parquet(path + ".next")
    system.delete(aside, True)  # of a swap that ended after its new table was in place
    if system.exists(target) and not system.rename(target, aside):
        raise OSError(f"could not move {path} aside")
    if not system.rename(beside, target):
        system.rename(aside, target)
        raise OSError(f"could not move {path}.next into place")
    system.delete(aside, True)


def recover(spark: SparkSession, path: str) -> None:
    """Put the old table back where a swap ended between its two moves."""
    system, target = _filesystem(spark, path)
    _, aside = _filesystem(spark, path + ".old")
    if not system.exists(target) and system.exists(aside):
        system.rename(aside, target)
