"""Time-series operators. Rows are keyed by ``series_id`` and ordered by ``d``; all shifts are positional."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import scalars as S

KEY, TIME = "series_id", "d"


def ordered(*keys: str, by: str = TIME):
    return Window.partitionBy(*(keys or (KEY,))).orderBy(by)


def full_frame(value: Column, w, size: int) -> Column:
    """A frame's value only where the frame is complete."""
    return F.when(F.count(F.lit(1)).over(w) == size, value)


def validate_series(df: DataFrame, value: str) -> DataFrame:
    """Per series: rows, missing values and repeated dates; a clean series has only rows."""
    return df.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col(value).isNull() | F.isnan(value)).cast("long")).alias("n_missing"),
        (F.count(F.lit(1)) - F.countDistinct(TIME)).alias("n_repeated"),
    )


def log_returns(prices: DataFrame, price: str = "close", scale: float = 1.0) -> DataFrame:
    """``r`` on every day but the first, with its ordinal ``rn`` from 0."""
    w = ordered()
    out = prices.withColumn("r", scale * F.ln(F.col(price) / F.lag(price).over(w))).where("r IS NOT NULL")
    return out.withColumn("rn", F.row_number().over(w) - 1)


def realised_vol(returns: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Trailing sample volatility in points; incomplete windows go."""
    w = ordered().rowsBetween(1 - cfg.window, 0)
    vol = full_frame(F.stddev_samp("r").over(w) * F.sqrt(F.lit(float(cfg.annualisation))) * cfg.vol_points, w, cfg.window)
    return returns.withColumn("vol", vol).where("vol IS NOT NULL")


def forward_variance(returns: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``target``: annualised mean square of the next window's returns; NULL where it is incomplete."""
    w = ordered().rowsBetween(1, cfg.window)
    return returns.withColumn("target", full_frame(F.avg(F.col("r") * F.col("r")).over(w) * cfg.annualisation, w, cfg.window))


def har_regressors(returns: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``x1, x2, x3``: trailing mean squares over the configured day counts."""
    out = returns
    for k, days in enumerate(cfg.har_days, 1):
        w = ordered().rowsBetween(1 - days, 0)
        out = out.withColumn(f"x{k}", full_frame(F.avg(F.col("r") * F.col("r")).over(w), w, days))
    return out


def month_start(daily: DataFrame) -> DataFrame:
    """The first row of each calendar month, whether or not its values are missing."""
    w = Window.partitionBy(KEY, S.month_key(F.col(TIME))).orderBy(TIME)
    return daily.withColumn("__first", F.row_number().over(w)).where("__first = 1").drop("__first")


def trailing_skew(returns: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``skew_21d``: adjusted skewness of the window that ends on each day."""
    w = ordered().rowsBetween(1 - cfg.window, 0)
    n = F.lit(cfg.window)
    return returns.withColumn("skew_21d", full_frame(S.adjusted_skew(F.skewness("r").over(w), n), w, cfg.window))


def as_of(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """For each (series, day) of ``left`` the last non-null ``value`` of ``right`` on or before it.

    Both sides are merged and carried forward within a series: one shuffle on
    the key, no range join.
    """
    marks = right.where(F.col(value).isNotNull()).select(KEY, TIME, F.col(value), F.lit(0).alias("__side"))
    asks = left.select(KEY, TIME, F.lit(None).cast("double").alias(value), F.lit(1).alias("__side"))
    w = Window.partitionBy(KEY).orderBy(TIME, "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = marks.unionByName(asks).withColumn("__found", F.last(value, ignorenulls=True).over(w)).where("__side = 1")
    return left.join(found.select(KEY, TIME, F.col("__found").alias(value)).distinct(), [KEY, TIME], "left")


def expanding_median(df: DataFrame, value: str, out: str) -> DataFrame:
    """Median of all rows up to and including the current one."""
    return df.withColumn(out, F.percentile(value, F.lit(0.5)).over(ordered().rowsBetween(Window.unboundedPreceding, 0)))


def transitions(position: str, w) -> Column:
    """Whether a position differs from the row before; before the first row it is flat."""
    return F.col(position) != F.lag(position, 1, 0).over(w)


def drawdown(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """``cumulative`` and ``underwater`` (the running maximum starts at the first cumulative value)."""
    w = ordered(*keys).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("cumulative", F.sum(value).over(w))
    return out.withColumn("underwater", F.max("cumulative").over(w) - F.col("cumulative"))


def block_starts(coins: DataFrame) -> DataFrame:
    """Start of the block that each place belongs to, from (series_id, pos, coin): a running maximum."""
    w = ordered(by="pos").rowsBetween(Window.unboundedPreceding, 0)
    return coins.withColumn("block_start", F.max(F.when(F.col("coin"), F.col("pos")).otherwise(0)).over(w))
