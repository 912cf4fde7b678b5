"""A gated short-variance rule: positions, costs, profit and loss, episodes and tail metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import scalars as S
from . import series as W
from .align import in_windows, window_rows

STRATEGIES = ("naive", "conditioned")
COSTS = ("base", "stress")


def positions(forecasts: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """From (series_id, d, forecast, regime): naive when above its expanding median, conditioned when also not stressed."""
    out = W.expanding_median(forecasts, "forecast", "median")
    naive = (F.col("forecast") > F.col("median")).cast("int")
    stressed = cfg.regimes[-1]
    return out.withColumns({"position_naive": naive, "position_conditioned": naive * (F.col("regime") != stressed).cast("int")}).drop("median")


def profit_and_loss(pos: DataFrame, outcomes: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Gross and net results; changes of position are charged at their month's strike, before months without outcome go."""
    rows = pos.join(outcomes.select("series_id", "d", "vix", "realised"), ["series_id", "d"], "left")
    rows = rows.withColumn("strike", S.index_variance(F.col("vix"), cfg))
    w = W.ordered()
    for name in STRATEGIES:
        p = f"position_{name}"
        gross = F.col(p) * (F.col("strike") - F.col("realised"))
        change = W.transitions(p, w).cast("int")
        rows = rows.withColumns({f"gross_{name}": gross} | {f"net_{name}_{c}": gross - change * F.col("strike") * (cfg.cost_rate * (1.0 if c == "base" else cfg.stress_factor)) for c in COSTS})
    return rows.where("realised IS NOT NULL")


def long_net(pnl: DataFrame) -> DataFrame:
    """(series_id, d, strategy, cost, position, net), a row for each strategy and cost."""
    arms = F.array(*[F.struct(F.lit(s).alias("strategy"), F.lit(c).alias("cost"), F.col(f"position_{s}").alias("position"), F.col(f"net_{s}_{c}").alias("net")) for s in STRATEGIES for c in COSTS])
    return pnl.select("series_id", "d", F.explode(arms).alias("a")).select("series_id", "d", "a.*")


def sharpe(mean, deviation, cfg: EngineConfig = DEFAULT):
    return F.sqrt(F.lit(float(cfg.months_per_year))) * mean / F.nullif(deviation, F.lit(0.0))


def tail_metrics(pnl: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    keys = ["series_id", "strategy", "cost"]
    rows = W.drawdown(long_net(pnl), "net", *keys)
    w = W.ordered(*keys).rowsBetween(1 - cfg.worst_months, 0)
    rows = rows.withColumn("rolling", W.full_frame(F.sum("net").over(w), w, cfg.worst_months))
    n = F.count(F.lit(1))
    held = F.col("position") == 1
    return rows.groupBy(*keys).agg(
        n.alias("n_months"),
        F.sum("position").alias("n_held"),
        F.sum("net").alias("total_net"),
        (F.avg("net") * cfg.months_per_year).alias("annual_mean"),
        (F.stddev_samp("net") * F.sqrt(F.lit(float(cfg.months_per_year)))).alias("annual_vol"),
        sharpe(F.avg("net"), F.stddev_samp("net"), cfg).alias("sharpe"),
        S.adjusted_skew(F.skewness("net"), n).alias("skew"),
        F.min("net").alias("worst_month"),
        F.min("rolling").alias("worst_rolling"),
        F.max("underwater").alias("max_drawdown"),
        F.avg(F.when(held, (F.col("net") > 0).cast("double"))).alias("hit_rate"),
    )


def episodes(pnl: DataFrame, windows: tuple, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Net results in named windows (label, start, stop), then in each spike month outside all of them; flat is 0."""
    nets = [f"net_{s}_{c}" for s in STRATEGIES for c in COSTS]
    inside = in_windows(pnl, windows)
    sums = inside.groupBy("series_id", "label").agg(F.count(F.lit(1)).alias("n_months"), *[F.sum(c).alias(c) for c in nets])
    named = pnl.select("series_id").distinct().select("series_id", F.explode(window_rows(windows)).alias("w")).select("series_id", "w.label", "w.start").join(sums, ["series_id", "label"], "left")
    named = named.select("series_id", "label", F.col("start").alias("from_day"), F.coalesce("n_months", F.lit(0)).alias("n_months"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in nets])
    spikes = pnl.where(F.col("vix") > cfg.spike_level).join(inside.select("series_id", "d").distinct(), ["series_id", "d"], "left_anti")
    single = spikes.select("series_id", F.concat(F.lit("spike "), F.date_format("d", "yyyy-MM")).alias("label"), F.col("d").alias("from_day"), F.lit(1).alias("n_months"), *nets)
    return named.unionByName(single).withColumn("flat_net", F.lit(0.0))


def totals(pnl: DataFrame) -> DataFrame:
    w = W.ordered("series_id", "strategy", "cost")
    rows = long_net(pnl).withColumn("moved", W.transitions("position", w).cast("int"))
    return rows.groupBy("series_id", "strategy", "cost").agg(F.sum("net").alias("total_net"), F.sum("position").alias("n_held"), F.sum("moved").alias("n_moves"))


def sharpe_jackknife(pnl: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Pseudo-values of the Sharpe ratio difference (conditioned less naive), per cost; each leave-one-out ratio from totals."""
    rows = pnl.select("series_id", "d", F.explode(F.array(*[F.struct(F.lit(c).alias("cost"), F.col(f"net_conditioned_{c}").alias("a"), F.col(f"net_naive_{c}").alias("b")) for c in COSTS])).alias("x")).select("series_id", "d", "x.*")
    w = Window.partitionBy("series_id", "cost")
    n = F.count(F.lit(1)).over(w)
    year = F.sqrt(F.lit(float(cfg.months_per_year)))

    def ratio(total, square, count):
        spread = (square - total * total / count) / (count - 1)
        return F.when(spread > 0, year * (total / count) / F.sqrt(spread))

    def both(c: str):
        v, s, q = F.col(c), F.sum(c).over(w), F.sum(F.col(c) * F.col(c)).over(w)
        return ratio(s, q, n), ratio(s - v, q - v * v, n - 1)

    (fa, la), (fb, lb) = both("a"), both("b")
    out = rows.withColumns({"n": n, "full": fa - fb, "loo": la - lb})
    return out.where("n > 2").withColumn("pseudo", F.col("n") * F.col("full") - (F.col("n") - 1) * F.col("loo")).select("series_id", "cost", "d", "n", "full", "loo", "pseudo")
