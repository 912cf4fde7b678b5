"""Shared scoring of forecasts: masks, losses, scorecards, diagnostics and regime splits.

Forecasts of all models are one long table (series_id, model, d, y_true, y_pred).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import scalars as S
from . import series as W


def monthly_outcomes(returns: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Per month start: vix, the realised variance after it, and both for the next month's row."""
    months = W.month_start(W.forward_variance(returns, cfg))
    w = W.ordered()
    return months.select("series_id", "d", "vix", "skew", F.col("target").alias("realised"), F.lead("vix", 1).over(w).alias("vix_next"), F.lead("target", 1).over(w).alias("realised_next"))


def observations(forecasts: DataFrame, outcomes: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Per forecast: implied and realised variance a month on, the two masks, QLIKE where valid, and the decision day's regime."""
    out = forecasts.join(outcomes.select("series_id", "d", "vix", "vix_next", "realised_next"), ["series_id", "d"], "left")
    implied = S.implied_variance(F.col("vix_next"), F.col("y_pred"), cfg)
    out = out.withColumns({"implied": implied, "realised": F.col("realised_next"), "regime": S.regime(F.col("vix"), cfg)})
    out = out.withColumns({"guard": F.coalesce(F.col("implied") > 0, F.lit(False)), "tail": F.col("realised").isNotNull()})
    out = out.withColumn("valid", F.col("guard") & F.col("tail"))
    return out.withColumn("qlike", F.when(F.col("valid"), S.qlike(F.col("realised"), F.col("implied")))).select(
        "series_id", "model", "d", "y_true", "y_pred", "implied", "realised", "guard", "tail", "valid", "qlike", "regime"
    )


def scorecard(obs: DataFrame) -> DataFrame:
    """One row a model: QLIKE over valid rows, squared error and direction over all rows, and disjoint exclusion counts."""
    y, f = F.col("y_true"), F.col("y_pred")
    return obs.groupBy("series_id", "model").agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.count_if("valid").alias("n_valid"),
        F.count_if(~F.col("guard")).alias("n_guard_excluded"),
        F.count_if(F.col("guard") & ~F.col("tail")).alias("n_tail_excluded"),
        F.avg("qlike").alias("qlike"),
        F.avg(S.squared_error(y, f)).alias("mse"),
        F.avg(S.direction_match(y, f).cast("double")).alias("directional_accuracy"),
        F.min("d").alias("first_day"),
        F.max("d").alias("last_day"),
    )


def guard_violations(obs: DataFrame) -> DataFrame:
    """Forecasts whose implied variance is not positive."""
    return obs.where(~F.col("guard")).select("series_id", "model", "d", "implied")


def require_positive(obs: DataFrame) -> DataFrame:
    """``obs`` that fails at run time on the first implied variance that is not positive."""
    bad = F.raise_error(F.concat(F.lit("implied variance must be positive at "), F.col("d").cast("string")))
    return obs.withColumn("implied", F.when(F.col("guard"), F.col("implied")).otherwise(bad.cast("double")))


def diagnostics(obs: DataFrame) -> DataFrame:
    """Signed and absolute errors, R squared, over- and under-predictions, and the regime of the worst mean absolute error."""
    error = F.col("y_pred") - F.col("y_true")
    rows = obs.withColumns({"e": error, "a": F.abs(error)})
    main = rows.groupBy("series_id", "model").agg(
        F.avg("e").alias("mean_error"),
        F.avg("a").alias("mae"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        (1 - F.sum(F.col("e") * F.col("e")) / F.nullif(F.var_pop("y_true") * F.count("y_true"), F.lit(0.0))).alias("r2"),
        F.count_if(F.col("e") < 0).alias("n_under"),
        F.count_if(F.col("e") > 0).alias("n_over"),
    )
    by_regime = rows.groupBy("series_id", "model", "regime").agg(F.avg("a").alias("m"))
    rank = Window.partitionBy("series_id", "model").orderBy(F.desc("m"), "regime")
    worst = by_regime.withColumn("k", F.row_number().over(rank)).where("k = 1").select("series_id", "model", F.col("regime").alias("worst_regime"), F.col("m").alias("worst_mae"))
    return main.join(worst, ["series_id", "model"])


def largest_errors(obs: DataFrame, k: int) -> DataFrame:
    """The k largest absolute errors of each model, ties by day."""
    rows = obs.withColumn("abs_error", F.abs(F.col("y_pred") - F.col("y_true")))
    w = Window.partitionBy("series_id", "model").orderBy(F.desc("abs_error"), "d")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("series_id", "model", "place", "d", "regime", "abs_error")


def common_days(obs: DataFrame) -> DataFrame:
    """Days on which every model is valid."""
    return obs.groupBy("series_id", "d").agg(F.min("valid").alias("ok")).where("ok").select("series_id", "d")


def regime_losses(obs: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """QLIKE of each model on commonly valid days, by regime and in all; empty regimes have n 0 and no loss."""
    rows = obs.join(common_days(obs), ["series_id", "d"])
    sums = rows.rollup("series_id", "model", "regime").agg(F.count(F.lit(1)).alias("n"), F.avg("qlike").alias("qlike"), F.grouping_id().alias("g")).where("g <= 1")
    sums = sums.withColumn("regime", F.when(F.col("g") == 1, "all_regimes").otherwise(F.col("regime"))).drop("g")
    labels = F.explode(F.array(*[F.struct(F.lit(name).alias("regime"), F.lit(k).alias("ord")) for k, name in enumerate([*cfg.regimes, "all_regimes"])]))
    wanted = obs.select("series_id", "model").distinct().select("series_id", "model", labels.alias("x")).select("series_id", "model", "x.*")
    return wanted.join(sums, ["series_id", "model", "regime"], "left").select("series_id", "model", "regime", "ord", F.coalesce("n", F.lit(0)).alias("n"), "qlike")


def loss_decomposition(obs: DataFrame) -> DataFrame:
    """By model and regime: count, mean, median, and the share, day and leave-out mean of the largest loss (first day on ties)."""
    rows = obs.where("valid")
    top = F.max_by(F.col("d"), F.struct("qlike", -F.unix_date("d")))
    return rows.groupBy("series_id", "model", "regime").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("qlike").alias("mean_qlike"),
        F.percentile("qlike", F.lit(0.5)).alias("median_qlike"),
        (F.max("qlike") / F.sum("qlike")).alias("max_share"),
        top.alias("max_day"),
        ((F.sum("qlike") - F.max("qlike")) / F.nullif(F.count(F.lit(1)) - 1, F.lit(0))).alias("mean_without_max"),
    )


def loss_ranks(obs: DataFrame) -> DataFrame:
    """Each day's rank among its model's losses, largest first, and its ratio to their mean."""
    w = Window.partitionBy("series_id", "model")
    rows = obs.where("valid")
    return rows.select("series_id", "model", "d", "qlike", F.rank().over(w.orderBy(F.desc("qlike"))).alias("loss_rank"), (F.col("qlike") / F.avg("qlike").over(w)).alias("ratio"))


def top_losses(obs: DataFrame, k: int = 10) -> DataFrame:
    return obs.where("valid").orderBy(F.desc("qlike"), "series_id", "model", "d").limit(k).select("series_id", "model", "d", "qlike")


def spearman(rows: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """Rank correlation with average ranks on ties, by key."""

    def average_rank(c: str):
        order = Window.partitionBy(*keys).orderBy(c)
        return F.rank().over(order) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2.0

    ranked = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns({"ra": average_rank(a), "rb": average_rank(b)})
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("rho"))


def plot_losses(obs: DataFrame) -> DataFrame:
    """The plotted table: per day and model the loss, and whether any model is excluded that day."""
    w = Window.partitionBy("series_id", "d")
    return obs.select("series_id", "d", "model", "qlike", F.max(~F.col("valid")).over(w).alias("excluded"))
