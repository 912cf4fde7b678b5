"""The observed pipeline from daily tables to scored forecasts, as lazy tables that share their steps."""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..operators import premium, score, series, walkforward
from ..sources import market as source
from ..sources.scratch import written

#: The tables span seven years, so the first training window is shorter than the default.
CONFIG = replace(DEFAULT, initial_years=3, cv_min_train=24)
MODELS = ("constant", "har", "extended_ols", "regime_switching")


_SHARED: dict[tuple, Market] = {}


def shared_market(spark: SparkSession, sf_dir: str) -> Market:
    """One Market for each session, folder and state of its tables, so a step is written once and not for every query.

    The state is the length and modification time of the tables that the
    snapshot reads; after a change the steps are built anew.
    """
    key = (spark.sparkContext.applicationId, sf_dir, source.state(spark, sf_dir))
    if key not in _SHARED:
        for old in [k for k in _SHARED if k[:2] == key[:2] or k[0] != key[0]]:
            del _SHARED[old]
        _SHARED[key] = Market(spark, sf_dir)
    return _SHARED[key]


class Market:
    """Steps that several later ones read are written to the shared folder once, which keeps later plans short."""

    def __init__(self, spark: SparkSession, sf_dir: str, cfg=CONFIG):
        self.spark, self.dir, self.cfg = spark, sf_dir, cfg

    @cached_property
    def daily(self) -> DataFrame:
        return written(source.snapshot(self.spark, self.dir), "daily")

    @cached_property
    def returns(self) -> DataFrame:
        return series.log_returns(self.daily, scale=source.RETURN_SCALE)

    @cached_property
    def months(self) -> DataFrame:
        return series.month_start(self.returns)

    @cached_property
    def outcomes(self) -> DataFrame:
        return written(score.monthly_outcomes(self.returns, self.cfg), "outcomes")

    @cached_property
    def har(self) -> DataFrame:
        return written(premium.har_forecast(self.returns, self.cfg), "har")

    @cached_property
    def vrp(self) -> DataFrame:
        return premium.premium(self.months.select("series_id", "d", "vix", "skew"), self.har, self.cfg)

    @cached_property
    def features(self) -> DataFrame:
        return premium.features(self.vrp, self.returns, self.cfg)

    @cached_property
    def dataset(self) -> DataFrame:
        return written(premium.model_dataset(self.features, cfg=self.cfg), "dataset")

    @cached_property
    def cut(self) -> DataFrame:
        return premium.train_cut(self.dataset, self.cfg.initial_years)

    def forecasts(self, model: str) -> DataFrame:
        if model == "constant":
            return walkforward.mean_forecasts(self.dataset, self.cut)
        if model == "har":
            return walkforward.linear_forecasts(self.dataset, self.cut, self.cfg.vrp_columns)
        if model == "extended_ols":
            return walkforward.linear_forecasts(self.dataset, self.cut, self.cfg.numeric_features)
        return walkforward.regime_forecasts(self.dataset, self.cut, self.cfg.numeric_features, self.cfg)

    def observed(self, *models: str) -> DataFrame:
        rows = [self.forecasts(m).select("series_id", F.lit(m).alias("model"), "d", "y_true", "y_pred") for m in models or MODELS]
        return score.observations(reduce(DataFrame.unionByName, rows), self.outcomes, self.cfg)

    @cached_property
    def obs(self) -> DataFrame:
        return written(self.observed(), "observations")
