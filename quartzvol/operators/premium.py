"""From daily series to the model-ready monthly table: HAR variance forecasts, premium, features, dataset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import scalars as S
from . import series as W

#: Squared returns are of order 1e-4; moments are kept in these units for conditioning.
UNIT = 1e4


def _determinant(m: list[list[Column]]) -> Column:
    if len(m) == 1:
        return m[0][0]
    terms = [m[0][j] * _determinant([row[:j] + row[j + 1 :] for row in m[1:]]) * (-1) ** j for j in range(len(m))]
    return reduce(lambda a, b: a + b, terms)


def _moment_columns(df: DataFrame, xs: list[str], y: str, w) -> DataFrame:
    """Running centred second moments of regressors and target over a frame, as columns c_i_j and c_i_y, with means."""
    names = [*xs, y]
    sums = {f"s_{a}": F.sum(a).over(w) for a in names}
    sums |= {f"s_{a}_{b}": F.sum(F.col(a) * F.col(b)).over(w) for i, a in enumerate(names) for b in names[i:] if a != y}
    out = df.withColumns(sums | {"s_n": F.count(y).over(w)})
    return out.withColumns({f"c_{a}_{b}": F.col(f"s_{a}_{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("s_n") for i, a in enumerate(names) for b in names[i:] if a != y})


def har_forecast(returns: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``forecast`` of the next window's variance at every month start that can have one.

    The regression at ordinal p uses rows up to p - window, whose targets are
    known by then. Normal equations are running sums over that frame, so one
    pass over the series serves every month; the 3 by 3 system is solved by
    determinants on month starts only.
    """
    days = W.har_regressors(W.forward_variance(returns, cfg), cfg)
    xs = [f"x{k}" for k in range(1, len(cfg.har_days) + 1)]
    usable = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*xs, "target"]])
    scaled = {f"u{k}": F.when(usable, F.col(x) * UNIT) for k, x in enumerate(xs, 1)} | {"uy": F.when(usable, F.col("target") * UNIT)}
    us = [f"u{k}" for k in range(1, len(xs) + 1)]
    w = W.ordered().rowsBetween(Window.unboundedPreceding, -cfg.window)
    months = W.month_start(_moment_columns(days.withColumns(scaled), us, "uy", w))
    a = [[F.col(f"c_{min(i, j)}_{max(i, j)}") for j in us] for i in us]
    rhs = [F.col(f"c_{i}_uy") for i in us]
    whole = _determinant(a)
    betas = [_determinant([row[:k] + [rhs[i]] + row[k + 1 :] for i, row in enumerate(a)]) / F.nullif(whole, F.lit(0.0)) for k in range(len(us))]
    mean = lambda c: F.col(f"s_{c}") / F.col("s_n")
    value = reduce(lambda s, t: s + t, [betas[k] * (F.col(xs[k]) * UNIT - mean(us[k])) for k in range(len(us))], mean("uy")) / UNIT
    ready = (F.col("rn") >= cfg.window) & (F.col("s_n") >= cfg.har_min_rows) & reduce(lambda p, q: p & q, [F.col(x).isNotNull() for x in xs])
    return months.where(ready).withColumn("forecast", value).where("forecast IS NOT NULL").select("series_id", "d", "forecast")


def premium(months: DataFrame, forecast: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``vrp`` at every forecast date: index variance less forecast. ``months`` brings vix and skew."""
    return forecast.join(months, ["series_id", "d"], "left").withColumn("vrp", S.index_variance(F.col("vix"), cfg) - F.col("forecast"))


def features(vrp: DataFrame, returns: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The seven features on the premium's dates; lags are positional on the whole premium series and NULLs stay."""
    w = W.ordered()
    out = vrp.withColumns({c: F.lag("vrp", k - 1).over(w) if k > 1 else F.col("vrp") for c, k in zip(cfg.vrp_columns, cfg.lag_months, strict=True)})
    out = W.as_of(out, W.trailing_skew(returns, cfg), "skew_21d")
    return out.select("series_id", "d", "vrp", F.col("vix").alias("vix_level"), F.col("skew").alias("cboe_skew"), *cfg.vrp_columns, F.col("skew_21d").alias("realised_skew_21d"), S.regime(F.col("vix"), cfg).alias("regime"))


class IncompleteFeatures(ValueError):
    """The dataset lacks columns that a model needs."""


def assert_features(df: DataFrame, expected: tuple[str, ...]) -> None:
    if gone := [c for c in expected if c not in df.columns]:
        raise IncompleteFeatures(f"missing columns: {', '.join(gone)}")


def model_dataset(feature_table: DataFrame, columns: tuple[str, ...] | None = None, target: str = "vrp", horizon: int = 1, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Features, ``y`` (the target ``horizon`` rows ahead) and the ordinal ``row``; the lead comes before the drop of NULLs.

    Only the selected columns decide what is dropped.
    """
    if horizon < 1:
        raise ValueError("the horizon must be at least 1")
    columns = columns or cfg.features
    assert_features(feature_table, (*columns, target))
    led = feature_table.withColumn("y", F.lead(target, horizon).over(W.ordered()))
    kept = led.select("series_id", "d", *columns, "y").dropna(subset=[*columns, "y"])
    return kept.withColumn("row", F.row_number().over(W.ordered()) - 1)


def require_rows(dataset: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Series with fewer rows than the minimum (an action raises on them when asked for)."""
    return dataset.groupBy("series_id").agg(F.count("*").alias("n")).where(F.col("n") < cfg.min_dataset_rows)


def train_cut(dataset: DataFrame, years: int) -> DataFrame:
    """Per series the last day of its first ``years`` calendar years, with that row's ordinal ``cut``."""
    first = Window.partitionBy("series_id")
    inside = dataset.withColumn("__y0", F.min(F.year("d")).over(first)).where(F.year("d") <= F.col("__y0") + years - 1)
    return inside.groupBy("series_id").agg(F.max("d").alias("cut_day"), F.max("row").alias("cut"))


def frame_from_premium(path: DataFrame, exogenous: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """A dataset-shaped table from any premium path (series_id, d, vrp) and the observed other columns."""
    w = W.ordered()
    lagged = path.withColumns({c: F.lag("vrp", k - 1).over(w) if k > 1 else F.col("vrp") for c, k in zip(cfg.vrp_columns, cfg.lag_months, strict=True)} | {"y": F.lead("vrp", 1).over(w)})
    return exogenous.drop(*cfg.vrp_columns, "y", "vrp").join(lagged.drop("vrp"), ["series_id", "d"], "left")


def reconstruction_differences(observed: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows that only one of two datasets has, with the side; empty when the reconstruction is exact."""
    cols = observed.columns
    only = lambda a, b, side: a.select(*cols).exceptAll(b.select(*cols)).withColumn("side", F.lit(side))
    return only(observed, rebuilt, "observed").unionByName(only(rebuilt, observed, "rebuilt"))
