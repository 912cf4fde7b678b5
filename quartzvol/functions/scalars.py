"""Losses, units, regimes and small formulas as Spark columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT, EngineConfig


def nan_to_null(c: Column) -> Column:
    """NaN is missing data here; Spark's aggregates skip only NULL."""
    return F.nanvl(c, F.lit(None).cast("double"))


def qlike(realised: Column, forecast: Column) -> Column:
    ratio = realised / forecast
    return ratio - F.ln(ratio) - 1


def squared_error(y: Column, f: Column) -> Column:
    return (y - f) * (y - f)


def direction_match(a: Column, b: Column) -> Column:
    """Equal signs, or either is zero."""
    return (F.signum(a) == F.signum(b)) | (a == 0) | (b == 0)


def index_variance(vix: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """Volatility points squared, as annualised variance in decimals."""
    return vix * vix / cfg.variance_scale


def implied_variance(vix: Column, premium: Column, cfg: EngineConfig = DEFAULT) -> Column:
    return index_variance(vix, cfg) - premium


def vol_points_to_variance(vol: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """Raises on values that are not positive."""
    bad = F.raise_error(F.concat(F.lit("volatility must be positive, got "), vol.cast("string")))
    return F.when(vol <= 0, bad.cast("double")).otherwise(vol / cfg.vol_points * vol / cfg.vol_points)


def regime(vix: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """The middle regime has both cuts inside; a missing level raises."""
    calm, normal, stressed = cfg.regimes
    missing = vix.isNull() | F.isnan(vix)
    return F.when(missing, F.raise_error(F.lit("no regime without a level")).cast("string")).when(vix < cfg.calm_below, calm).when(vix > cfg.stressed_above, stressed).otherwise(normal)


def regime_ordinal(label: Column, cfg: EngineConfig = DEFAULT) -> Column:
    out = None
    for k, name in enumerate(cfg.regimes):
        out = F.when(label == name, k) if out is None else out.when(label == name, k)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown regime "), F.coalesce(label, F.lit("null")))).cast("int"))


def nw_lag(n: Column, cfg: EngineConfig = DEFAULT) -> Column:
    return F.floor(cfg.nw_factor * F.pow(n / F.lit(100.0), F.lit(cfg.nw_exponent))).cast("int")


def block_length(n: int, cfg: EngineConfig = DEFAULT) -> int:
    """At least one; the float cube root is cut, so perfect cubes may fall below their root."""
    return max(1, int(n**cfg.block_exponent))


def weighted_adjustment(realised: Column, small: Column, large: Column, cfg: EngineConfig = DEFAULT) -> Column:
    gap = F.ln(small) - F.ln(large)
    return cfg.cw_scale * realised / small * gap * gap


def corrected_differential(realised: Column, small: Column, large: Column, cfg: EngineConfig = DEFAULT) -> Column:
    return qlike(realised, small) - qlike(realised, large) + weighted_adjustment(realised, small, large, cfg)


def simulated_realised(realised: Column, y_observed: Column, y_simulated: Column) -> Column:
    return realised + (y_observed - y_simulated)


def percent_gain(small: Column, big: Column) -> Column:
    return 100 * (small - big) / small


def adjusted_skew(biased: Column, n: Column) -> Column:
    """The small-sample skewness from the moment one, which is what Spark's ``skewness`` gives."""
    return F.when(n > 2, biased * F.sqrt(n * (n - 1)) / (n - 2))


def series_key(ticker: Column) -> Column:
    """The column of a ticker: leading carets go."""
    return F.regexp_replace(ticker, r"^\^+", "")


def month_key(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d) - 1


def normal_sf_value(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            c = 1.0 + top / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return min(1.0, max(0.0, x))
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided_value(stat: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + stat * stat))


@F.pandas_udf(T.DoubleType())
def normal_sf(x: pd.Series) -> pd.Series:
    return x.map(normal_sf_value, na_action="ignore").astype(float)


@F.pandas_udf(T.DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    from statistics import NormalDist

    return p.map(NormalDist().inv_cdf, na_action="ignore").astype(float)


@F.pandas_udf(T.DoubleType())
def t_two_sided(stat: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_value(s, n) if np.isfinite(s) and n > 0 else np.nan for s, n in zip(stat, df, strict=True)])


def chi2_two_sf(w: Column) -> Column:
    """Upper tail of chi-squared with two degrees of freedom."""
    return F.exp(-w / 2)
