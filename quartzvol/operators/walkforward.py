"""Expanding walk-forward: row i + 1 is predicted by a model fitted on rows 0 to i.

Linear models and the mean have plans of their own. The general engine packs
each series' rows once, deals the steps out as rows, and fits a fresh model for
each step in Arrow batches, so steps of all series run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from . import series as W
from .premium import assert_features

OUT = "series_id string, d date, row int, y_true double, y_pred double"


class Model(Protocol):
    def fit(self, x: pd.DataFrame, y: pd.Series) -> None: ...

    def predict(self, x: pd.DataFrame) -> np.ndarray: ...


def factory(model: type, **settings) -> Callable[[], Model]:
    return lambda: model(**settings)


def check_cut(dataset: DataFrame, cut: DataFrame) -> None:
    """Raises when a series has no cut, or no row is left to predict (an action)."""
    last = dataset.groupBy("series_id").agg(F.max("row").alias("last"))
    bad = last.join(cut, "series_id", "left").where("cut IS NULL OR cut >= last").limit(5).collect()
    if bad:
        raise ValueError(f"no row to predict after the cut in {[r['series_id'] for r in bad]}")


def _test_rows(dataset: DataFrame, cut: DataFrame) -> DataFrame:
    # cut has one small row for each series; the planner broadcasts it while it is small.
    return dataset.join(cut.select("series_id", "cut"), "series_id").where("row > cut").drop("cut")


def mean_forecasts(dataset: DataFrame, cut: DataFrame) -> DataFrame:
    """The expanding mean of y."""
    before = W.ordered(by="row").rowsBetween(Window.unboundedPreceding, -1)
    out = dataset.withColumn("y_pred", F.avg("y").over(before))
    return _test_rows(out, cut).select("series_id", "d", "row", F.col("y").alias("y_true"), "y_pred")


def _solve(gram: np.ndarray, moment: np.ndarray) -> np.ndarray:
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    return np.linalg.lstsq(gram / np.outer(scale, scale), moment / scale, rcond=1e-12)[0] / scale


class RunningOls:
    """Least squares with intercept whose rows arrive one after another; moments are kept about the first row's values."""

    def __init__(self, k: int):
        self.n, self.origin = 0, None
        self.gram, self.moment = np.zeros((k + 1, k + 1)), np.zeros(k + 1)

    def add(self, x: np.ndarray, y: float) -> None:
        if self.origin is None:
            self.origin, self.y0 = x.copy(), y
        z = np.concatenate([[1.0], x - self.origin])
        self.gram += np.outer(z, z)
        self.moment += z * (y - self.y0)
        self.n += 1

    def predict(self, x: np.ndarray) -> float:
        return float(np.concatenate([[1.0], x - self.origin]) @ _solve(self.gram, self.moment)) + self.y0


def linear_forecasts(dataset: DataFrame, cut: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Expanding least squares on ``columns``; one pass over each series, whose rows are months.

    Standardising by the training window's mean and deviation would not change
    these predictions, so none is done.
    """
    assert_features(dataset, columns)
    rows = dataset.join(cut.select("series_id", "cut"), "series_id").select("series_id", "d", "row", "cut", "y", *columns)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        x, y, fit, out = pdf[list(columns)].to_numpy(float), pdf["y"].to_numpy(float), RunningOls(len(columns)), []
        for i in range(len(pdf)):
            out.append(fit.predict(x[i]) if i > pdf["cut"].iloc[0] else np.nan)
            fit.add(x[i], y[i])
        return pdf.assign(y_true=y, y_pred=out).loc[lambda p: p["row"] > p["cut"], ["series_id", "d", "row", "y_true", "y_pred"]]

    return rows.groupBy("series_id").applyInPandas(run, OUT)


def regime_forecasts(dataset: DataFrame, cut: DataFrame, columns: tuple[str, ...], cfg: EngineConfig = DEFAULT) -> DataFrame:
    """One expanding regression for each regime, the pooled one where a regime has too few rows; ``fallback`` says which."""
    assert_features(dataset, (*columns, "regime"))
    rows = dataset.join(cut.select("series_id", "cut"), "series_id").select("series_id", "d", "row", "cut", "y", "regime", *columns)
    least = cfg.regime_multiplier * (len(columns) + 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        x, y, cut_row = pdf[list(columns)].to_numpy(float), pdf["y"].to_numpy(float), pdf["cut"].iloc[0]
        pooled, own, out, fell = RunningOls(len(columns)), {}, [], []
        for i, name in enumerate(pdf["regime"]):
            mine = own.setdefault(name, RunningOls(len(columns)))
            fell.append(mine.n < least)
            out.append((pooled if fell[-1] else mine).predict(x[i]) if i > cut_row else np.nan)
            pooled.add(x[i], y[i])
            mine.add(x[i], y[i])
        keep = pdf.assign(y_true=y, y_pred=out, fallback=fell)
        return keep.loc[keep["row"] > keep["cut"], ["series_id", "d", "row", "y_true", "y_pred", "regime", "fallback"]]

    return rows.groupBy("series_id").applyInPandas(run, OUT + ", regime string, fallback boolean")


def regime_fallbacks(dataset: DataFrame, cut: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """For every step: how many earlier rows share its regime, and whether that falls short."""
    before = W.ordered("series_id", "regime", by="row").rowsBetween(Window.unboundedPreceding, -1)
    out = dataset.withColumn("n_regime", F.count(F.lit(1)).over(before))
    return _test_rows(out, cut).select("series_id", "d", "regime", "n_regime", (F.col("n_regime") < cfg.regime_min_rows).alias("fallback"))


def walk_forward(dataset: DataFrame, cut: DataFrame, columns: tuple[str, ...], make_model: Callable[[], Model]) -> DataFrame:
    """The general engine: a fresh model of ``make_model`` for every step.

    A series' rows travel once, packed; a step is a row that names its series
    and its test row, so a step's task needs its own series only. Series are
    months long here, which bounds a pack.
    """
    assert_features(dataset, columns)
    fields = ["row", "d", "y", *columns]
    packs = dataset.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("pack"))
    steps = packs.join(cut.select("series_id", "cut"), "series_id")
    steps = steps.withColumn("step", F.explode(F.when(F.col("cut") + 1 < F.size("pack"), F.sequence(F.col("cut") + 1, F.size("pack") - 1))))
    parts = int(dataset.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for series, pack, step in zip(batch["series_id"], batch["pack"], batch["step"], strict=True):
                frame = pd.DataFrame(list(pack), columns=fields)
                model = make_model()
                model.fit(frame[list(columns)].iloc[:step], frame["y"].iloc[:step])
                value = float(np.asarray(model.predict(frame[list(columns)].iloc[step : step + 1]))[0])
                out.append((series, frame["d"].iloc[step], int(frame["row"].iloc[step]), float(frame["y"].iloc[step]), value))
            yield pd.DataFrame(out, columns=["series_id", "d", "row", "y_true", "y_pred"])

    return steps.select("series_id", "pack", "step").repartition(parts, "series_id", "step").mapInPandas(run, OUT)


class ConstantMean:
    def fit(self, x: pd.DataFrame, y: pd.Series) -> None:
        self.mean = float(y.mean())

    def predict(self, x: pd.DataFrame) -> np.ndarray:
        return np.full(len(x), self.mean)


class LinearModel:
    """Least squares with intercept for the general engine."""

    def fit(self, x: pd.DataFrame, y: pd.Series) -> None:
        self.fitted = RunningOls(x.shape[1])
        for row, value in zip(x.to_numpy(float), y.to_numpy(float), strict=True):
            self.fitted.add(row, value)

    def predict(self, x: pd.DataFrame) -> np.ndarray:
        return np.array([self.fitted.predict(row) for row in x.to_numpy(float)])


def cv_folds(n_rows: int, min_train: int, folds: int) -> list[tuple[int, int, int]]:
    """(fold, train stop, validation stop) of expanding folds with even cuts; the last row is never validated, empty folds go."""
    cuts = np.linspace(min_train, n_rows - 1, folds + 1).astype(int)
    return [(k, int(a), int(b)) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
