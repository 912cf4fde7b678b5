"""Squared-loss gradient boosting on small monthly tables, with exact tree attributions and a tuned grid."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from .align import grid
from .walkforward import cv_folds

REGULAR = 1.0
#: What a grid point sets.
POINT = ("depth", "rate", "trees", "min_child")


class Tree:
    """Nodes as arrays: feature (-1 at leaves), threshold, left child (right is next), value and rows."""

    def __init__(self, x: np.ndarray, g: np.ndarray, depth: int, least: int):
        self.feature, self.cut, self.left, self.value, self.rows = [], [], [], [], []
        self._new(g)
        queue = [(0, np.arange(len(g)), depth)]
        while queue:
            node, rows, levels = queue.pop()
            best = self._split(x[rows], g[rows], least) if levels else None
            if best is None:
                continue
            j, cut = best
            goes = x[rows, j] < cut
            self.feature[node], self.cut[node], self.left[node] = j, cut, len(self.feature)
            for part in (rows[goes], rows[~goes]):
                self._new(g[part])
                queue.append((len(self.feature) - 1, part, levels - 1))

    def _new(self, g: np.ndarray) -> None:
        self.feature.append(-1)
        self.cut.append(0.0)
        self.left.append(-1)
        self.value.append(g.sum() / (len(g) + REGULAR))
        self.rows.append(len(g))

    @staticmethod
    def _split(x: np.ndarray, g: np.ndarray, least: int) -> tuple[int, float] | None:
        n, total = len(g), g.sum()
        if n < 2 * least or n < 2:
            return None
        order = np.argsort(x, axis=0, kind="stable")
        sorted_x, left = np.take_along_axis(x, order, 0), np.cumsum(g[order], axis=0)[:-1]
        k = np.arange(1, n)[:, None]
        gain = left**2 / (k + REGULAR) + (total - left) ** 2 / (n - k + REGULAR) - total**2 / (n + REGULAR)
        ok = (sorted_x[1:] > sorted_x[:-1]) & (k >= least) & (n - k >= least)
        gain = np.where(ok, gain, -np.inf)
        at = np.unravel_index(np.argmax(gain), gain.shape)
        if gain[at] <= 1e-16:
            return None
        return int(at[1]), float((sorted_x[at] + sorted_x[at[0] + 1, at[1]]) / 2)

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=int)
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        while (inner := feature[node] >= 0).any():
            rows = np.flatnonzero(inner)
            at = node[rows]
            node[rows] = left[at] + (x[rows, feature[at]] >= cut[at])
        return np.array(self.value)[node]

    def expectation(self, row: np.ndarray, known: frozenset[int], node: int = 0) -> float:
        """Mean value when only some features are known; unknown splits are weighed by their training rows."""
        j, a = self.feature[node], self.left[node]
        if j < 0:
            return self.value[node]
        if j in known:
            return self.expectation(row, known, a + (row[j] >= self.cut[node]))
        weights = self.rows[a], self.rows[a + 1]
        return sum(w * self.expectation(row, known, a + k) for k, w in enumerate(weights)) / sum(weights)

    def attributions(self, row: np.ndarray, k: int) -> tuple[float, np.ndarray]:
        """(expected value, Shapley value of each feature), by all subsets of the features that the tree uses."""
        used = sorted({j for j in self.feature if j >= 0})
        value = {frozenset(s): self.expectation(row, frozenset(s)) for n in range(len(used) + 1) for s in combinations(used, n)}
        out, m = np.zeros(k), len(used)
        for s, v in value.items():
            for j in used:
                if j not in s:
                    out[j] += factorial(len(s)) * factorial(m - len(s) - 1) / factorial(m) * (value[s | {j}] - v)
        return value[frozenset()], out


class Boosted:
    """Model for the walk-forward engine; features are numeric, the regime as its ordinal."""

    def __init__(self, depth: int = 3, rate: float = 0.05, trees: int = 100, min_child: int = 1):
        self.depth, self.rate, self.n_trees, self.min_child = depth, rate, trees, min_child

    @staticmethod
    def encode(x: pd.DataFrame, cfg: EngineConfig = DEFAULT) -> np.ndarray:
        out = x.copy()
        if "regime" in out:
            known = {name: k for k, name in enumerate(cfg.regimes)}
            if bad := set(out["regime"]) - set(known):
                raise ValueError(f"unknown regimes {sorted(map(str, bad))}")
            out["regime"] = out["regime"].map(known)
        return out.to_numpy(float)

    def fit(self, x: pd.DataFrame, y: pd.Series) -> None:
        z, target = self.encode(x), y.to_numpy(float)
        self.base, self.trees = target.mean(), []
        seen = np.full(len(target), self.base)
        for _ in range(self.n_trees):
            tree = Tree(z, target - seen, self.depth, self.min_child)
            seen += self.rate * tree.predict(z)
            self.trees.append(tree)

    def predict(self, x: pd.DataFrame) -> np.ndarray:
        z = self.encode(x)
        return self.base + self.rate * sum((t.predict(z) for t in self.trees), np.zeros(len(z)))

    def attributions(self, x: pd.DataFrame) -> tuple[float, np.ndarray]:
        """(base, one value for each feature) of one row; they add up to its prediction."""
        row = self.encode(x)[0]
        base, out = self.base, np.zeros(len(row))
        for tree in self.trees:
            level, part = tree.attributions(row, len(row))
            base, out = base + self.rate * level, out + self.rate * part
        return base, out


def attributed_forecasts(dataset: DataFrame, cut: DataFrame, columns: tuple[str, ...], settings: dict | DataFrame) -> DataFrame:
    """Walk-forward of the boosted model with each step's attributions: y_true, y_pred, base and shap_<feature>.

    ``settings`` are one point for all series, or a point for each series_id
    (from ``best_points``); a series without one keeps the model's defaults.
    """
    fields = ["row", "d", "y", *columns]
    packs = dataset.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("pack"))
    steps = packs.join(cut.select("series_id", "cut"), "series_id")
    steps = steps.withColumn("step", F.explode(F.when(F.col("cut") + 1 < F.size("pack"), F.sequence(F.col("cut") + 1, F.size("pack") - 1))))
    if isinstance(settings, DataFrame):
        steps = steps.join(settings.select("series_id", F.to_json(F.struct(*POINT)).alias("point")), "series_id", "left")
    else:
        steps = steps.withColumn("point", F.lit(json.dumps(settings)))
    parts = int(dataset.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["series_id", "d", "row", "y_true", "y_pred", "base", *[f"shap_{c}" for c in columns]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for series, pack, step, point in zip(batch["series_id"], batch["pack"], batch["step"], batch["point"], strict=True):
                frame = pd.DataFrame(list(pack), columns=fields)
                model, now = Boosted(**json.loads(point or "{}")), frame.iloc[step : step + 1]
                model.fit(frame[list(columns)].iloc[:step], frame["y"].iloc[:step])
                base, shap = model.attributions(now[list(columns)])
                out.append((series, now["d"].iloc[0], int(now["row"].iloc[0]), float(now["y"].iloc[0]), float(model.predict(now[list(columns)])[0]), base, *shap))
            yield pd.DataFrame(out, columns=names)

    schema = "series_id string, d date, row int, y_true double, y_pred double, base double, " + ", ".join(f"shap_{c} double" for c in columns)
    return steps.select("series_id", "pack", "step", "point").repartition(parts, "series_id", "step").mapInPandas(run, schema)


def mean_attributions(shap: DataFrame, regimes: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(series_id, feature, regime, importance): mean absolute attributions by regime and in all; absent regimes have no row."""
    rows = shap.join(regimes.select("series_id", "d", "regime"), ["series_id", "d"])
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.abs(f"shap_{c}").alias("a")) for c in columns])
    long = rows.select("series_id", "regime", F.explode(each).alias("x"))
    long = long.select("series_id", F.explode(F.array("regime", F.lit("all"))).alias("regime"), "x.feature", "x.a")
    return long.groupBy("series_id", "feature", "regime").agg(F.avg("a").alias("importance"))


def importance_ranks(table: DataFrame) -> DataFrame:
    """Rank of each feature in its regime, largest first, and whether its rank changes between regimes (the total aside)."""
    w = Window.partitionBy("series_id", "regime").orderBy(F.desc("importance"))
    ranked = table.withColumn("place", F.rank().over(w))
    moves = ranked.where("regime != 'all'").groupBy("series_id", "feature").agg((F.countDistinct("place") > 1).alias("rank_changes"))
    return ranked.join(moves, ["series_id", "feature"], "left")


def default_grid(cfg: EngineConfig = DEFAULT) -> list[dict]:
    return grid(depth=list(cfg.grid_depth), rate=list(cfg.grid_rate), trees=list(cfg.grid_trees), min_child=list(cfg.grid_min_child))


def tune(dataset: DataFrame, outcomes: DataFrame, columns: tuple[str, ...], points: list[dict], cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Mean validation QLIKE of every grid point over expanding folds with a valid month; best first.

    ``dataset`` ends at the training boundary and brings no later row, so
    nothing after it is seen. Points and folds run in parallel.
    """
    rows = dataset.join(outcomes.select("series_id", "d", "vix_next", "realised_next"), ["series_id", "d"], "left")
    fields = ["row", "d", "y", "vix_next", "realised_next", *columns]
    packs = rows.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("pack"))
    work = packs.select("series_id", "pack", F.explode(F.array(*[F.lit(p["grid_idx"]) for p in points])).alias("grid_idx"))
    work = work.select("*", F.explode(F.array(*[F.lit(k) for k in range(cfg.cv_folds)])).alias("fold"))
    parts = int(dataset.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_index = {p["grid_idx"]: {k: v for k, v in p.items() if k != "grid_idx"} for p in points}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for series, pack, index, fold in zip(batch["series_id"], batch["pack"], batch["grid_idx"], batch["fold"], strict=True):
                frame = pd.DataFrame(list(pack), columns=fields)
                cuts = {k: (a, b) for k, a, b in cv_folds(len(frame), cfg.cv_min_train, cfg.cv_folds)} if len(frame) > cfg.cv_min_train else {}
                if fold not in cuts:
                    continue
                a, b = cuts[fold]
                model = Boosted(**by_index[index])
                model.fit(frame[list(columns)].iloc[:a], frame["y"].iloc[:a])
                implied = frame["vix_next"].iloc[a:b] ** 2 / cfg.variance_scale - model.predict(frame[list(columns)].iloc[a:b])
                ratio = (frame["realised_next"].iloc[a:b].astype(float) / implied)[(implied > 0) & frame["realised_next"].iloc[a:b].notna()]
                if len(ratio):
                    out.append((series, int(index), int(fold), float((ratio - np.log(ratio) - 1).mean())))
            yield pd.DataFrame(out, columns=["series_id", "grid_idx", "fold", "qlike"])

    scored = work.repartition(parts, "series_id", "grid_idx", "fold").mapInPandas(run, "series_id string, grid_idx int, fold int, qlike double")
    means = scored.groupBy("series_id", "grid_idx").agg(F.count("*").alias("folds"), F.avg("qlike").alias("mean_qlike"))
    w = Window.partitionBy("series_id").orderBy("mean_qlike", "grid_idx")
    return means.withColumn("place", F.row_number().over(w))


def best_points(tuned: DataFrame, points: list[dict]) -> DataFrame:
    """(series_id, depth, rate, trees, min_child): each series' best point of ``tune``."""
    table = F.array(*[F.struct(*[F.lit(p[k]).alias(k) for k in ("grid_idx", *POINT)]) for p in points])
    best = tuned.where("place = 1").select("series_id", F.col("grid_idx").alias("best"), F.explode(table).alias("p"))
    return best.where("p.grid_idx = best").select("series_id", *[f"p.{k}" for k in POINT])
