"""Alignment of keyed tables: reindexing, strict joins, set checks and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["series_id", "d"]


class MissingRows(ValueError):
    """A strict alignment found keys without a partner."""


def reindex(target: DataFrame, source: DataFrame, on: list[str] = KEYS) -> DataFrame:
    return target.join(source, on, "left")


def missing_keys(target: DataFrame, source: DataFrame, on: list[str] = KEYS) -> DataFrame:
    return target.select(*on).join(source, on, "left_anti")


def reindex_strict(target: DataFrame, source: DataFrame, on: list[str] = KEYS) -> DataFrame:
    """``reindex`` that raises when a key of ``target`` has no row (an action)."""
    gone = missing_keys(target, source, on).limit(5).collect()
    if gone:
        raise MissingRows(f"no rows for {[tuple(r) for r in gone]}")
    return reindex(target, source, on)


def outer_columns(a: DataFrame, b: DataFrame, on: list[str] = KEYS) -> DataFrame:
    return a.join(b, on, "full")


def same_keys(a: DataFrame, b: DataFrame, on: list[str] = KEYS) -> bool:
    """Whether both tables have the same set of keys (an action)."""
    x, y = a.select(*on).distinct(), b.select(*on).distinct()
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def inner_complete(a: DataFrame, b: DataFrame, on: list[str] = KEYS) -> DataFrame:
    out = a.join(b, on, "full")
    return out.dropna(subset=[c for c in out.columns if c not in on])


def window_rows(windows: tuple[tuple[str, str, str], ...]):
    """Named inclusive windows (label, start, stop) as an array of structs, for ``explode``."""
    return F.array(*[F.struct(F.lit(label).alias("label"), F.lit(a).cast("date").alias("start"), F.lit(b).cast("date").alias("stop")) for label, a, b in windows])


def in_windows(rows: DataFrame, windows: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """Rows with each named window they lie in; a row in several windows comes once for each."""
    held = F.filter(window_rows(windows), lambda w: F.col("d").between(w["start"], w["stop"]))
    return rows.withColumn("__w", F.explode(held)).select("*", "__w.label", "__w.start", "__w.stop").drop("__w")


def paired(obs: DataFrame, a: str, b: str) -> DataFrame:
    """Observations of two models on the days where both are valid, side by side."""
    pick = lambda m, tag: obs.where((F.col("model") == m) & F.col("valid")).select(*KEYS, "regime", "realised", F.col("implied").alias(f"implied_{tag}"), F.col("qlike").alias(f"qlike_{tag}"))
    return pick(a, "a").join(pick(b, "b").drop("regime", "realised"), KEYS)


def grid(**columns: list) -> list[dict]:
    """The Cartesian grid of parameter lists in their order, each point with its ordinal ``grid_idx``."""
    points: list[dict] = [{}]
    for name, values in columns.items():
        points = [p | {name: v} for p in points for v in values]
    return [p | {"grid_idx": k} for k, p in enumerate(points)]
