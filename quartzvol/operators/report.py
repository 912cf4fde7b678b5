"""Report tables: constructions, size and power, and verification against recorded figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simulation


def constructions(measured: DataFrame, recorded: DataFrame) -> DataFrame:
    """A row for each construction: its measured rate where there is one, else the recorded one, and where it came from."""
    both = recorded.select("construction", F.col("rate").alias("recorded_rate")).join(measured.select("construction", "rate"), "construction", "full")
    source = F.when(F.col("rate").isNotNull(), "measured").when(F.col("recorded_rate").isNotNull(), "recorded").otherwise("missing")
    return both.select("construction", F.coalesce("rate", "recorded_rate").alias("rate"), source.alias("source"))


def size_and_power(facts: DataFrame, null_of: dict[str, str]) -> DataFrame:
    """Rejection rates of all cells beside the power at their null cells' own cutoffs."""
    rates = simulation.rejections(facts).groupBy("cell_key", "alpha").pivot("test", ["normal", "bootstrap"]).agg(F.first("rate"))
    nulls = facts.where(F.col("cell_key").isin(sorted(set(null_of.values()))))
    power = simulation.adjusted_power(facts.where(F.col("cell_key").isin(sorted(null_of))), simulation.null_cutoffs(nulls), null_of)
    return rates.join(power, ["cell_key", "alpha"], "left")


def gaps(wanted: list[str], facts: DataFrame) -> list[str]:
    """Cells that no stored replication covers (an action)."""
    have = {r["cell_key"] for r in facts.select("cell_key").distinct().collect()}
    return [k for k in wanted if k not in have]


def pairs_text(a: str, b: str) -> Column:
    """Two rates as ``a/b``, "not recorded" where both are missing."""
    text = F.concat_ws("/", F.format_number(a, 3), F.format_number(b, 3))
    return F.when(F.col(a).isNull() & F.col(b).isNull(), "not recorded").otherwise(text)
