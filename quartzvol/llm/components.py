"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, hot_among, spread_join


#: Below so many edges any task can hold them all, so their centres need no salts.
FEW_EDGES = 1 << 16


def _with_least(edges: DataFrame, least: DataFrame, centre: str, other: str, total: int) -> DataFrame:
    if total < FEW_EDGES:
        return edges.join(least, centre)
    return spread_join(edges, least, [centre], hot_among(least, [centre], "n", total), F.col(other), "inner")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("a", "b")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"), F.count("*").alias("n"))
    return _with_least(both, least, "a", "b", 2 * total).where("b > a").select(F.col("low").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Edges come as a < b; each b links its smaller neighbours to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("low"), F.count("*").alias("n"))
    joined = _with_least(edges, least, "b", "a", total)
    up = joined.where("a > low").select(F.col("low").alias("a"), F.col("a").alias("b"))
    return up.union(least.select(F.col("low").alias("a"), "b")).distinct()


def connected_components(ws: Workspace, links: DataFrame) -> DataFrame:
    """(id, root) for every id that occurs in ``links`` (a, b) and is not the smallest of its component.

    Self-links and repeated links are allowed. Each round is written to the
    shared folder, so lineage stays short; the loop ends when a round changes
    nothing, after O(log^2) rounds at most.
    """
    edges = ws.save(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return edges.select(F.col("b").alias("id"), F.col("a").alias("root"))
        seen = mark
        following = ws.save(_small_star(_large_star(edges, mark[0]), mark[0]), "edges")
        ws.drop(edges)
        edges = following
