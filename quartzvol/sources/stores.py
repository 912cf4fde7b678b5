"""Result stores: per-model observations, metadata, resumable facts and small reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from .snapshots import exists


def save_observations(obs: DataFrame, path: str) -> None:
    """One folder a model; typed columns instead of array files."""
    obs.write.mode("overwrite").partitionBy("model").parquet(path)


def load_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or an empty one of its schema where nothing is stored yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def metadata(cfg: EngineConfig, hashes: list[dict], results: dict) -> str:
    """Metadata as JSON; values that JSON lacks (NaN, dates) become null or text."""

    def plain(v):
        if isinstance(v, float) and v != v:
            return None
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return v if v is None or isinstance(v, (bool, int, float, str)) else str(v)

    return json.dumps(plain({"config": json.loads(cfg.to_json()), "files": hashes, "results": results}), sort_keys=True, indent=1)


def save_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_csv(table: DataFrame, path: str) -> None:
    """A report table as one CSV file with a header; reports are small."""
    table.coalesce(1).write.mode("overwrite").csv(path, header=True)


def append_facts(facts: DataFrame, path: str, keys: tuple[str, ...] = ("cell_key", "rep_id")) -> None:
    """Add finished work to a store; work whose key is there already is not added again, so an append may be repeated."""
    spark = facts.sparkSession
    facts = facts.dropDuplicates(list(keys))
    if exists(spark, path):
        facts = remaining(facts, spark.read.parquet(path), list(keys))
    facts.write.mode("append").partitionBy("cell_key").parquet(path)


def remaining(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted keys that are not done yet: what a resumed run has to do."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")
