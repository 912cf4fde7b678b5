"""Sharding of stable keys by jump consistent hashing.

The law is ``key``: a row's shard follows from its doc_id and the shard count
alone, without a ring table, and one more shard takes rows only into itself (an
expected 1 in n + 1 of them). The 64-bit key is the leading half of the MD5 of
the doc_id as decimal text; rows without doc_id use the MD5 of the word
``null`` and so share a shard.

Slots number a shard's rows from 0 without gaps, in the order of a second hash
(the trailing half of the same MD5), doc_id, text CRC and size. The numbering is
distributed: rows fall into BUCKETS ranges of that hash, the ranges' counts are
summed up per shard (at most shards * BUCKETS rows), and rows are numbered only
within their range. The CRC is part of the range's choice for rows that have no
doc_id, so these do not meet in one task.

Defined results: null text has size 1 and the CRC of no bytes (0); equal rows
differ in their slots only; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def jump_hash(keys: np.ndarray, n: int) -> np.ndarray:
    """Shard of each 64-bit key among ``n``; all keys jump together until each has landed."""
    if n < 1:
        raise ValueError("at least one shard is needed")
    key = keys.astype(np.uint64, copy=True)
    shard = np.zeros(len(key), dtype=np.int64)
    jump = np.zeros(len(key), dtype=np.int64)
    moving = np.arange(len(key))
    while len(moving):
        shard[moving] = jump[moving]
        key[moving] = key[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((key[moving] >> np.uint64(33)).astype(np.float64) + 1.0)
        jump[moving] = np.floor((shard[moving] + 1) * step).astype(np.int64)
        moving = moving[jump[moving] < n]
    return shard


def _jump_udf(n: int):
    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy().view(np.uint64), n).astype(np.int32))

    return jump


def key_columns(doc_id: str = "doc_id") -> tuple:
    """The jump key and the slot-order hash of a row, both as signed 64-bit numbers."""
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    return tuple(F.conv(F.substring(digest, at, 16), 16, -10).cast("long") for at in (1, 17))


def shard_documents(docs: DataFrame, shards: int = 16, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs`` (doc_id, text), and the columns to carry along."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key, order = key_columns()
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("__key"), order.alias("__order"), *carry)
    # One Python worker a task makes both: they stand side by side, and as neither is nullable, no join adds a null test with a worker of its own.
    jumps = {"shard": shards, "grown_shard": shards + 1}
    rows = rows.withColumns({name: F.coalesce(_jump_udf(n)("__key"), F.lit(0)) for name, n in jumps.items()}).drop("__key")
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size")).otherwise(F.col("__order"))
    rows = rows.withColumn("__bucket", F.pmod(spread, F.lit(BUCKETS)).cast("int"))
    counts = rows.groupBy("shard", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__bucket").orderBy("__order", "doc_id", "text_crc32", "size")
    numbered = rows.withColumn("__at", F.row_number().over(inside))
    # starts holds at most (shards * BUCKETS) rows of three numbers.
    out = numbered.join(F.broadcast(starts), ["shard", "__bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__start") + F.col("__at") - 1).cast("long").alias("slot"), "grown_shard", *carry)
