"""Shared-folder tables that cut lineage, and small helpers common to the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only a local session (tests)
    may lack it; a folder of this machine is then used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    found = f"file://{tempfile.mkdtemp(prefix='quartzvol-')}"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Workspace:
    """Tables of one operator run, each in a folder of its own under the shared folder.

    ``save`` writes and rereads a table, so a lost executor costs a reread and
    not the whole lineage. ``drop`` deletes a table that no later result reads;
    what is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}
        atexit.register(self._close)

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{label}"

    def save(self, df: DataFrame, label: str = "table") -> DataFrame:
        path = self.path(label)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self._paths.pop(id(df), None)
        if path:
            _remove(self.spark, path)

    def _close(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                _remove(self.spark, self.root)
            except Exception:  # the session may be gone already at interpreter exit
                return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key is hot when more than this part of all rows carries it, so there are fewer hot keys than HOT_KEYS.
HOT_KEYS = 1024
#: A salt gets at least so many rows, so the rows repeated for salts are few beside those they meet.
SALT_ROWS = 256


def hot_among(counts: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """(keys, salts) of the hot keys of ``counts`` (keys, rows that carry the key); a salt gets no more rows than a key that isn't hot."""
    most = F.lit(max(SALT_ROWS, -(-total // HOT_KEYS)))
    hot = counts.where((F.col(n) > most) & F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull())
    return hot.select(*keys, F.ceil(F.col(n) / most).cast("int").alias("salts"))


def hot_keys(rows: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``hot_among`` for a table's own keys; partial sums count them, so no task gets a hot key's rows."""
    return hot_among(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys, "n", total)


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame, spread: Column, how: str = "left") -> DataFrame:
    """``rows`` joined with ``table`` (other column names) on ``keys``, without a task that gets a hot key's rows.

    Rows of a hot key are dealt by ``spread`` over its salts, and the table's row
    is repeated for each of them. Only the list of hot keys is broadcast: fewer
    than HOT_KEYS rows. Null keys match nothing and are dealt by ``spread`` too.
    """
    few = F.broadcast(hot.select(*keys, F.col("salts").alias("__salts")))
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    salt = F.pmod(F.xxhash64(spread), F.when(known, F.coalesce("__salts", F.lit(1))).otherwise(HOT_KEYS)).cast("int")
    dealt = rows.join(few, keys, "left").withColumn("__salt", salt).select(*rows.columns, "__salt")
    copies = table.join(few, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).select(*table.columns, "__salt")
    return dealt.join(copies, [*keys, "__salt"], how).drop("__salt")
