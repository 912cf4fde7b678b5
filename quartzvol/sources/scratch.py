"""Tables in the shared folder that keep plans short: a step that several later ones read is written once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .snapshots import _filesystem


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local session without one gets a folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    folder = f"file://{tempfile.mkdtemp(prefix='quartzvol-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    try:
        system, target = _filesystem(spark, path)
        system.delete(target, True)
    except Exception:  # the session may end before the interpreter does
        return


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder; it goes when the driver ends."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
