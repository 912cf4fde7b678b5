"""From raw documents to shards of training text, a stage at a time.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it to the shared folder as Parquet and reads it again as the next stage's docs.
All stages but the last return the columns of ``documents``.

    language_id         documents without letters go, and those that the model tells from no noise
    near_dedup          the document of smallest doc_id of each near-duplicate group stays
    decontamination     documents that hold a benchmark passage go
    mixing              documents are left, taken or repeated as source targets say
    sharding            every remaining row gets its shard and slot

No SQL expresses the learned language model or the seeded draws, so
``ORACLE_SQL`` is None and the tests compare the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quartzvol.llm import decontaminate, langid, mixing, near_dedup, sharding
from quartzvol.llm.workspace import Workspace, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.train(docs, reject=True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dropped = near_dedup.near_duplicates(docs).where("NOT kept").select("doc_id")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows lie in the order of the mix's output shards, shuffled inside each."""
    copies = mixing.repeated(mixing.mix_documents(docs, whole=True))
    return mixing.shuffled(copies).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs, carry=tuple(c for c in docs.columns if c != "doc_id"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("sharding", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return docs
