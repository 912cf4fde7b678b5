"""The registered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, mixing, pii, secrets, urlfilter, warc
from .decontaminate import contamination
from .exact_dedup import exact_duplicates
from .near_dedup import near_duplicates
from .oracles import ORACLE_SQL  # noqa: F401  (registered with the queries)
from .sharding import shard_documents
from .workspace import Workspace, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.with_sizes(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_size", "mix_key")
    docs = Workspace(spark, "sizes").save(docs)
    mixed = mixing.mix(docs, mixing.mixing_plan(docs.select("source", "mix_size", "mix_key")))
    return mixed.selectExpr("doc_id", "mix_size AS size", "source_size", "target", "mix_taken AS taken", "mix_shards AS shards", "mix_order AS shuffle_key")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.scan_documents(table(spark, sf_dir, "documents")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled by its document's toxic flag, unless a fixed rule labels its URL."""
    pages = table(spark, sf_dir, "pages")
    toxic = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("toxic") == 1).alias("blocked"))
    return urlfilter.judge(pages, toxic)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_secret_scan": op2_secret_scan,
    "op3_warc": op3_warc,
    "op4_language_id": op4_language_id,
    "op5_url_filter": op5_url_filter,
    "op6_sharding": op6_sharding,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_pii": op8_pii,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_exact_dedup": op10_exact_dedup,
}
