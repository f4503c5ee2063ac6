"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embedding_dedup, line_dedup, mixing, ngram_join, oracle, packing, pii, sharding, topk, toxicity
from .common import read

SHARDS = 16


def tokenizer() -> str:
    """The vocabulary file that packing uses; it is installed on all machines."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """docs with a weight: 1 for a row labelled good, 0.25 for one labelled bad, 0.5 for the others."""
    best = read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_q"))
    return docs.join(best, F.col("doc_id") == F.col("_id"), "left").withColumn("_weight", F.when(F.col("_q") == 1, 1.0).when(F.col("_q") == 0, 0.25).otherwise(0.5))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), SHARDS)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", mixing.words().alias("size"))
    return mixing.mix(quality(spark, sf_dir, docs), F.col("_weight"), F.col("size"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_chats(turns.unionByName(more)))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer())


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those of the queries that SQL can express."""
    return dict(oracle.SQL)
