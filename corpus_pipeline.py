"""A training corpus in five stages: each takes (spark, docs, sf_dir), works on all rows of docs, and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from booktide.llm import line_dedup, mixing, ngram_join, packing, queries, toxicity
from booktide.llm.common import bounded, fresh, kept, read, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below 0.5, unchanged, with all of their columns. The weights are learnt from the labelled rows of docs.

    Null and empty texts score by the bias alone; repeated rows are judged alike; without labels all rows stay; an empty table stays empty.
    """
    return toxicity.clean(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; of each group of near-equal lines one stays. A document may keep an empty text.

    Null texts stay null; rows equal in id and text keep the same lines; columns of any name stay as they are (see line_dedup.dedup_lines).
    """
    return line_dedup.dedup_lines(docs).select(docs.columns)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, written with a number for each row, and the number's column, whose name no other column has."""
    row = fresh("_row", docs.columns)
    return kept(docs.withColumn(row, F.monotonically_increasing_id())), row


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of links of word n-grams stays: one with the smallest doc_id (null after all others). Texts without words all stay.

    Rows are told apart by a number of their own, so repeated rows, null ids and ids with several texts are judged by their text alone.
    """
    with scratch() as needed:
        rows, row = _numbered(docs)
        needed(rows)
        groups = ngram_join.jaccard_components(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
        many = kept(groups.where("row <> component_id").select("component_id").distinct())
        placed = kept(groups.join(bounded(many), "component_id").join(rows.select(F.col(row).alias("row"), "doc_id"), "row"))
        stays = placed.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")).select(F.col("first.row").alias("row"))
        gone = needed(kept(placed.select("row").join(stays, "row", "left_anti").select(F.col("row").alias(row)), release=True))
    return rows.join(bounded(gone), row, "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each document as often as it is taken, at most three times; documents without words are never taken.

    A null source is a source; null ids and repeated rows are rows of their own; columns of any name stay as they are. Most rows are taken,
    so the copies meet the texts by a shuffle whatever their number: a count would only tell small tables from large ones.
    """
    with scratch() as needed:
        numbered, row = _numbered(docs)
        needed(numbered)
        rows = numbered.select(F.col(row).alias("row"), "doc_id", "source", mixing.words().alias("size"))
        taken = mixing.mix(queries.quality(spark, sf_dir, rows), F.col("_weight"), F.col("size"), carry=("row",)).where("taken > 0")
        times = fresh("_times", docs.columns)
        copies = needed(kept(taken.select(F.col("row").alias(row), (F.col("taken") / F.col("size")).cast("int").alias(times)), release=True))
    out = numbered.join(copies.hint("shuffle_hash"), row)
    return out.select(*(out[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), times)).alias(fresh("_copy", docs.columns))).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of at most 2048 tokens; see packing.pack for the columns, nulls, repeats and empty tables."""
    return packing.pack(docs, queries.tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL expresses neither the learnt scores nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
