"""Mixing sources to target weights: weighted sampling without replacement by exponential keys (Efraimidis and Spirakis 2006)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, kept, long_of, ranked

#: What counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
#: The weights of the sources by rank, repeating.
WEIGHTS = (1, 2, 3)
#: A target stops at this many times its source's size.
MOST_EPOCHS = 3


def words(text: str = "text") -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def group_of(source: str = "source") -> Column:
    """The source as a key that is never null and sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """Target of each source, from sizes (_group, source_size), as (_group, source_size, target).

    With the sources in order of cap / weight, all that reach their cap come first; the rest share what is left by weight. So the
    resharing until none is above its cap is one running sum. This table has a row for each source, so that one task can hold it.
    """
    by_name, by_cap = Window.orderBy("_group"), Window.orderBy((F.col("cap") / F.col("w")).asc(), "_group")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    up, down = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = (
        sizes.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * most)
        .withColumn("_all", F.sum("source_size").over(every))
        .withColumn("level", (F.col("_all") - F.coalesce(F.sum("cap").over(up), F.lit(0))).cast("double") / F.sum("w").over(down))
        .withColumn("_free", F.col("level") * F.col("w") <= F.col("cap"))
        .withColumn("rate", F.first(F.when(F.col("_free"), F.col("level")), ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, 0)))
    )
    return share.select("_group", "source_size", F.when(F.col("rate").isNull(), F.col("cap").cast("double")).otherwise(F.col("rate") * F.col("w")).alias("target"))


def mix(docs: DataFrame, weight: Column, size: Column | None = None, key: str = "doc_id", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """How many words the mix takes of each row: doc_id, size, source_size, target, taken. The size is words("text") unless given.

    A source first gives all its rows as often as its target holds them whole. For the rest its rows are put in order of
    -ln(u) / weight, u a hash of the id in (0, 1): an order in which each row comes next with a chance in proportion to its weight. Rows
    are taken while the middle of a row lies below the rest, so the sum misses the target by half a row at most. Null or non-positive
    weights come last; a null text has size 0 and is taken 0 times; a null source is a source; repeated rows are rows of their own.
    Reruns agree, for u comes from the id alone. Other columns of docs play no part; those named in carry are
    added to the output.
    """
    u = (long_of(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 13)) + 0.5) / float(2**52)
    rows = kept(
        docs.select(
            F.col(key).alias("doc_id"), (words() if size is None else size).alias("size"), group_of(source).alias("_group"),
            F.when(weight > 0, -F.ln(u) / weight).otherwise(F.lit(float("inf"))).alias("_key"), *carry,
        )
    )
    goal = kept(targets(rows.groupBy("_group").agg(F.sum("size").alias("source_size"))))
    placed = ranked(rows, ["_group"], ["_key", "doc_id", "size"], value="size").join(bounded(goal), "_group")
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_EPOCHS))).otherwise(0).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    once = F.when((epochs < MOST_EPOCHS) & (F.col("before") + F.col("size") / 2 < rest), 1).otherwise(0)
    return placed.select("doc_id", F.col("size").cast("long"), F.col("source_size").cast("long"), "target", (F.col("size") * (epochs + once)).cast("long").alias("taken"), *carry)
