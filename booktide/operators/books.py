"""Order books: price levels, ladders, depth walks, midpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SCALE, ladder


def aggregate_levels(levels: DataFrame, by: list[str]) -> DataFrame:
    """Sum of payout at each numeric price, totals over zero only, ranked from the best (highest) price; rank from 0."""
    total = levels.groupBy(*by, "price_e4").agg(F.sum("payout_cents").cast("long").alias("payout_cents")).where("payout_cents > 0")
    return total.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("price_e4").desc())) - 1)


def complement_ladder(levels: DataFrame) -> DataFrame:
    """The other side's view: prices become 1 - p, the order stays."""
    return levels.withColumn("price_e4", SCALE - F.col("price_e4"))


def top_n(levels: DataFrame, by: list[str], n: int = 10) -> DataFrame:
    """The best n levels of each ladder, and whether it was cut."""
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return levels.withColumn("truncated", (size > n).cast("int")).where(F.col("rank") < n)


def depth_walk(levels: DataFrame, by: list[str], cents: int | Column) -> DataFrame:
    """For each ladder the payout-weighted price of its first ``cents`` (one number, or a column of by): taken, paid_e4 (sum of price * taken), best_e4.

    Levels are consumed from the best, the last one in part; a ladder that is too short has taken < cents and is never scaled up.
    """
    before = F.coalesce(F.sum("payout_cents").over(Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = F.greatest(F.lit(0), F.least(F.col("payout_cents"), cents - before))
    walked = levels.withColumn("_take", take)
    return walked.groupBy(*by).agg(F.sum("_take").cast("long").alias("taken"), F.sum(F.col("price_e4") * F.col("_take")).cast("long").alias("paid_e4"), F.min_by("price_e4", "rank").cast("long").alias("best_e4"))


def two_sided(walks: DataFrame, *book: str) -> DataFrame:
    """bid and ask walks of each book side by side: side 0 bids; side 1 bids, seen as asks by the complement."""
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    return walks.groupBy(*book).agg(*(pick(s, c).alias(f"{c}{s}") for s in (0, 1) for c in ("taken", "paid_e4", "best_e4")))


def mid_top() -> Column:
    """Midpoint of the best bid and ask, in two_sided rows; null if a side is empty."""
    return (F.col("best_e40") + SCALE - F.col("best_e41")) / (2.0 * SCALE)


def mid_depth(cents: int) -> Column:
    """Midpoint of both depth prices; null if a side is too short."""
    ask = SCALE * F.lit(cents) - F.col("paid_e41")
    return F.when((F.col("taken0") == cents) & (F.col("taken1") == cents), (F.col("paid_e40") + ask) / (2.0 * SCALE * cents))


def depth_reason(cents: int, truncated: Column) -> Column:
    """no_quotes for an empty side; for a short one truncated_ladder if it may have been cut, else insufficient_depth."""
    short = (F.col("taken0") < cents) | (F.col("taken1") < cents)
    return ladder([(F.col("taken0").isNull() | F.col("taken1").isNull(), "no_quotes"), (short & truncated, "truncated_ladder"), (short, "insufficient_depth")])
