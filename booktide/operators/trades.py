"""Executions: time, windows, balance, reconciliation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SCALE


def execution_time(sightings: DataFrame) -> DataFrame:
    """Each execution's time: the earliest of its stream sightings, else of all; and the sighting that gave it."""
    stream = F.when(F.col("role") == "stream", F.col("venue_ts_ms"))
    return sightings.groupBy("execution_id").agg(
        F.coalesce(F.min(stream), F.min("venue_ts_ms")).alias("time_ms"),
        F.min_by("sighting_id", F.struct((F.col("role") != "stream").alias("a"), "venue_ts_ms", "sighting_id")).alias("sighting_id"),
    )


def window_vwap(requests: DataFrame, executions: DataFrame, key: str, window_ms: int) -> DataFrame:
    """For each request (request_id, key, as_of_ms) the executions in [as_of - window, as_of): n, payout, sum of price * payout, last time.

    If both sides have a column side, executions of the other side count at their complement. Times are put into buckets as wide as the window, so that a request meets two buckets and the join stays an equi-join.
    Both joins are by shuffle: the estimate for exploded requests is far too low, and they would be collected by the driver to be broadcast.
    """
    sided = "side" in requests.columns and "side" in executions.columns
    executions = executions.withColumnRenamed("side", "_side") if sided else executions
    price = F.when(F.col("side") == F.col("_side"), F.col("price_e4")).otherwise(SCALE - F.col("price_e4")) if sided else F.col("price_e4")
    r = requests.withColumn("_b", F.explode(F.array(F.floor(F.col("as_of_ms") / window_ms), F.floor(F.col("as_of_ms") / window_ms) - 1)))
    e = executions.withColumn("_b", F.floor(F.col("time_ms") / window_ms))
    inside = (F.col("time_ms") >= F.col("as_of_ms") - window_ms) & (F.col("time_ms") < F.col("as_of_ms"))
    got = r.hint("merge").join(e, [key, "_b"]).where(inside).groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("payout_cents").cast("long").alias("payout"), F.sum(price * F.col("payout_cents")).cast("long").alias("paid"), F.max("time_ms").alias("last_ms")
    )
    return requests.hint("merge").join(got, "request_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "payout": F.coalesce("payout", F.lit(0))})


def vwap_price(least_n: int, least_cents: int):
    """(price, reason) of window_vwap rows: few_trades under either bound."""
    few = (F.col("n") < least_n) | (F.col("payout") < least_cents)
    return F.when(~few, F.col("paid") / (F.col("payout") * float(SCALE))), F.when(few, F.lit("few_trades"))


def balance(rows: DataFrame, by: list[str]) -> DataFrame:
    """Groups of maker and taker rows: balanced when both sum to the same and share no outcome, else ambiguous."""
    side = lambda role, c: F.when(F.col("role") == role, F.col(c))
    g = rows.groupBy(*by).agg(
        F.sum(side("maker", "qty")).alias("_m"), F.sum(side("taker", "qty")).alias("_t"),
        F.arrays_overlap(F.collect_set(side("maker", "outcome")), F.collect_set(side("taker", "outcome"))).alias("_both"),
    )
    return g.select(*by, F.when((F.col("_m") == F.col("_t")) & ~F.col("_both"), "balanced").otherwise("ambiguous").alias("status"))


def occurrence(rows: DataFrame, same: list[str], order: list[str]) -> DataFrame:
    """rows with occurrence: which of the equal rows it is, from 0."""
    return rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(*same).orderBy(*order)) - 1)


def match_candidates(stream: DataFrame, executions: DataFrame, key: list[str], near_ms: int, near_e4: int) -> DataFrame:
    """Pairs of stream trades and executions of one key within near_ms and strictly less than near_e4 apart, by buckets of time."""
    s = stream.withColumn("_b", F.explode(F.sequence(F.floor((F.col("s_ms") - near_ms) / near_ms), F.floor((F.col("s_ms") + near_ms) / near_ms))))
    e = executions.withColumn("_b", F.floor(F.col("e_ms") / near_ms))
    return s.join(e, [*key, "_b"]).where((F.abs(F.col("s_ms") - F.col("e_ms")) <= near_ms) & (F.abs(F.col("s_price") - F.col("e_price")) < near_e4)).drop("_b")


def greedy_match(candidates: DataFrame, key: list[str], near_ms: int | None = None) -> DataFrame:
    """One execution for a stream trade at most and the reverse, in stream order, the nearest free one first: (stream_id, execution_id).

    The choice depends on those before it, so candidates go through one function in order. near_ms: no candidates lie further apart; then a
    key's candidates are first cut wherever no trade of one side can reach over, and the runs between are tasks of their own.
    """
    by = list(key)
    if near_ms is not None:
        low, high = F.least("s_ms", "e_ms"), F.greatest("s_ms", "e_ms")
        w = Window.partitionBy(*key).orderBy("_low", "_high")
        x = candidates.withColumns({"_low": low, "_high": high}).withColumn("_reach", F.max("_high").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        candidates = x.withColumn("_run", F.sum(F.when(F.col("_low") > F.col("_reach"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_low", "_high", "_reach")
        by.append("_run")

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for sid, own in pdf.assign(d=(pdf.s_ms - pdf.e_ms).abs()).sort_values(["s_ms", "stream_id", "d", "execution_id"]).groupby("stream_id", sort=False):
            free = next((e for e in own.execution_id if e not in taken), None)
            if free is not None:
                taken.add(free)
                out.append((sid, free))
        return pd.DataFrame(out, columns=["stream_id", "execution_id"])

    return candidates.groupBy(*by).applyInPandas(assign, "stream_id long, execution_id long")
