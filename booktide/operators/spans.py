"""Continuity of streams: gaps between spans of coverage, and gaps that trusted state closes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ladder

#: Reasons for which a recorder ends a connection on purpose.
PLANNED_CLOSES = ["recorder_stop", "no_active_markets"]


def _deliberate_ends(spans: DataFrame, commands: DataFrame) -> DataFrame:
    """spans with unsub_ms: when the recorder itself ended the subscription that the span belongs to, null if never.

    A subscription lasts from a subscribe command to the next one in the order sent, whatever the clock says; a span belongs to the last
    one that was sent by its first sign of life.
    """
    up = Window.partitionBy("conn", "market").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    c = commands.withColumn("session", F.sum((F.col("kind") == "subscribe").cast("int")).over(up))
    at = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("at_ms")))
    sessions = c.groupBy("conn", "market", "session").agg(at("subscribe").alias("sub_ms"), at("unsubscribe").alias("end_ms"))
    mine = spans.join(sessions, ["conn", "market"]).where("session = 0 or sub_ms <= first_ms").groupBy("span_id").agg(F.max_by("end_ms", "session").alias("unsub_ms"))
    return spans.join(mine, "span_id", "left")


def _losses(spans: DataFrame, losses: DataFrame) -> DataFrame:
    """spans with lost_ms: when the venue was first reported to have dropped the span's subscription, before its connection opened the market's next span."""
    starts = spans.select("conn", "market", "first_ms").distinct()
    starts = starts.withColumn("again_ms", F.lead("first_ms").over(Window.partitionBy("conn", "market").orderBy("first_ms")))
    x = spans.join(starts, ["conn", "market", "first_ms"])
    inside = (F.col("at_ms") >= F.col("first_ms")) & (F.col("again_ms").isNull() | (F.col("at_ms") < F.col("again_ms")))
    hits = x.join(losses, ["conn", "market"]).where(inside).groupBy("span_id").agg(F.min("at_ms").alias("lost_ms"))
    return x.drop("again_ms").join(hits, "span_id", "left")


def span_gaps(spans: DataFrame, commands: DataFrame, ends: DataFrame, losses: DataFrame) -> DataFrame:
    """Gaps in the cover of each market's channel: market, channel, reason, start_ms, end_ms (null while open), start_ref, end_ref.

    spans: span_id (rising in the order found), conn, market, channel, first_ms, last_ms, first_ref, last_ref. commands: conn, market, seq, at_ms, kind (subscribe or
    unsubscribe). ends: conn, reason. losses: conn, market, at_ms. A gap runs from the span that reaches furthest to the first one that
    begins after it, unless the recorder had ended it; after the last span it stays open unless its end was planned.
    """
    x = _losses(_deliberate_ends(spans, commands), losses)
    far = F.struct("last_ms", F.col("first_ms").alias("f"), F.col("span_id").alias("i"), "conn", "last_ref", "unsub_ms", "lost_ms")
    order = Window.partitionBy("market", "channel").orderBy("first_ms", "span_id")
    y = x.withColumn("reach", F.max(far).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    hole = (F.col("first_ms") > F.col("reach.last_ms")) & ~F.coalesce(F.col("reach.unsub_ms") <= F.col("first_ms"), F.lit(False))
    lost = F.coalesce(F.col("reach.lost_ms") <= F.col("first_ms"), F.lit(False))
    between = y.where(hole).select("market", "channel", F.when(lost, "subscription_lost").otherwise("reconnect").alias("reason"), F.col("reach.last_ms").alias("start_ms"), F.col("first_ms").alias("end_ms"), F.col("reach.last_ref").alias("start_ref"), F.col("first_ref").alias("end_ref"))

    last = x.groupBy("market", "channel").agg(F.max(far).alias("reach")).select("market", "channel", "reach.*").where("unsub_ms is null")
    last = last.join(ends.groupBy("conn").agg(F.max("reason").alias("end_reason")), "conn", "left")
    why = ladder([(F.col("lost_ms").isNotNull(), "subscription_lost"), (F.col("end_reason").isin(PLANNED_CLOSES), "planned"), (F.col("end_reason").isNotNull(), "connection_lost")], "connection_end_unrecorded")
    none = F.lit(None)
    trailing = last.withColumn("reason", why).where("reason <> 'planned'").select("market", "channel", "reason", F.col("last_ms").alias("start_ms"), none.cast("long").alias("end_ms"), F.col("last_ref").alias("start_ref"), none.cast("string").alias("end_ref"))
    return between.unionByName(trailing)


def break_gaps(breaks: DataFrame, resyncs: DataFrame) -> DataFrame:
    """Gaps that a break in a stream opens (a skipped sequence, a transition) and the first trusted state at or after it closes, on any connection.

    breaks: market, channel, reason, at_ms, last_ms (the last sign of life, null if there was none), last_ref, ref, seq; resyncs: market,
    channel, at_ms, ref. One break that several connections saw is one gap. Columns as in span_gaps.
    """
    one = F.struct("seq", "at_ms", "last_ms", "last_ref")
    b = breaks.groupBy("market", "channel", "reason", "ref").agg(F.min(one).alias("b")).select("market", "channel", "reason", "ref", "b.*")
    r = resyncs.select("market", "channel", F.col("at_ms").alias("r_ms"), F.col("ref").alias("r_ref"))
    hit = b.join(r, ["market", "channel"]).where("r_ms >= at_ms").groupBy("market", "channel", "reason", "ref").agg(F.min(F.struct("r_ms", "r_ref")).alias("r"))
    x = b.join(hit, ["market", "channel", "reason", "ref"], "left")
    return x.select("market", "channel", "reason", F.coalesce("last_ms", "at_ms").alias("start_ms"), F.col("r.r_ms").alias("end_ms"), F.col("last_ref").alias("start_ref"), F.col("r.r_ref").alias("end_ref"))


def stream_gaps(spans: DataFrame, commands: DataFrame, ends: DataFrame, losses: DataFrame, breaks: DataFrame, resyncs: DataFrame) -> DataFrame:
    """All gaps of a stream, with their scope."""
    every = span_gaps(spans, commands, ends, losses).unionByName(break_gaps(breaks, resyncs))
    return every.withColumn("scope", F.concat(F.lit("novig:market:"), "market", F.lit("/"), "channel"))


def gap_rows(gaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gaps as append-only facts: one row that opens each, and one that closes it where it has an end. gaps: gap_id, scope, reason, start_ms, end_ms."""
    opens = gaps.select("gap_id", "scope", F.lit("open").alias("kind"), "reason", F.col("start_ms").alias("boundary_ms"), F.lit(None).cast("long").alias("opens_gap_id"))
    closes = gaps.where("end_ms is not null").select((F.col("gap_id") + 1).alias("gap_id"), "scope", F.lit("close").alias("kind"), "reason", F.col("end_ms").alias("boundary_ms"), F.col("gap_id").alias("opens_gap_id"))
    return opens, closes
