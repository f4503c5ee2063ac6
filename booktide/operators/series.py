"""Operators on series of one key: as-of joins, gaps, change detection, liveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DAY_MS, ladder


#: Time that rows of one key share a task for, at most, in as-of joins: a key of any length is dealt over many tasks.
BUCKET_MS = 7 * DAY_MS


def carried(rows: DataFrame, by: list[str], at: str, order: list[str], values: dict[str, Column], forward: bool = False, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """rows with the last non-null value of each column at or before the row, in the order (at, *order); forward: the first at or after it.

    Keys are dealt by buckets of time. A first pass takes the last value of each bucket, a row each, and carries it over to the next ones;
    the window then runs inside a bucket, over rows that the join has put in place already.
    """
    x = rows.withColumn("_b", F.floor(F.col(at) / bucket_ms))
    place, pick = F.struct(at, *order), F.min_by if forward else F.max_by
    way = lambda c: F.col(c).desc() if forward else F.col(c).asc()
    ends = x.groupBy(*by, "_b").agg(*(pick(v, F.when(v.isNotNull(), place)).alias(k) for k, v in values.items()))
    earlier = Window.partitionBy(*by).orderBy(way("_b")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "_b", *(F.last(k, ignorenulls=True).over(earlier).alias(f"_in_{k}") for k in values))
    inside = Window.partitionBy(*by, "_b").orderBy(way(at), *map(way, order)).rowsBetween(Window.unboundedPreceding, 0)
    out = x.join(ends, [*by, "_b"], "left").select(*rows.columns, *(F.coalesce(F.last(v, ignorenulls=True).over(inside), F.col(f"_in_{k}")).alias(k) for k, v in values.items()))
    return out


def _asof(requests: DataFrame, series: DataFrame, key: str, at: str, when: str, order: list[str], columns: list[str], forward: bool) -> DataFrame:
    kind = series.select(F.struct(*columns)).schema[0].dataType
    none = [F.lit(None).cast(series.schema[c].dataType).alias(f"_{c}") for c in order]
    left = requests.select(F.col(key), F.col(at).alias("_t"), F.lit(1).alias("_left"), *none, F.lit(None).cast(kind).alias("_row"), F.struct(*requests.columns).alias("_request"))
    right = series.join(requests.select(key).distinct(), key, "left_semi").select(F.col(key), F.col(when).alias("_t"), F.lit(0).alias("_left"), *(F.col(c).alias(f"_{c}") for c in order), F.struct(*columns).alias("_row"))
    both = left.unionByName(right, allowMissingColumns=True)
    out = carried(both, [key], "_t", ["_left", *(f"_{c}" for c in order)], {"_found": F.col("_row")}, forward).where("_left = 1")
    return out.select(*(F.col("_request")[c].alias(c) for c in requests.columns), *(F.col("_found")[c].alias(c) for c in columns))


def asof_backward(requests: DataFrame, series: DataFrame, key: str, at: str, when: str, order: list[str], columns: list[str]) -> DataFrame:
    """Each request (key, at) with the columns of the last row of series at or before it; later order columns break ties."""
    return _asof(requests, series, key, at, when, order, columns, False)


def asof_forward(requests: DataFrame, series: DataFrame, key: str, at: str, when: str, order: list[str], columns: list[str]) -> DataFrame:
    """Each request with the first row of series strictly after it."""
    return _asof(requests, series, key, at, when, order, columns, True)


def pair_gaps(opens: DataFrame, closes: DataFrame) -> DataFrame:
    """Intervals of gap rows: opens (gap_id, scope, open_ms, reason) and closes (opens_gap_id, close_ms); an open one has no close."""
    return opens.join(closes, opens.gap_id == closes.opens_gap_id, "left").select("gap_id", "scope", "open_ms", "close_ms", "reason")


def first_overlap(spans: DataFrame, gaps: DataFrame, bucket_ms: int, span_id: str = "span_id") -> DataFrame:
    """Each span (span_id, scope, from_ms, to_ms) with the first gap that overlaps (from, to]: gap_id and reason, null if none.

    Gaps and spans meet in buckets of time, so a long series is no single group; a gap is given to the buckets that a span of its scope
    can share, an open one up to the last span of its scope.
    """
    last = spans.groupBy("scope").agg(F.max("to_ms").alias("_end"), F.min("from_ms").alias("_start"))
    low = F.floor(F.greatest("open_ms", "_start") / bucket_ms)
    high = F.floor(F.least(F.coalesce("close_ms", "_end"), "_end") / bucket_ms)
    g = gaps.join(last, "scope").where(low <= high).withColumn("_b", F.explode(F.sequence(low, high)))
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("from_ms") / bucket_ms), F.floor(F.col("to_ms") / bucket_ms))))
    meets = (g.open_ms < s.to_ms) & (g.close_ms.isNull() | (g.close_ms > s.from_ms))
    hits = s.join(g, (s.scope == g.scope) & (s["_b"] == g["_b"]) & meets).groupBy(s[span_id]).agg(F.min(F.struct(g.open_ms, g.gap_id, g.reason)).alias("_g"))
    return spans.join(hits, span_id, "left").select(*spans.columns, F.col("_g.gap_id").alias("gap_id"), F.col("_g.reason").alias("reason"))


def changes(series: DataFrame, key: str, order: list[str], state: list[str]) -> DataFrame:
    """series with changed: 1 where the state differs from the row before (or there is none), else 0 (evidence that it did not)."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(F.struct(*state)).over(w)
    return series.withColumn("changed", (~before.eqNullSafe(F.struct(*state))).cast("int"))


def quiet_intervals(series: DataFrame, key: str, when: str, order: list[str]) -> DataFrame:
    """Intervals between neighbouring activity times of a key; gaps of zero are skipped."""
    w = Window.partitionBy(key).orderBy(when, *order)
    out = series.withColumn("_next", F.lead(when).over(w)).where(F.col("_next") > F.col(when))
    return out.select(key, F.col(when).alias("from_ms"), F.col("_next").alias("to_ms"), (F.col("_next") - F.col(when)).alias("quiet_ms"))


def poll_gaps(polls: DataFrame) -> DataFrame:
    """Gaps of polls (subject, start_ms, poll_id, session, ok, recv_ms): from the last good answer before a failure or a new session to the next good one.

    Failures before the first success make no gap; a trailing failure stays open.
    """
    w = Window.partitionBy("subject").orderBy("start_ms", "poll_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    good = F.when(F.col("ok") == 1, F.struct("recv_ms", "session"))
    p = polls.withColumn("_last", F.last(good, ignorenulls=True).over(before)).withColumn("_failed", F.col("ok") == 0)
    runs = p.withColumn("_run", F.sum(F.col("ok").cast("int")).over(before)).where("_last is not null")
    first_bad = Window.partitionBy("subject", "_run").orderBy("start_ms", "poll_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = runs.withColumns({"_bad": F.max(F.col("_failed").cast("int")).over(first_bad), "_end": F.max(F.when(F.col("ok") == 1, F.col("recv_ms"))).over(first_bad), "_n": F.row_number().over(Window.partitionBy("subject", "_run").orderBy("start_ms", "poll_id")), "_new": F.max(F.when((F.col("ok") == 1) & (F.col("session") != F.col("_last.session")), 1).otherwise(0)).over(first_bad)})
    reason = ladder([(F.col("_bad") == 1, "request_failed"), (F.col("_new") == 1, "recorder_restart")])
    return runs.where("_n = 1").withColumn("reason", reason).where("reason is not null").select("subject", F.col("_last.recv_ms").alias("open_ms"), F.col("_end").alias("close_ms"), "reason")


def reach_gaps(spans: DataFrame) -> DataFrame:
    """Holes in the cover of spans (scope, start_ms, end_ms): where a span begins after all before it have ended."""
    w = Window.partitionBy("scope").orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)
    out = spans.withColumn("_reach", F.max("end_ms").over(w)).where(F.col("start_ms") > F.col("_reach"))
    return out.select("scope", F.col("_reach").alias("open_ms"), F.col("start_ms").alias("close_ms"))


def sequence_gaps(series: DataFrame, key: str, order: list[str], seq: str) -> DataFrame:
    """How often a sequence number jumps past the highest seen plus one, by key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = series.withColumn("_top", F.max(seq).over(w))
    return out.groupBy(key).agg(F.sum(F.when(F.col(seq) > F.col("_top") + 1, 1).otherwise(0)).cast("long").alias("gaps"), F.count(F.lit(1)).alias("rows"))


def span_id_first(df: DataFrame, by: list[str]) -> DataFrame:
    """First row flag of each key in order: 1 at the first row of a session for a subject."""
    return df.withColumn("first", (F.row_number().over(Window.partitionBy(*by[:-1]).orderBy(by[-1])) == 1).cast("int"))
