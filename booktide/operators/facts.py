"""Versioned facts: heads, conflicts, lookups, settlements, starts, snapshots, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ladder

#: The official source, the claims of a start that count, and how far apart they may lie.
OFFICIAL = "mlb_statsapi"
START_KINDS = [("mlb_statsapi", "first_pitch"), ("mlb_statsapi", "status_in_progress"), ("novig_stream", "venue_golive")]
MAX_SPAN_MS = 120_000


def heads(observations: DataFrame, key: str | list[str], id_: str, supersedes: str) -> DataFrame:
    """The newest row that none supersedes of each key, and n_heads: over 1 is a conflict."""
    old = observations.select(F.col(supersedes).alias("_old")).where("_old is not null")
    live = observations.join(old, F.col(id_) == F.col("_old"), "left_anti")
    live = live.withColumns({"n_heads": F.count(F.lit(1)).over(Window.partitionBy(key)), "_n": F.row_number().over(Window.partitionBy(key).orderBy(F.col(id_).desc()))})
    return live.where("_n = 1").drop("_n")


def eligibility(status: Column, equivalence: Column, n_heads: Column) -> Column:
    """Why a mapping may not be used; null if it may."""
    return ladder([
        (n_heads > 1, "mapping_conflict"), (status == "rejected", "mapping_rejected"), (~status.isin("exact", "manual_verified"), "mapping_unverified"),
        (equivalence == "not_equivalent", "rules_mismatch"), (equivalence == "pending", "equivalence_pending"),
    ])


def reference(mappings: DataFrame, by: list[str], instrument: str) -> DataFrame:
    """The single direct mapping of a venue to an outcome: its instrument, or unmapped / ambiguous_reference."""
    ok = F.when((F.col("polarity") == "direct") & (F.col("status") != "rejected"), F.col(instrument))
    g = mappings.groupBy(*by).agg(F.count_distinct(ok).alias("n"), F.min(ok).alias("_i"))
    return g.select(*by, "n", F.when(F.col("n") == 1, F.col("_i")).alias(instrument), ladder([(F.col("n") == 0, "unmapped"), (F.col("n") > 1, "ambiguous_reference")]).alias("reason"))


def settlement_changes(rows: DataFrame, key: str, order: list[str], state: list[str], id_: str) -> DataFrame:
    """Rows whose state differs from the one before, with the id of the kept row that each supersedes."""
    w = Window.partitionBy(key).orderBy(*order)
    kept = rows.withColumn("_same", F.lag(F.struct(*state)).over(w).eqNullSafe(F.struct(*state))).where(~F.col("_same"))
    return kept.withColumn("supersedes", F.lag(id_).over(w)).drop("_same")


def resolve_start(claims: DataFrame, event: str, max_span_ms: int = MAX_SPAN_MS) -> DataFrame:
    """Bounds of an event's start from claims (event, source, kind, at_ms): n, earliest, selected, latest, span_ms, reason.

    Only claims of START_KINDS count, and one time claimed twice counts once. earliest is over all of them. Without an official claim the
    bounds are recorded without trust; else first pitches, where there are any, decide selected and latest. Claims of any kind that lie
    further apart than max_span_ms disagree. An event without a claim has no row.
    """
    trusted = claims.where(F.struct("source", "kind").isin(*(F.struct(F.lit(s), F.lit(k)) for s, k in START_KINDS)))
    official = F.when(F.col("source") == OFFICIAL, F.col("at_ms"))
    pitch = F.when(F.col("kind") == "first_pitch", F.col("at_ms"))
    g = trusted.groupBy(event).agg(
        F.count_distinct("at_ms").alias("n"), F.min("at_ms").alias("earliest"), F.max("at_ms").alias("_last"),
        F.min(official).alias("_o0"), F.max(official).alias("_o1"), F.min(pitch).alias("_p0"), F.max(pitch).alias("_p1"),
    )
    g = g.withColumn("span_ms", F.col("_last") - F.col("earliest"))
    reason = ladder([(F.col("_o0").isNull(), "no_trusted_off"), (F.col("span_ms") > max_span_ms, "off_disagreement")])
    return g.select(event, "n", "earliest", F.coalesce("_p0", "_o0", "earliest").alias("selected"), F.coalesce("_p1", "_o1", "_last").alias("latest"), "span_ms", reason.alias("reason"))


def at_snapshot(table: DataFrame, id_: str, mark: int | None) -> DataFrame:
    """The rows of a table that a snapshot saw; a table without a mark was empty."""
    return table.where(F.col(id_) <= (mark or 0))


def violations(table: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row (rule, n) for each rule: how many rows break it, in one pass. A rule that is null holds."""
    counts = table.agg(*(F.count_if(~F.coalesce(r, F.lit(True))).alias(k) for k, r in rules.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).cast("long").alias("n")) for k in rules))).alias("x")).select("x.*")


def waterfall(rows: DataFrame, steps: list[str], reason: Column) -> DataFrame:
    """How many rows fail first at each step, and how many are left after it."""
    total = rows.groupBy(reason.alias("step")).agg(F.count(F.lit(1)).alias("_n"))
    order = rows.sparkSession.createDataFrame(list(enumerate(steps)), "pos int, step string")
    # A row for each step and one for each other reason: few, whatever the rows.
    g = order.join(total, "step", "full").withColumn("dropped", F.coalesce("_n", F.lit(0)))
    g = g.withColumn("_all", F.sum("dropped").over(Window.partitionBy(F.lit(0)))).where("pos is not null")
    w = Window.partitionBy(F.lit(0)).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("left", F.col("_all") - F.sum("dropped").over(w)).select("pos", "step", "dropped", "left")


def exactly_one(left: DataFrame, right: DataFrame, on: list[str], within: Column, id_: str, other: str) -> DataFrame:
    """Links of left to right that share keys and meet a condition: clean with one partner, edge with several, excluded with none."""
    hits = left.join(right, on).where(within).groupBy(id_).agg(F.count(F.lit(1)).alias("n"), F.min(other).alias(other))
    out = left.select(id_).join(hits, id_, "left")
    status = F.when(F.col("n") == 1, "clean").when(F.col("n") > 1, "edge").otherwise("excluded")
    return out.select(id_, F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col(other)).alias(other), status.alias("status"))
