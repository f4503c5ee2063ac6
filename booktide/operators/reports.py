"""Reports over facts: faults against the gaps they must leave, quiet channels, listings, storage, and the state of a capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ladder

#: Gap reasons that each fault may cause, its margin of receipt, how long a resubscription may take, offsets and the dense window.
ALLOWED = {
    "socket_kill": ["reconnect", "connection_lost"], "process_kill": ["reconnect", "connection_lost", "connection_end_unrecorded"],
    "channel_stall": ["sequence_gap"], "sequence_skip": ["sequence_gap"],
}
SLACK_MS, RESUBSCRIBE_S = 1000, 60
OFFSETS_S, DENSE_LEAD_S, DENSE_TAIL_S, ROUND_MS = (86_400, 21_600, 3_600, 900), 900, 1800, 600_000


def faults(events: DataFrame) -> DataFrame:
    """Injected faults with the first result of each: fault_id, kind, injected_ms, subscriptions, applied (null without a result), report.

    events: rows with at_ms, ref and JSON frame of a recorder's event frames.
    """
    at = lambda k: F.get_json_object("frame", f"$.{k}")
    x = events.select("at_ms", "ref", "frame", at("type").alias("type"), at("fault_id").alias("fault_id"))
    label = x.where("type = 'fault_injected'").groupBy("fault_id").agg(F.min_by(F.struct("at_ms", at("kind").alias("kind"), at("subscriptions").alias("subscriptions"), at("target").alias("target")), F.struct("at_ms", "ref")).alias("l"))
    done = x.where("type in ('fault_applied', 'fault_failed')").groupBy("fault_id").agg(F.min_by(F.struct((F.col("type") == "fault_applied").alias("applied"), at("report").alias("report")), F.struct("at_ms", "ref")).alias("r"))
    return label.join(done, "fault_id", "left").select("fault_id", F.col("l.kind").alias("kind"), F.col("l.at_ms").alias("injected_ms"), F.col("l.subscriptions").alias("subscriptions"), F.col("l.target").alias("target"), F.col("r.applied").alias("applied"), F.col("r.report").alias("report"))


def expectations(found: DataFrame) -> DataFrame:
    """What each applied fault must have left: fault_id, kind, market, channel, at_ms, seq (of a dropped delta, else null)."""
    f = found.where("applied")
    subs = F.from_json("subscriptions", "array<struct<channel:string,markets:array<string>>>")
    killed = F.coalesce(F.get_json_object("report", "$.applied_ts_ms"), F.get_json_object("report", "$.killed_ts_ms")).cast("long")
    one = F.when(F.col("kind") == "socket_kill", F.get_json_object("target", "$.channel"))
    cut = f.where("kind in ('socket_kill', 'process_kill')").select("fault_id", "kind", killed.alias("at_ms"), one.alias("one"), F.explode(subs).alias("s"))
    cut = cut.where("one is null or one = s.channel").select("fault_id", "kind", F.explode("s.markets").alias("market"), F.col("s.channel").alias("channel"), "at_ms", F.lit(None).cast("long").alias("seq"))
    drops = F.from_json(F.get_json_object("report", "$.dropped"), "array<struct<ts_ms:bigint,markets:map<string,map<string,bigint>>>>")
    lost = f.where("kind in ('channel_stall', 'sequence_skip')").select("fault_id", "kind", F.explode(drops).alias("d")).select("fault_id", "kind", F.col("d.ts_ms").alias("at_ms"), F.explode("d.markets").alias("market", "c"))
    return cut.unionByName(lost.select("fault_id", "kind", "at_ms", "market", F.explode("c").alias("channel", "seq"))).distinct()


def judged(wanted: DataFrame, gaps: DataFrame, evidence: DataFrame, snapshots: DataFrame, slack_ms: int = SLACK_MS) -> DataFrame:
    """For each expectation whether a gap is right for it: fault_id, kind, market, channel, at_ms, seq, gap_id (null if none), problems.

    gaps: gap_id, market, channel, reason, start_ms, end_ms, start_ref, end_ref. evidence: market, at_ms, seq (signs of life of books).
    snapshots: ref, market, channel, conn, seq, subscribed; start_conn of a gap is that of its start_ref. A gap covers a fault that lies
    between its start, with a margin for receipt, and its end. It is right if the fault can cause its reason, it opens at the last sign of
    life before the fault (for a dropped delta: with a smaller sequence), and it closes after the fault at a snapshot that is not behind
    what was dropped; it may stay open only if the book was not seen again. The latest gap that opens before the fault is told first.
    """
    e = wanted.withColumn("key", F.xxhash64("fault_id", "market", "channel", "at_ms", "seq"))
    g = e.join(gaps, ["market", "channel"]).where((F.col("start_ms") <= F.col("at_ms") + slack_ms) & (F.col("end_ms").isNull() | (F.col("end_ms") >= F.col("at_ms"))))
    until = F.least(F.col("at_ms") + slack_ms, F.coalesce(F.col("end_ms") - 1, F.col("at_ms") + slack_ms))
    seen = g.select("key", "gap_id", "market", until.alias("until"), F.col("seq").alias("below")).join(evidence.select("market", F.col("at_ms").alias("t"), F.col("seq").alias("s")), "market")
    last = seen.where((F.col("t") <= F.col("until")) & (F.col("below").isNull() | (F.col("s") < F.col("below")))).groupBy("key", "gap_id").agg(F.max("t").alias("last_ms"))
    again = e.select("key", "market", "at_ms").join(evidence.select("market", F.col("at_ms").alias("t")), "market").where("t > at_ms").select("key").distinct().withColumn("again", F.lit(True))
    end = snapshots.select(F.col("ref").alias("end_ref"), "market", "channel", F.col("conn").alias("end_conn"), F.col("seq").alias("end_seq"), F.col("subscribed").alias("end_sub"), F.lit(True).alias("is_snapshot"))
    x = g.join(last, ["key", "gap_id"], "left").join(again, "key", "left").join(end, ["end_ref", "market", "channel"], "left")
    allowed = F.element_at(F.create_map(*(v for k, r in ALLOWED.items() for v in (F.lit(k), F.array(*map(F.lit, r))))), F.col("kind"))
    behind = F.col("seq").isNotNull() & (F.col("start_conn") == F.col("end_conn")) & ~F.col("end_sub") & (F.col("end_seq") < F.col("seq"))
    wrong = [
        (~F.array_contains(allowed, F.col("reason")), "reason"), ((F.col("channel") == "book") & F.col("last_ms").isNotNull() & (F.col("last_ms") != F.col("start_ms")), "start"),
        (F.col("end_ms").isNull() & F.col("again").isNotNull(), "never_closes"), (F.col("end_ms") <= F.col("at_ms"), "closes_before"),
        ((F.col("end_ms") > F.col("at_ms")) & F.col("is_snapshot").isNull(), "closes_at_no_snapshot"), (behind, "closes_behind"),
    ]
    x = x.withColumn("problems", F.array_compact(F.array(*(F.when(t, r) for t, r in wrong))))
    rank = F.struct((F.size("problems") > 0).alias("bad"), (F.col("start_ms") > F.col("at_ms")).alias("late"), (-F.col("start_ms")).alias("s"), "gap_id")
    best = x.groupBy("key").agg(F.min_by(F.struct("gap_id", "problems"), rank).alias("b"))
    out = e.join(best, "key", "left")
    problems = F.coalesce(F.col("b.problems"), F.array(F.lit("no_gap")))
    return out.select("fault_id", "kind", "market", "channel", "at_ms", "seq", F.when(F.size(problems) == 0, F.col("b.gap_id")).alias("gap_id"), problems.alias("problems"))


def gate(checks: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """One row: passed, n_checks, n_wrong, n_without_result, kinds (applied, by kind). Passes if all checks are right, all faults have a result, and each kind was applied often enough."""
    c = checks.agg(F.count(F.lit(1)).alias("n_checks"), F.count_if(F.size("problems") > 0).alias("n_wrong"))
    f = found.agg(F.count_if(F.col("applied").isNull()).alias("n_without_result"), *(F.count_if(F.col("applied") & (F.col("kind") == k)).alias(k) for k in ALLOWED))
    both = c.withColumn("_k", F.lit(1)).join(f.withColumn("_k", F.lit(1)), "_k").drop("_k")  # a row each
    enough = [F.col(k) >= least for k in ALLOWED]
    ok = (F.col("n_wrong") == 0) & (F.col("n_without_result") == 0)
    for t in enough:
        ok = ok & t
    return both.select(ok.alias("passed"), "n_checks", "n_wrong", "n_without_result", *ALLOWED)


def activity(ticks: DataFrame, evidence: DataFrame) -> DataFrame:
    """Times at which a stream's channel showed life by itself: its ticks, and evidence from deltas. Probes are our own doing."""
    t = ticks.where("source = 'stream'").select("instrument", "observed_ms")
    return t.unionByName(evidence.where("kind = 'delta_unchanged'").select("instrument", "observed_ms"))


def buckets_of(relative_s: Column) -> Column:
    """Which stretch of time before or after a start: the offsets, the dense window, after it."""
    edges = sorted((o for o in OFFSETS_S if o > DENSE_LEAD_S), reverse=True)
    steps = [(relative_s < -edges[0], f"before -{edges[0]}")]
    for a, b in zip(edges, [*edges[1:], DENSE_LEAD_S], strict=True):
        steps.append((relative_s < -b, f"-{a} to -{b}"))
    return ladder([*steps, (relative_s < DENSE_TAIL_S, f"-{DENSE_LEAD_S} to {DENSE_TAIL_S}")], f"after {DENSE_TAIL_S}")


def quiet_by_start(acts: DataFrame, events: DataFrame, gaps: DataFrame) -> DataFrame:
    """Quiet intervals of each channel by their time to the start: bucket, n, gapped (overlapped by a gap, not counted as quiet), p50_s, p95_s, longest_s.

    acts: instrument, observed_ms; events: instrument, scope, start_ms, from_ms, to_ms; gaps: scope, open_ms, close_ms. Intervals of zero are skipped.
    """
    x = acts.join(events, "instrument").where("observed_ms between from_ms and to_ms").select("instrument", "scope", "start_ms", "observed_ms").distinct()
    x = x.withColumn("until_ms", F.lead("observed_ms").over(Window.partitionBy("instrument", "start_ms").orderBy("observed_ms"))).where("until_ms is not null")
    g = gaps.select("scope", "open_ms", F.coalesce("close_ms", F.lit(2**62)).alias("close_ms"))
    hit = x.join(g, "scope").where("open_ms < until_ms and close_ms > observed_ms").select("instrument", "start_ms", "observed_ms").distinct().withColumn("gap", F.lit(True))
    x = x.join(hit, ["instrument", "start_ms", "observed_ms"], "left").withColumns({"bucket": buckets_of((F.col("observed_ms") - F.col("start_ms")) / 1000), "quiet_s": F.when(F.col("gap").isNull(), (F.col("until_ms") - F.col("observed_ms")) / 1000)})
    rank = lambda q: F.percentile_approx("quiet_s", F.lit(q), F.lit(100_000))
    return x.groupBy("bucket").agg(F.count("quiet_s").alias("n"), F.count("gap").alias("gapped"), rank(0.5).alias("p50_s"), rank(0.95).alias("p95_s"), F.max("quiet_s").alias("longest_s"))


def verdicts(prices: DataFrame, label: str) -> DataFrame:
    """How often each verdict occurs by label: a reason, else "live, bracketed" or "live, recent"."""
    v = F.coalesce("reason", F.when(F.col("bracket_ms").isNotNull(), "live, bracketed").otherwise("live, recent"))
    return prices.groupBy(label, v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def listing_leads(listed: DataFrame, markets: DataFrame) -> DataFrame:
    """How long before its start each market was first listed: market, league, lead_ms, censored (it was there in its league's first round, so the lead is at least that); lead null if never listed.

    listed: market, league, at_ms; markets: market, league, start_ms.
    """
    first = listed.groupBy("market").agg(F.min("at_ms").alias("first_ms"))
    rounds = listed.groupBy("league").agg(F.min("at_ms").alias("round_ms"))
    x = markets.join(first, "market", "left").join(rounds, "league", "left")
    return x.select("market", "league", (F.col("start_ms") - F.col("first_ms")).alias("lead_ms"), (F.col("first_ms") - F.col("round_ms") < ROUND_MS).alias("censored"))


def probe_tallies(events: DataFrame) -> DataFrame:
    """Probes sent and skipped by channel and class: type, channel, class (quiet, dense, or unclassified where the recorder did not say), n. events: JSON frames."""
    e = events.select(F.from_json("frame", "struct<type:string,channel:string,markets:array<string>,outside_dense:array<string>>").alias("e")).where("e.type in ('probe_sent', 'probe_skipped')")
    x = e.select("e.type", "e.channel", "e.outside_dense", F.explode("e.markets").alias("market"))
    kind = F.when(F.col("outside_dense").isNull(), "unclassified").when(F.array_contains("outside_dense", F.col("market")), "quiet").otherwise("dense")
    return x.groupBy("type", "channel", kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def storage(segments: DataFrame) -> DataFrame:
    """Segments, bytes, frames and unclean closes by source and day. segments: source, day, bytes, frame_count, unclean_close."""
    return segments.groupBy("source", "day").agg(F.count(F.lit(1)).alias("segments"), F.sum("bytes").alias("bytes"), F.sum("frame_count").alias("frames"), F.count_if("unclean_close").alias("unclean"))


def depth_by_reason(snapshots: DataFrame, levels: DataFrame, cents: int) -> DataFrame:
    """Book snapshots by reason: n, cut (ladders that may have been cut), deep (both sides hold at least so many cents). levels: snapshot_id, side, payout_cents."""
    both = levels.groupBy("snapshot_id").agg(*(F.sum(F.when(F.col("side") == s, F.col("payout_cents")).otherwise(0)).alias(f"s{s}") for s in (0, 1)))
    x = snapshots.join(both, "snapshot_id", "left")
    return x.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("complete")).alias("cut"), F.count_if(F.least(F.coalesce("s0", F.lit(0)), F.coalesce("s1", F.lit(0))) >= cents).alias("deep"))


def capture_status(checks: DataFrame) -> DataFrame:
    """The worst of each source's checks, and of all (source null): source, state. checks: source, state (OK, WARN or FAIL)."""
    rank = F.when(F.col("state") == "FAIL", 2).when(F.col("state") == "WARN", 1).otherwise(0)
    x = checks.withColumn("r", rank)
    g = x.groupBy("source").agg(F.max("r").alias("r")).unionByName(x.agg(F.max("r").alias("r")).select(F.lit(None).cast("string").alias("source"), "r"))
    return g.select("source", F.element_at(F.array(*map(F.lit, ("OK", "WARN", "FAIL"))), F.col("r") + 1).alias("state"))


def longest_wait(polls: DataFrame, by: list[str], at: str) -> DataFrame:
    """The longest time between neighbouring polls of each key: by, longest_ms."""
    gap = F.lead(at).over(Window.partitionBy(*by).orderBy(at)) - F.col(at)
    return polls.withColumn("_g", gap).groupBy(*by).agg(F.max("_g").alias("longest_ms"))


def sequence_jumps(series: DataFrame) -> DataFrame:
    """How often a sequence skips ahead on each connection and market. series: conn, market, at_ms, ref, seq, snapshot.

    The baseline is the highest number seen; a snapshot sets it, unless it is behind, and is no jump itself.
    """
    w = Window.partitionBy("conn", "market").orderBy("at_ms", "ref").rowsBetween(Window.unboundedPreceding, -1)
    top = F.max("seq").over(w)
    jump = ~F.col("snapshot") & (F.col("seq") > top + 1)
    return series.withColumn("_j", F.coalesce(jump, F.lit(False))).groupBy("conn", "market").agg(F.count_if("_j").alias("jumps"), F.count(F.lit(1)).alias("rows"))
