"""Calibration: is the reference a martingale up to the close, do entries agree with it, and does the close look into play."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import ladder
from . import closes, facts, identity, stats
from .stats import LEAST_CLUSTERS, Z90

#: The analysis that is specified, times in seconds before the start, shares as fractions.
OFFSETS_S = (86_400, 21_600, 3_600, 900)
SAMPLE_EVENTS, MARGINS, RADIUS = 1500, {"intercept": 0.005, "slope": 0.05, "curvature": 0.016}, 0.2
BINS, TRIGGER = 5, 0.005
AGREEMENT_MARGIN, OUTLIER, MOST_VERIFIED = 0.15, 0.08, 0.01
DISAGREEMENT_S = (120, 300, 600, 1800)
RESULT = "kind string, offset_s int, component string, buffer_s int, n_events long, n_rows long, estimate double, se double, lo double, hi double, margin double, outcome string, detail string"


@dataclass(frozen=True)
class Spec:
    offsets_s: tuple[int, ...] = OFFSETS_S
    buffers_s: tuple[int, ...] = closes.BUFFER_SWEEP_S
    buffer_s: int = closes.BUFFER_S
    sample_events: int = SAMPLE_EVENTS
    radius: float = RADIUS
    bins: int = BINS
    trigger: float = TRIGGER
    admitted: tuple[str, ...] = ()  # reasons of mappings that may be used all the same


def label(offset_s: int) -> str:
    """t-24h, t-6h, t-15m and the like."""
    return f"t-{offset_s // 3600}h" if offset_s % 3600 == 0 else f"t-{offset_s // 60}m"


def _row(kind: str, offset_s: int, component: str, n_events: int, n_rows: int, estimate=None, se=None, margin=None, outcome=None, detail=None, buffer_s=None) -> tuple:
    known = estimate is not None and se is not None
    return kind, offset_s, component, buffer_s, n_events, n_rows, estimate, se, estimate - Z90 * se if known else None, estimate + Z90 * se if known else None, margin, outcome, json.dumps(detail or {}, sort_keys=True)


def invalid_inputs(pairs: DataFrame) -> DataFrame:
    """How many rows hold something that is no probability, or no event: rule, n. All must be 0."""
    return facts.violations(pairs, {"p_entry": stats.probability(F.col("p_entry")), "p_close": stats.probability(F.col("p_close")), "event_id": F.col("event_id").isNotNull()})


def design(pairs: DataFrame, radius: float = RADIUS) -> DataFrame:
    """pairs (offset_s, event_id, p_entry, p_close) with dp and the centred terms linear and quadratic, and their centres."""
    x = pairs.withColumns({"_x": F.col("p_entry") - 0.5, "_q": ((F.col("p_entry") - 0.5) / radius) ** 2, "dp": F.col("p_close") - F.col("p_entry")})
    centers = x.groupBy("offset_s").agg(F.avg("_x").alias("x_center"), F.avg("_q").alias("q_center"))  # a row for each offset
    x = x.join(F.broadcast(centers), "offset_s")
    return x.withColumns({"linear": F.col("_x") - F.col("x_center"), "quadratic": F.col("_q") - F.col("q_center")}).drop("_x", "_q")


def martingale(pairs: DataFrame, offsets: tuple[int, ...], radius: float = RADIUS, sample: int = SAMPLE_EVENTS) -> tuple[list[tuple], DataFrame, dict[tuple, stats.Fit]]:
    """Check 1: rows of RESULT for intercept, slope and curvature at each offset asked for; the fitted rows; the fits.

    An offset without rows is insufficient; rows at an offset that was not asked for are an error.
    """
    x = design(pairs, radius)
    fits, fitted = stats.ols_by(x, ["offset_s"], "dp", ["linear", "quadratic"], "event_id")
    if other := {k for (k,) in fits} - {*offsets}:
        raise ValueError(f"offsets that were not asked for: {sorted(other)}")
    centers = {r.offset_s: (r.x_center, r.q_center) for r in x.select("offset_s", "x_center", "q_center").distinct().collect()}  # a row for each offset
    rows = []
    for k in offsets:
        fit = fits.get((k,), stats.Fit([], [], 0, 0, "missing"))
        for i, (name, margin) in enumerate(MARGINS.items()):
            if fit.reason:
                rows.append(_row("check1", k, name, fit.clusters, fit.n, margin=margin, outcome="insufficient_data", detail={"reason": fit.reason}))
            else:
                detail = {"x_center": centers[k][0], "q_center": centers[k][1], "below_sample_target": fit.clusters < sample}
                rows.append(_row("check1", k, name, fit.clusters, fit.n, fit.value[i], fit.se[i], margin, "passed" if fit.within(i, margin) else "failed", detail))
    return rows, fitted, fits


def lack_of_fit(fitted: DataFrame, fits: dict[tuple, stats.Fit], bins: int = BINS, trigger: float = TRIGGER) -> list[tuple]:
    """Mean residual of each price bin at each offset, as rows of RESULT; flagged where its whole interval lies outside the trigger.

    The mean is a contrast of all rows: w - X (X'X)^-1 X'w for bin weights w. So its error sums, for each event, its residuals in the bin
    over the bin's rows, less its scores times (X'X)^-1 times the bin's mean design. One aggregation by event serves all bins.
    """
    terms, spark = ["_1", "linear", "quadratic"], fitted.sparkSession
    x = stats.ranked_bins(fitted, "p_entry", bins, ["offset_s"])
    per = x.groupBy("offset_s", "bin").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("g"), F.min("p_entry").alias("lo"), F.max("p_entry").alias("hi"), F.avg("e").alias("mean"), *(F.avg(t).alias(f"w{i}") for i, t in enumerate(terms)))
    found = {(r.offset_s, r.bin): r for r in per.collect()}  # offsets times bins rows
    rows, ready = [], []
    for (k,), fit in sorted(fits.items()):
        own = [found.get((k, b)) for b in range(bins)]
        if fit.reason or any(r is None or r.g < LEAST_CLUSTERS for r in own):
            rows.append(_row("bin", k, "bin:all", fit.clusters, fit.n, outcome="insufficient_data", detail={"reason": fit.reason or "a bin has too few events"}))
            continue
        for b, r in enumerate(own):
            v = fit.inverse @ np.array([r.w0, r.w1, r.w2])
            ready.append((k, b, r.n, *map(float, v)))
    if not ready:
        return rows
    by_event = x.groupBy("offset_s", "event_id").agg(*(F.sum(F.col(t) * F.col("e")).alias(f"u{i}") for i, t in enumerate(terms)), *(F.sum(F.when(F.col("bin") == b, F.col("e")).otherwise(0.0)).alias(f"r{b}") for b in range(bins)))
    params = spark.createDataFrame(ready, "offset_s int, bin int, n long, v0 double, v1 double, v2 double")
    own = sum((F.when(F.col("bin") == b, F.col(f"r{b}")).otherwise(0.0) for b in range(bins)), F.lit(0.0))
    score = own / F.col("n") - sum((F.col(f"u{i}") * F.col(f"v{i}") for i in range(3)), F.lit(0.0))
    squares = by_event.join(F.broadcast(params), "offset_s").groupBy("offset_s", "bin").agg(F.sum(score * score).alias("ss"))
    for r in sorted(squares.collect(), key=lambda r: (r.offset_s, r.bin)):
        p, fit = found[r.offset_s, r.bin], fits[r.offset_s,]
        se = float(np.sqrt(stats.correction(fit.n, fit.clusters, 3) * r.ss))
        out = p["mean"] - Z90 * se > trigger or p["mean"] + Z90 * se < -trigger
        rows.append(_row("bin", r.offset_s, f"bin:{r.bin}", p.g, p.n, p["mean"], se, trigger, "flagged" if out else "not_flagged", {"price_lo": p.lo, "price_hi": p.hi}))
    return rows


def verdict(rows: list[tuple], offsets: tuple[int, ...], sample: int = SAMPLE_EVENTS) -> tuple[str, str | None]:
    """(passed, failed or insufficient_data, reason) of check 1 and its bins. Too few events at any offset outrank both; flagged bins are noted only."""
    checks = [r for r in rows if r[0] == "check1"]
    events = {k: next(r[4] for r in checks if r[1] == k) for k in offsets}
    if short := [f"{label(r[1])}" for r in checks if r[11] == "insufficient_data"]:
        out, why = "insufficient_data", f"no fit at {', '.join(dict.fromkeys(short))}"
    else:
        passed = all(r[11] == "passed" for r in checks)
        out, why = ("passed", None) if passed else ("failed", "a component's interval leaves its margin")
        if below := [f"{label(k)} ({n})" for k, n in events.items() if n < sample]:
            out, why = "insufficient_data", f"fewer than {sample} events at {', '.join(below)}; check 1 alone would say {out}"
    flagged = sum(r[11] == "flagged" for r in rows)
    note = f"{flagged} bin(s) flagged: each needs a decision record" if flagged else None
    return out, "; ".join(x for x in (why, note) if x) or None


def check(pairs: DataFrame, spec: Spec = Spec()) -> tuple[str, str | None, DataFrame]:
    """Check 1 with its bins over pairs (offset_s, event_id, p_entry, p_close): verdict, reason, and rows of RESULT."""
    rows, fitted, fits = martingale(pairs, spec.offsets_s, spec.radius, spec.sample_events)
    rows += lack_of_fit(fitted, fits, spec.bins, spec.trigger)
    return *verdict(rows, spec.offsets_s, spec.sample_events), results(pairs.sparkSession, rows)


def results(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, RESULT)


def agreement(entries: DataFrame, margin: float = AGREEMENT_MARGIN) -> stats.Fit:
    """Check 2: the regression of q_entry - p_entry on 2 p_entry - 1 over entries (entry_id, event_id, q_entry, p_entry); slope is value[1]."""
    x = entries.select("event_id", (F.col("q_entry") - F.col("p_entry")).alias("diff"), (2 * F.col("p_entry") - 1).alias("side"))
    return stats.ols_cluster(x, "diff", ["side"], "event_id")


def agreement_outliers(entries: DataFrame, threshold: float = OUTLIER) -> DataFrame:
    """The entries whose share is further from the reference than the threshold."""
    return entries.where(F.abs(F.col("q_entry") - F.col("p_entry")) > threshold).select("entry_id")


def agreement_gate(entries: DataFrame, resolved: DataFrame, margin: float = AGREEMENT_MARGIN, threshold: float = OUTLIER, most: float = MOST_VERIFIED) -> DataFrame:
    """One row: passed, slope, se, n, n_unresolved, n_unknown (resolutions of entries that are no outliers: an error), verified_rate.

    Passes if the slope's whole interval is within the margin, each outlier has a resolution, and these are not too many of all entries.
    """
    fit, out = agreement(entries, margin), agreement_outliers(entries, threshold)
    done = resolved.select("entry_id").distinct()
    n = entries.count()
    open_, unknown, known = out.join(done, "entry_id", "left_anti").count(), done.join(out, "entry_id", "left_anti").count(), done.count()
    rate = known / n if n else 0.0
    passed = not fit.reason and fit.within(1, margin) and not open_ and not unknown and rate <= most
    row = (passed, None if fit.reason else fit.value[1], None if fit.reason else fit.se[1], n, open_, unknown, rate)
    return entries.sparkSession.createDataFrame([row], "passed boolean, slope double, se double, n long, n_unresolved long, n_unknown long, verified_rate double")


def random_side(rows: DataFrame) -> DataFrame:
    """Mean of (p_close - p_entry) * d with its clustered error: a summary, never a gate. rows: event_id, p_entry, p_close, d."""
    return stats.cluster_mean(rows.select("event_id", ((F.col("p_close") - F.col("p_entry")) * F.col("d")).alias("r")), "r", "event_id", [])


def winners(settlements: DataFrame) -> DataFrame:
    """Each event's outcome that the official source settles as won, where there is exactly one. settlements: heads with source, event_id, outcome_id, result."""
    won = settlements.where((F.col("source") == facts.OFFICIAL) & (F.col("result") == "win"))
    return won.groupBy("event_id").agg(F.count_distinct("outcome_id").alias("n"), F.min("outcome_id").alias("outcome_id")).where("n = 1").drop("n")


def oracle_entries(events: DataFrame, starts: DataFrame, won: DataFrame, refs: DataFrame, settlements: DataFrame, venue: str) -> DataFrame:
    """Each event's winning outcome, or why it makes no oracle entry: event_id, outcome_id, reason.

    In order: an untrusted start, no official winner, no reference, and a venue that has not settled it, at a fair value, or otherwise.
    starts: event_id, reason (null if trusted). settlements: instrument, side, result.
    """
    x = events.select("event_id").join(starts.select("event_id", F.col("reason").alias("off"), F.lit(True).alias("seen")), "event_id", "left").join(won, "event_id", "left").withColumn("venue", F.lit(venue))
    x = identity.lookup(x, refs.select("venue", "outcome_id", "instrument", "side", "reason")).withColumnRenamed("reason", "ref")
    x = x.join(settlements.where("instrument is not null").select("instrument", "side", "result"), ["instrument", "side"], "left")
    why = F.when(F.col("seen").isNull(), "no_trusted_off").otherwise(F.coalesce(F.col("off"), ladder([
        (F.col("outcome_id").isNull(), "no_official_winner"), (F.col("ref").isNotNull(), "reference"), (F.col("result").isNull(), "venue_unsettled"),
        (F.col("result") == "fair_value", "settled_fair_value"), (F.col("result") != "win", "settlement_disagreement"),
    ])))
    return x.select("event_id", "outcome_id", F.when(why == "reference", F.col("ref")).otherwise(why).alias("reason"))


def oracle_sweep(entries: DataFrame, observed: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """Mean of p_close / p_offset - 1 of the winners at each offset and buffer, of all events and of those priced at every buffer.

    entries: rows of oracle_entries; observed: event_id, outcome_id, point (offset or buffer), seconds, p. Columns offset_s, buffer_s,
    subset, n, n_clusters, mean, se, outcome (insufficient_data for too few events).
    """
    e = entries.where("reason is null").select("event_id", "outcome_id")
    p = observed.where("p is not null").select("event_id", "outcome_id", "point", "seconds", "p")
    at = e.join(p.where("point = 'offset' and p > 0").select("event_id", "outcome_id", F.col("seconds").alias("offset_s"), F.col("p").alias("p0")), ["event_id", "outcome_id"])
    x = at.join(p.where("point = 'buffer'").select("event_id", "outcome_id", F.col("seconds").alias("buffer_s"), F.col("p").alias("p1")), ["event_id", "outcome_id"])
    x = x.select("event_id", "offset_s", "buffer_s", (F.col("p1") / F.col("p0") - 1).alias("v"))
    both = x.withColumn("subset", F.lit("all")).unionByName(stats.matched(x, "event_id", "buffer_s", len(spec.buffers_s), ["offset_s"]).withColumn("subset", F.lit("matched")))
    m = stats.cluster_mean(both, "v", "event_id", ["offset_s", "buffer_s", "subset"])
    few = F.col("n_clusters") < LEAST_CLUSTERS
    return m.select("offset_s", "buffer_s", "subset", "n", "n_clusters", F.when(~few, F.col("mean")).alias("mean"), F.when(~few, F.col("se")).alias("se"), F.when(few, "insufficient_data").alias("outcome"))


def observe(events: DataFrame, outcomes: DataFrame, starts: DataFrame, refs: DataFrame, price, venue: str, spec: Spec = Spec()) -> DataFrame:
    """The family's price of each outcome at each offset and buffer before the start: event_id, outcome_id, point, seconds, as_of_ms, p_num, p_den, p, reason.

    starts: event_id, earliest, reason; price: a function from requests (request_id, instrument, side, as_of_ms) to p_num, p_den and reason
    by request_id (see closes.candle_close and vwap_close). In order: the start's reason, the reference's, at offsets the mapping's
    unless it is admitted, the price's own.
    """
    x = events.select("event_id").join(outcomes.select("event_id", "outcome_id"), "event_id").join(starts.select("event_id", "earliest", F.col("reason").alias("off"), F.lit(True).alias("seen")), "event_id", "left")
    x = identity.lookup(x.withColumn("venue", F.lit(venue)), refs.select("venue", "outcome_id", "instrument", "side", "ineligible", "reason")).withColumnRenamed("reason", "ref")
    points = F.array(*(F.struct(F.lit(n).alias("point"), F.lit(s).alias("seconds")) for n, own in (("offset", spec.offsets_s), ("buffer", spec.buffers_s)) for s in own))
    x = x.withColumn("q", F.explode(points)).select("*", "q.*").drop("q").withColumn("as_of_ms", F.col("earliest") - 1000 * F.col("seconds"))
    barred = (F.col("point") == "offset") & F.col("ineligible").isNotNull() & ~F.coalesce(F.col("ineligible").isin(*spec.admitted), F.lit(False)) if spec.admitted else (F.col("point") == "offset") & F.col("ineligible").isNotNull()
    x = x.withColumn("why", F.coalesce(F.when(F.col("seen").isNull(), "no_trusted_off").otherwise(F.col("off")), F.col("ref"), F.when(barred, F.col("ineligible"))))
    x = x.withColumn("request_id", F.concat_ws("/", "instrument", "side", "as_of_ms"))
    got = price(x.where("why is null").select("request_id", "instrument", "side", "as_of_ms").distinct())
    out = x.join(got.select("request_id", "p_num", "p_den", F.col("reason").alias("own")), "request_id", "left")
    p = F.when(F.col("why").isNull(), F.col("p_num") / F.col("p_den"))
    return out.select("event_id", "outcome_id", "point", "seconds", "as_of_ms", "p_num", "p_den", p.alias("p"), F.coalesce("why", "own").alias("reason"))


def pairs(observed: DataFrame, homes: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """Check 1's rows: the home outcomes priced both at the offset and at the close. homes: event_id, outcome_id."""
    own = observed.where("p is not null").join(homes.select("event_id", "outcome_id"), ["event_id", "outcome_id"])
    close = own.where((F.col("point") == "buffer") & (F.col("seconds") == spec.buffer_s)).select("event_id", F.col("p").alias("p_close"))
    return own.where("point = 'offset'").select("event_id", F.col("seconds").alias("offset_s"), F.col("p").alias("p_entry")).join(close, "event_id").select("offset_s", "event_id", "p_entry", "p_close")


def spread(pairs_: DataFrame) -> DataFrame:
    """The dispersion of moves at each offset, with quantiles of the entry prices: offset_s, n, sd, p05 to p95."""
    sd = pairs_.groupBy("offset_s").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(F.col("p_close") - F.col("p_entry")).alias("sd"))
    return sd.join(stats.quantiles(pairs_, "p_entry", ["offset_s"], {f"p{q:02d}": q / 100 for q in (5, 25, 50, 75, 95)}), "offset_s")


def increments(sds: list[float]) -> list[float]:
    """Spread of the move between neighbouring offsets, from the spreads of the moves to the close, the earliest offset first; the last to the close itself."""
    after = [*sds[1:], 0.0]
    return [float(np.sqrt(max(a * a - b * b, 0.0))) for a, b in zip(sds, after, strict=True)]


def disagreement_histogram(spans: DataFrame, span: str = "span_ms") -> DataFrame:
    """How many starts' claims lie how far apart: bucket (the upper bound in seconds, null beyond the last), n."""
    s = F.col(span)
    bucket = F.when(s <= 0, F.lit(0))
    for hi in DISAGREEMENT_S:
        bucket = bucket.when(s <= 1000 * hi, F.lit(hi))
    return spans.where(s.isNotNull()).groupBy(bucket.alias("bucket_s")).agg(F.count(F.lit(1)).alias("n"))


def audits(closes_: DataFrame, observed: DataFrame, candles: DataFrame, starts: DataFrame, executions: DataFrame, sightings: DataFrame) -> DataFrame:
    """Counts that must be 0, and one that is told: audit, n.

    closes_: event_id, candle_id; observed: as_of_ms, candle_id; starts: event_id, earliest; sightings: execution_id, role, artifact, line, reconcile.
    """
    ends = candles.select("candle_id", "end_ms")
    s = sightings
    maker = s.where("role <> 'taker'").select("execution_id").distinct()
    found = {
        "close_candle_after_start": closes_.join(ends, "candle_id").join(starts.select("event_id", "earliest"), "event_id").where("end_ms > earliest"),
        "offset_candle_after_as_of": observed.join(ends, "candle_id").where("end_ms > as_of_ms"),
        "execution_of_takers_only": executions.join(maker, "execution_id", "left_anti"),
        "two_makers_of_one_row": s.where("role = 'maker'").groupBy("execution_id", "artifact", "line").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
        "stream_trade_unmatched": s.where("role = 'stream' and reconcile = 'unmatched'"),
    }
    out = None
    for name, rows in found.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("audit"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def most_common(rows: DataFrame, value: str) -> DataFrame:
    """Values by how often they occur, the most common first, ties by value: value, n, place (from 1)."""
    from pyspark.sql import Window

    c = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), value)))


def admitted(reason: Column, spec: Spec) -> Column:
    """Whether a mapping's reason does not keep it out."""
    return reason.isNull() | reason.isin(list(spec.admitted))
