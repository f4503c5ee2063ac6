"""Rules across tables: each names the rows that break it, which must be none before a batch is committed.

Every rule takes the tables by name and gives the ids of its own table's rows. Rules are anti-joins on keys, so each is one equi-join a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]
RULES: dict[str, Callable[[Tables], DataFrame]] = {}


def rule(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    RULES[f.__name__] = f
    return f


def _no(rows: DataFrame, key: str, partners: DataFrame, on: dict[str, str], test: Column | None = None) -> DataFrame:
    """The ids of rows that have no partner with equal keys that passes the test. Columns of partners have p_ before their names in the test."""
    p = partners.select(*(F.col(c).alias(f"p_{c}") for c in partners.columns))
    cond = F.lit(True) if test is None else test
    for mine, theirs in on.items():
        cond = (F.col(mine) == F.col(f"p_{theirs}")) & cond
    return rows.join(p, cond, "left_anti").select(F.col(key).alias("id"))


def _breaks(rows: DataFrame, key: str, test: Column) -> DataFrame:
    return rows.where(test).select(F.col(key).alias("id"))


@rule
def tick_level_within_tick(t: Tables) -> DataFrame:
    """A level's rank is below the levels that its tick declares for its side."""
    x = t["tick_level"].join(t["tick"].select("tick_id", "levels0", "levels1"), "tick_id")
    return _breaks(x, "tick_id", F.col("rank") >= F.when(F.col("side") == 0, F.col("levels0")).otherwise(F.col("levels1")))


@rule
def mapping_supersedes_same_side(t: Tables) -> DataFrame:
    """A mapping supersedes one of the same instrument and side."""
    m = t["mapping"]
    return _no(m.where("supersedes is not null"), "mapping_id", m.select("mapping_id", "instrument", "side"), {"supersedes": "mapping_id", "instrument": "instrument", "side": "side"})


@rule
def settlement_supersedes_same_subject(t: Tables) -> DataFrame:
    """A settlement supersedes one of the same source and subject."""
    s = t["settlement"]
    return _no(s.where("supersedes is not null"), "settlement_id", s.select("settlement_id", "source", "subject"), {"supersedes": "settlement_id", "source": "source", "subject": "subject"})


@rule
def entry_matches_mapping(t: Tables) -> DataFrame:
    """An entry's mapping is of its instrument and side, not rejected, and its outcome is the mapping's or, for a complement, the event's other one."""
    o = t["outcome"].select("outcome_id", "event_id")
    m = t["mapping"].where("status <> 'rejected'").join(o, "outcome_id").select("mapping_id", "instrument", "side", "outcome_id", "polarity", "event_id")
    e = t["entry"].join(o.select("outcome_id", F.col("event_id").alias("own_event")), "outcome_id", "left")
    fits = ((F.col("p_polarity") == "direct") & (F.col("p_outcome_id") == F.col("outcome_id"))) | ((F.col("p_polarity") == "complement") & (F.col("p_outcome_id") != F.col("outcome_id")))
    return _no(e, "entry_id", m, {"mapping_id": "mapping_id", "instrument": "instrument", "side": "side", "event_id": "event_id"}, fits & (F.col("own_event") == F.col("event_id")))


@rule
def entry_after_signal(t: Tables) -> DataFrame:
    """An entry does not precede its signal and names the same outcome and event."""
    return _no(t["entry"].where("signal_id is not null"), "entry_id", t["signal"], {"signal_id": "signal_id", "outcome_id": "outcome_id", "event_id": "event_id"}, F.col("p_emitted_ms") <= F.col("decision_ms"))


@rule
def quote_known_at_decision(t: Tables) -> DataFrame:
    """Observed and decision quotes were received by the decision."""
    x = t["quote"].where("concept in ('observed_quote', 'decision_quote')").join(t["entry"].select("entry_id", "decision_ms"), "entry_id")
    return _breaks(x, "quote_id", F.col("observed_ms") > F.col("decision_ms"))


@rule
def close_before_start(t: Tables) -> DataFrame:
    """A priced close's cutoff is before the earliest start; a historical one may sit on it."""
    c = t["close"].where("p_num is not null").join(t["off"].select("off_id", "earliest_ms"), "off_id", "left").join(t["definition"], "def_id", "left")
    late = F.col("earliest_ms").isNull() | (F.col("cutoff_ms") > F.col("earliest_ms")) | ((F.col("cutoff_ms") == F.col("earliest_ms")) & (F.col("family") != "close_hist"))
    return _breaks(c, "close_id", late)


@rule
def close_book_is_reference(t: Tables) -> DataFrame:
    """A close's book is a tick of the reference venue, seen when the close says, by its cutoff."""
    ticks = t["tick"].join(t["instrument"].select("instrument", "venue"), "instrument").select("tick_id", "venue", "observed_ms")
    return _no(t["close"].where("tick_id is not null"), "close_id", ticks, {"tick_id": "tick_id", "venue": "venue", "book_observed_ms": "observed_ms"}, F.col("p_observed_ms") <= F.col("cutoff_ms"))


@rule
def score_matches_close(t: Tables) -> DataFrame:
    """A score's close has its venue, definition and run's snapshot and its entry's outcome; its quote is its entry's."""
    x = t["score"].join(t["run"], "run_id", "left").join(t["entry"].select("entry_id", "outcome_id"), "entry_id", "left").join(t["quote"].select("quote_id", F.col("entry_id").alias("quoted")), "quote_id", "left")
    return _no(x, "score_id", t["close"].select("close_id", "venue", "def_id", "outcome_id", "snapshot_id"), {c: c for c in ("close_id", "venue", "def_id", "outcome_id", "snapshot_id")}, F.col("quoted") == F.col("entry_id"))


@rule
def score_reference_known(t: Tables) -> DataFrame:
    """The reference's book at the entry is the reference venue's, received by the decision."""
    ticks = t["tick"].join(t["instrument"].select("instrument", "venue"), "instrument").select("tick_id", "venue", "observed_ms")
    x = t["score"].where("ref_tick_id is not null").join(t["entry"].select("entry_id", "decision_ms"), "entry_id", "left")
    return _no(x, "score_id", ticks, {"ref_tick_id": "tick_id", "venue": "venue"}, F.col("p_observed_ms") <= F.col("decision_ms"))


@rule
def close_not_legacy(t: Tables) -> DataFrame:
    """New closes are never marked as legacy."""
    return _breaks(t["close"], "close_id", F.col("legacy") != 0)


@rule
def score_not_legacy(t: Tables) -> DataFrame:
    """New scores are never marked as legacy."""
    return _breaks(t["score"], "score_id", F.col("legacy") != 0)


@rule
def opposite_same_observation(t: Tables) -> DataFrame:
    """An opposite quote is the other side of the decision quote's frame and time."""
    q = t["quote"].where("concept = 'decision_quote'").join(t["entry"].select("entry_id", "side"), "entry_id").select("entry_id", "side", "artifact", "line", "observed_ms")
    return _no(t["opposite"], "entry_id", q, {c: c for c in ("entry_id", "artifact", "line", "observed_ms")}, F.col("p_side") != F.col("side"))


@rule
def score_agreement_consistent(t: Tables) -> DataFrame:
    """The share, the outlier flag and its reason fit one another."""
    q, d, o, why = F.col("q_num"), F.col("q_den"), F.col("outlier"), F.col("agreement_reason")
    share = (q.isNull() == d.isNull()) & (d.isNull() | ((d > 0) & q.between(0, d)))
    flag = (o.isNull() == (q.isNull() | F.col("p_ref_num").isNull())) & (o.isNull() != why.isNull()) & (o.isNull() | o.isin(0, 1))
    return _breaks(t["score"].where("legacy = 0"), "score_id", ~F.coalesce(share & flag, F.lit(False)))


@rule
def sighting_same_instrument(t: Tables) -> DataFrame:
    """A sighting is on its execution's instrument."""
    return _no(t["sighting"].where("execution_id is not null"), "sighting_id", t["execution"], {"execution_id": "execution_id", "instrument": "instrument"})


@rule
def settlement_outcome_of_event(t: Tables) -> DataFrame:
    """A settlement's outcome is of its event."""
    return _no(t["settlement"].where("outcome_id is not null"), "settlement_id", t["outcome"], {"outcome_id": "outcome_id", "event_id": "event_id"})


def _kinds() -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in ("tick_id", "candle_id", "vwap_hi_ms")), F.lit(0))


@rule
def close_lineage_complete(t: Tables) -> DataFrame:
    """A trade window has all four columns or none; a candle has its flag."""
    n = sum((F.col(c).isNull().cast("int") for c in ("vwap_lo_ms", "vwap_hi_ms", "vwap_executions", "vwap_payout_cents")), F.lit(0))
    return _breaks(t["close"], "close_id", ~n.isin(0, 4) | (F.col("candle_id").isNull() != F.col("candle_active").isNull()))


@rule
def close_lineage_one_kind(t: Tables) -> DataFrame:
    """A close rests on one kind of record at most, a priced one on exactly one."""
    return _breaks(t["close"].where("legacy = 0"), "close_id", (_kinds() > 1) | (F.col("p_num").isNotNull() & (_kinds() == 0)))


@rule
def close_lineage_fits_family(t: Tables) -> DataFrame:
    """Ticks are for live closes, candles and trade windows for historical ones."""
    c = t["close"].join(t["definition"], "def_id", "left")
    live, hist = F.col("tick_id").isNotNull(), F.col("candle_id").isNotNull() | F.col("vwap_hi_ms").isNotNull()
    return _breaks(c, "close_id", (live & (F.col("family") != "close_live")) | (hist & (F.col("family") != "close_hist")))


@rule
def close_candle_before_cutoff(t: Tables) -> DataFrame:
    """A close's candle is the reference venue's and ends by the cutoff."""
    k = t["candle"].join(t["instrument"].select("instrument", "venue"), "instrument").select("candle_id", "venue", "end_ms")
    return _no(t["close"].where("candle_id is not null"), "close_id", k, {"candle_id": "candle_id", "venue": "venue"}, F.col("p_end_ms") <= F.col("cutoff_ms"))


@rule
def close_window_before_cutoff(t: Tables) -> DataFrame:
    """A trade window is not empty and ends by the cutoff."""
    return _breaks(t["close"].where("vwap_hi_ms is not null"), "close_id", ~((F.col("vwap_lo_ms") < F.col("vwap_hi_ms")) & (F.col("vwap_hi_ms") <= F.col("cutoff_ms"))))


@rule
def observation_pairs_its_close(t: Tables) -> DataFrame:
    """A calibration observation is the offset before its run's close of the same outcome."""
    c = t["close"].join(t["off"].select("off_id", "event_id", "earliest_ms"), "off_id").select("close_id", "outcome_id", "venue", "def_id", "snapshot_id", "event_id", "earliest_ms", "cutoff_ms")
    x = t["observation"].join(t["calibration"].select("run_id", "venue", "def_id", "snapshot_id"), "run_id", "left")
    at = F.col("as_of_ms").isNull() | ((F.col("as_of_ms") == F.col("p_earliest_ms") - F.col("offset_s") * 1000) & (F.col("as_of_ms") < F.col("p_cutoff_ms")))
    return _no(x, "observation_id", c, {k: k for k in ("close_id", "outcome_id", "venue", "def_id", "snapshot_id", "event_id")}, at)


@rule
def observation_candle_by_as_of(t: Tables) -> DataFrame:
    """An observation's candle is the run's venue's and ends by the as-of time."""
    k = t["candle"].join(t["instrument"].select("instrument", "venue"), "instrument").select("candle_id", "venue", "end_ms")
    x = t["observation"].where("candle_id is not null").join(t["calibration"].select("run_id", "venue"), "run_id", "left")
    return _no(x, "observation_id", k, {"candle_id": "candle_id", "venue": "venue"}, F.col("p_end_ms") <= F.col("as_of_ms"))


@rule
def result_fits_mode(t: Tables) -> DataFrame:
    """A dispersion run reports dispersion alone, a check run none."""
    x = t["result"].join(t["calibration"].select("run_id", "mode"), "run_id")
    return _breaks(x, "result_id", (F.col("kind") == "dispersion") != (F.col("mode") == "dispersion"))


def broken(tables: Tables, names: list[str] | None = None) -> DataFrame:
    """How many rows break each rule: rule, n. A batch may be committed only if all are 0."""
    out = None
    for name in names or list(RULES):
        one = RULES[name](tables).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def applied_versions(applied: DataFrame, files: DataFrame) -> DataFrame:
    """Schema versions (version, sha256) that are there against the files (version, name, sha256) that should be: version, action apply or done, or what is wrong.

    Versions have no gaps, an applied one is never edited, and none is unknown.
    """
    x = files.join(applied.select("version", F.col("sha256").alias("_done")), "version", "full")
    before = F.lag("version").over(Window.partitionBy(F.lit(0)).orderBy("version"))  # as few rows as there are versions
    action = F.when(F.col("sha256").isNull(), "unknown").when(F.col("version") != F.coalesce(before, F.lit(0)) + 1, "gap").when(F.col("_done").isNull(), "apply").when(F.col("_done") != F.col("sha256"), "edited").otherwise("done")
    return x.withColumn("action", action).select("version", "name", "action")


def rebuilt(rows: DataFrame, schema: dict[str, str], mark: str) -> DataFrame:
    """rows of an older layout in a new one: columns by name and type, missing ones null, and mark set to 1 on all of them."""
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in schema.items()), F.lit(1).alias(mark))
