"""Scoring: the start of events, closes of all references, and each entry's value against them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import american_odds, ladder, rational
from ..functions.tables import held
from . import closes, facts, identity
from .closes import LiveDef

#: Venues whose prices are references, books that are licensed, and the margin of the agreement flag (8 of 100).
REF_VENUES = ["novig", "kalshi"]
LICENSED_BOOKS = ["draftkings", "fanduel", "betmgm", "betrivers"]
OUTLIER = (8, 100)


@dataclass(frozen=True)
class Facts:
    """The tables that a run reads, all at one snapshot.

    outcomes: outcome_id, event_id. instruments: instrument, venue, native_id, operator. mappings: see identity.current_mappings. claims:
    event_id, source, kind, at_ms. ticks, evidence, gaps, levels: see closes.price_as_of. entries: entry_id, event_id, outcome_id,
    instrument, side, decision_ms. quotes: quote_id, entry_id, concept, d_num, d_den. opposite: entry_id, d_num, d_den.
    """

    outcomes: DataFrame
    instruments: DataFrame
    mappings: DataFrame
    claims: DataFrame
    ticks: DataFrame
    evidence: DataFrame
    gaps: DataFrame
    levels: DataFrame
    entries: DataFrame
    quotes: DataFrame
    opposite: DataFrame


def _sources(venue: str = "venue") -> Column:
    known = F.create_map(*(x for v, s in closes.SOURCES.items() for x in (F.lit(v), F.array(*map(F.lit, s)))))
    return F.element_at(known, F.col(venue))


def _priced(f: Facts, requests: DataFrame, defs: list[LiveDef], open_status: dict[str, str]) -> DataFrame:
    return closes.price_as_of(requests.withColumn("sources", _sources()), f.ticks, f.evidence, f.gaps, f.levels, defs, open_status)


def close_prices(f: Facts, defs: list[LiveDef], max_span_ms: int = facts.MAX_SPAN_MS, open_status: dict[str, str] = closes.OPEN_STATUS) -> DataFrame:
    """A row for each outcome, reference venue and definition: the close before the event's start, or the first reason for none.

    An untrusted start gives its own reason first, then the reference, then the book as of the cutoff (earliest start less the buffer).
    """
    starts = facts.resolve_start(f.claims, "event_id", max_span_ms).select("event_id", "earliest", F.col("reason").alias("off_reason"), F.lit(True).alias("_seen"))
    refs = identity.references(identity.current_mappings(f.mappings), f.instruments)
    wanted = f.outcomes.select("outcome_id", "event_id").withColumn("venue", F.explode(F.array(*map(F.lit, REF_VENUES))))
    x = identity.lookup(wanted, refs).join(starts, "event_id", "left")
    x = x.withColumn("off_reason", F.when(F.col("_seen").isNull(), "no_trusted_off").otherwise(F.col("off_reason"))).drop("_seen")
    named = F.array(*(F.struct(F.lit(d.name).alias("def_name"), F.lit(1000 * d.buffer_s).cast("long").alias("buffer_ms")) for d in defs))
    x = x.withColumn("d", F.explode(named)).select("*", "d.*").drop("d").withColumn("cutoff_ms", F.col("earliest") - F.col("buffer_ms"))
    x = held(x.withColumn("request_id", F.concat_ws("/", "outcome_id", "venue", "buffer_ms")))
    asked = x.where("off_reason is null and reason is null").select("request_id", "venue", "native_id", "instrument", "side", F.col("cutoff_ms").alias("as_of_ms")).distinct()
    got = _priced(f, asked, defs, open_status).withColumnRenamed("reason", "book_reason")
    out = x.join(got, ["request_id", "def_name"], "left")
    return out.select("event_id", "outcome_id", "venue", "def_name", "cutoff_ms", "instrument", "side", "mapping_id", "ineligible", F.col("reason").alias("ref_reason"), "tick_id", "p_num", "p_den", "quote_age_ms", "liveness_age_ms", "bracket_ms", "spread_e4", F.coalesce("off_reason", "reason", "book_reason").alias("reason"))


def scores(f: Facts, closes_: DataFrame, defs: list[LiveDef], open_status: dict[str, str] = closes.OPEN_STATUS) -> DataFrame:
    """A row for each entry, reference venue and definition: exact values against the close, and the cohort exclusions beside them.

    ev is p_close * d - 1, null_ev the same at the reference's price when the entry was decided, residual (p_close - p_ref) * d. outlier
    says whether the entry's two-way share and the reference are more than 8 points apart; agreement_reason why it is unknown. Reasons
    are listed in order without repeats; no row is dropped for one.
    """
    heads = identity.current_mappings(f.mappings)
    refs = identity.references(heads, f.instruments)
    quote = f.quotes.where("concept = 'decision_quote'").select("entry_id", "quote_id", "d_num", "d_den")
    e = f.entries.join(quote, "entry_id").join(f.instruments.select("instrument", F.col("venue").alias("entry_venue"), "operator"), "instrument")
    e = e.join(f.opposite.select("entry_id", F.col("d_num").alias("o_num"), F.col("d_den").alias("o_den")), "entry_id", "left")
    m = heads.select("instrument", "side", F.col("outcome_id").alias("_o"), F.col("polarity").alias("_p"), F.col("ineligible").alias("_why"))
    e = e.join(m, ["instrument", "side"], "left")
    gone = F.col("_o").isNull() | ((F.col("_p") == "direct") != (F.col("_o") == F.col("outcome_id")))
    unlicensed = (F.col("entry_venue") == "odds_api") & ~F.coalesce(F.col("operator").isin(LICENSED_BOOKS), F.lit(False))
    e = e.select("entry_id", "quote_id", "event_id", "outcome_id", "decision_ms", "d_num", "d_den", "o_num", "o_den", F.when(gone, "entry_mapping_superseded").otherwise(F.col("_why")).alias("mapping_why"), F.when(unlicensed, "unlicensed_book").alias("book_why"))

    e = e.withColumn("venue", F.explode(F.array(*map(F.lit, REF_VENUES))))
    r = identity.lookup(e.select("venue", "outcome_id").distinct(), refs).withColumnRenamed("reason", "ref_reason")
    e = held(e.join(r, ["venue", "outcome_id"]).withColumn("request_id", F.concat_ws("/", "entry_id", "venue")))
    asked = e.where("ref_reason is null").select("request_id", "venue", "native_id", "instrument", "side", F.col("decision_ms").alias("as_of_ms"))
    at = held(_priced(f, asked, defs, open_status)).select("request_id", "def_name", F.col("p_num").alias("r_num"), F.col("p_den").alias("r_den"), F.col("tick_id").alias("ref_tick_id"), F.col("reason").alias("at_reason"))
    c = closes_.select("outcome_id", "venue", "def_name", "cutoff_ms", F.col("p_num").alias("c_num"), F.col("p_den").alias("c_den"), F.col("reason").alias("close_reason"))
    x = e.drop("instrument", "side").join(c, ["outcome_id", "venue"]).join(at, ["request_id", "def_name"], "left")
    wide = lambda n: F.col(n).cast("decimal(38,0)")
    d, dd, cn, cd, rn, rd, on, od = map(wide, ("d_num", "d_den", "c_num", "c_den", "r_num", "r_den", "o_num", "o_den"))
    late = ~F.coalesce(F.col("decision_ms") < F.col("cutoff_ms"), F.lit(False))
    why = F.array(F.col("mapping_why"), F.col("book_why"), F.coalesce("ref_reason", "ineligible"), F.when(late, "entry_after_cutoff"), F.col("close_reason"))
    # q = d_other / (d + d_other), over the common denominator of both odds.
    q_num, q_den = on * dd, d * od + on * dd
    apart = F.abs(q_num * rd - rn * q_den) * OUTLIER[1] > OUTLIER[0] * q_den * rd
    missing = ladder([(F.col("o_num").isNull(), "no_opposite_quote"), (F.col("r_num").isNull(), "no_reference_at_entry")])
    # Out of a generator, so that each fraction is reduced once and not at each mention.
    made = F.struct(rational(cn * d - cd * dd, cd * dd).alias("ev"), rational(rn * d - rd * dd, rd * dd).alias("null_ev"), rational((cn * rd - rn * cd) * d, cd * rd * dd).alias("residual"), rational(q_num, q_den).alias("q"))
    x = x.select("*", F.explode(F.array(made)).alias("made")).select("*", "made.*").drop("made")
    return x.select(
        "entry_id", "venue", "def_name", "quote_id", "d_num", "d_den", F.col("c_num").alias("p_close_num"), F.col("c_den").alias("p_close_den"), F.col("r_num").alias("p_ref_num"), F.col("r_den").alias("p_ref_den"),
        "ref_tick_id", F.coalesce("ref_reason", "at_reason").alias("ref_entry_reason"), *(F.col(f"{k}.{s}").alias(f"{k}_{s}") for k in ("ev", "null_ev", "residual", "q") for s in ("num", "den")),
        F.when(missing.isNull(), apart.cast("int")).alias("outlier"), missing.alias("agreement_reason"), F.array_distinct(F.array_compact(why)).alias("reasons"),
    )


def decision_quotes(signals: DataFrame, quotes: DataFrame) -> DataFrame:
    """The quote on which each signal is entered, with the other side's if the same response holds it exactly once.

    signals: signal_id, vendor_event, operator, name, other_name, decision_ms; quotes: response_id, item, recv_ms, vendor_event, bookmaker,
    market, outcome_name, price_american, book_update_ms. The quote is the latest received by the decision, the first read one on ties.
    d_num / d_den are its exact decimal odds, null where it has none. A signal without a quote has no row.
    """
    h2h = quotes.where("market = 'h2h'").withColumnRenamed("bookmaker", "operator")
    mine = signals.join(h2h, ["vendor_event", "operator"]).where("outcome_name = name and recv_ms <= decision_ms")
    pick = F.struct("response_id", "recv_ms", "price_american", "book_update_ms")
    got = mine.groupBy("signal_id", "vendor_event", "operator", "other_name").agg(F.min_by(pick, F.struct(-F.col("recv_ms"), "response_id", "item")).alias("q")).select("signal_id", "vendor_event", "operator", F.col("other_name").alias("outcome_name"), "q.*")
    other = h2h.select("response_id", "vendor_event", "operator", "outcome_name", F.col("price_american").alias("o_american"), F.col("book_update_ms").alias("o_update_ms"))
    opposite = got.join(other, ["response_id", "vendor_event", "operator", "outcome_name"]).groupBy("signal_id").agg(F.count(F.lit(1)).alias("n"), F.first("o_american").alias("o_american"), F.first("o_update_ms").alias("o_update_ms")).where("n = 1").drop("n")
    x = got.join(opposite, "signal_id", "left").withColumns({"d": american_odds(F.col("price_american")), "o": american_odds(F.col("o_american"))})
    return x.select("signal_id", "response_id", "recv_ms", "price_american", F.col("d.num").alias("d_num"), F.col("d.den").alias("d_den"), "book_update_ms", "o_american", F.col("o.num").alias("o_num"), F.col("o.den").alias("o_den"))
