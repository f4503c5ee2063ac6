"""Registered queries of the integrity rules: the rows that break each, on tables that break all of them, with twins written from the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity
from .adapters import read
from .queries import ORACLE, QUERIES

N, C, BASE = "o_orderkey", "o_custkey", "1700000000000"
EVENT = f"{C} - {C} % 2"
VENUE = f"CASE WHEN {N} % 2 = 0 THEN 'novig' ELSE 'kalshi' END"
#: Tables for the rules: source, columns by expressions that both engines read alike, and rows.
LEDGER: dict[str, tuple[str, dict[str, str], str]] = {
    "outcome": ("customer", {"outcome_id": "c_custkey", "event_id": "c_custkey - c_custkey % 2"}, "true"),
    "instrument": ("supplier", {"instrument": "s_suppkey", "venue": "CASE s_suppkey % 3 WHEN 0 THEN 'novig' WHEN 1 THEN 'kalshi' ELSE 'odds_api' END"}, "true"),
    "mapping": ("orders", {"mapping_id": N, "instrument": f"{N} % 10 + 1", "side": f"{N} % 2", "outcome_id": C, "polarity": f"CASE WHEN {N} % 4 = 1 THEN 'complement' ELSE 'direct' END", "status": "CASE WHEN o_orderpriority LIKE '1%' THEN 'rejected' ELSE 'exact' END", "supersedes": f"CASE WHEN {N} % 3 = 0 THEN {N} - {N} % 9 - 1 END"}, "true"),
    "signal": ("orders", {"signal_id": N, "event_id": EVENT, "outcome_id": C, "emitted_ms": f"{BASE} + {N} * 10"}, "true"),
    "entry": ("orders", {"entry_id": N, "signal_id": f"CASE WHEN {N} % 5 <> 0 THEN {N} END", "event_id": EVENT, "outcome_id": f"CASE WHEN {N} % 6 = 0 THEN {C} + 1 ELSE {C} END", "instrument": f"{N} % 10 + 1", "side": f"{N} % 2", "mapping_id": f"CASE WHEN {N} % 8 = 0 THEN {N} + 1 ELSE {N} END", "decision_ms": f"{BASE} + {N} * 10 + ({N} % 7 - 1) * 1000"}, "true"),
    "quote": ("orders", {"quote_id": N, "entry_id": N, "concept": f"CASE WHEN {N} % 3 <> 0 THEN 'decision_quote' ELSE 'execution_assumption' END", "observed_ms": f"{BASE} + {N} * 10 + ({N} % 4 + 1) * 900", "artifact": f"{N} % 11", "line": f"{N} % 13"}, "true"),
    "opposite": ("orders", {"entry_id": N, "side": f"CASE WHEN {N} % 9 = 0 THEN {N} % 2 ELSE 1 - {N} % 2 END", "artifact": f"CASE WHEN {N} % 12 = 0 THEN 99 ELSE {N} % 11 END", "line": f"{N} % 13", "observed_ms": f"{BASE} + {N} * 10 + ({N} % 4 + 1) * 900"}, "true"),
    "off": ("customer", {"off_id": "c_custkey", "event_id": "c_custkey - c_custkey % 2", "earliest_ms": f"CASE WHEN c_custkey % 17 <> 0 THEN {BASE} + c_custkey * 1000 END"}, "true"),
    "definition": ("nation", {"def_id": "n_nationkey", "family": "CASE WHEN n_nationkey < 2 THEN 'close_live' ELSE 'close_hist' END"}, "n_nationkey < 4"),
    "tick": ("orders", {"tick_id": N, "instrument": f"{N} % 10 + 1", "observed_ms": f"{BASE} + {N} * 10", "levels0": f"1 + {N} % 4", "levels1": f"2 + {N} % 3"}, "true"),
    "tick_level": ("lineitem", {"tick_id": "l_orderkey", "side": "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END", "rank": "l_linenumber - 1"}, "true"),
    "candle": ("orders", {"candle_id": N, "instrument": f"{N} % 10 + 1", "end_ms": f"{BASE} + {N} * 10 + 5"}, "true"),
    "close": ("orders", {
        "close_id": N, "snapshot_id": f"{N} % 3", "def_id": f"{N} % 4", "off_id": C, "outcome_id": C, "venue": VENUE, "cutoff_ms": f"{BASE} + {C} * 1000 - ({N} % 5 - 1) * 30000", "p_num": f"CASE WHEN {N} % 7 <> 0 THEN 1 END",
        "tick_id": f"CASE WHEN {N} % 4 < 2 AND {N} % 10 <> 3 OR {N} % 41 = 0 THEN {N} END", "book_observed_ms": f"{BASE} + {N} * 10 + CASE WHEN {N} % 19 = 0 THEN 1 ELSE 0 END", "candle_id": f"CASE WHEN {N} % 4 = 2 OR {N} % 23 = 0 THEN {N} END",
        "candle_active": f"CASE WHEN ({N} % 4 = 2 OR {N} % 23 = 0) AND {N} % 29 <> 0 THEN 1 END", "vwap_lo_ms": f"CASE WHEN {N} % 4 = 3 THEN {BASE} + {C} * 1000 - 600000 END", "vwap_hi_ms": f"CASE WHEN {N} % 4 = 3 THEN {BASE} + {C} * 1000 END",
        "vwap_executions": f"CASE WHEN {N} % 4 = 3 AND {N} % 43 <> 0 THEN 5 END", "vwap_payout_cents": f"CASE WHEN {N} % 4 = 3 THEN 100 END", "legacy": f"CASE WHEN {N} % 31 = 0 THEN 1 ELSE 0 END",
    }, "true"),
    "run": ("nation", {"run_id": "n_nationkey", "snapshot_id": "n_nationkey"}, "n_nationkey < 3"),
    "score": ("orders", {
        "score_id": N, "run_id": f"({N} + CASE WHEN {N} % 14 = 0 THEN 1 ELSE 0 END) % 3", "entry_id": N, "close_id": N, "quote_id": f"CASE WHEN {N} % 16 = 0 THEN {N} + 1 ELSE {N} END", "venue": f"CASE WHEN {N} % 18 = 0 THEN 'kalshi' ELSE {VENUE} END",
        "def_id": f"({N} + CASE WHEN {N} % 21 = 0 THEN 1 ELSE 0 END) % 4", "ref_tick_id": f"CASE WHEN {N} % 2 = 0 THEN {N} END", "q_num": f"CASE WHEN {N} % 6 <> 0 THEN {N} % 6 END", "q_den": f"CASE WHEN {N} % 6 <> 0 OR {N} % 45 = 0 THEN 4 + {N} % 2 END",
        "p_ref_num": f"CASE WHEN {N} % 4 <> 0 THEN 1 END", "outlier": f"CASE WHEN {N} % 6 <> 0 AND {N} % 4 <> 0 OR {N} % 25 = 0 THEN {N} % 2 END", "agreement_reason": f"CASE WHEN NOT ({N} % 6 <> 0 AND {N} % 4 <> 0) AND {N} % 27 <> 0 THEN 'no_opposite_quote' END", "legacy": f"CASE WHEN {N} % 47 = 0 THEN 1 ELSE 0 END",
    }, "true"),
    "execution": ("orders", {"execution_id": N, "instrument": f"{N} % 10 + 1"}, "true"),
    "sighting": ("lineitem", {"sighting_id": "l_orderkey * 10 + l_linenumber", "execution_id": "CASE WHEN l_linenumber <> 7 THEN l_orderkey END", "instrument": "(l_orderkey + CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END) % 10 + 1"}, "true"),
    "settlement": ("orders", {"settlement_id": N, "source": f"CASE WHEN {N} % 2 = 0 THEN 'a' ELSE 'b' END", "subject": f"{C} % 5", "supersedes": f"CASE WHEN {N} % 3 = 0 THEN {N} - 2 END", "event_id": f"{C} - {C} % 2 + CASE WHEN {N} % 33 = 0 THEN 2 ELSE 0 END", "outcome_id": f"CASE WHEN {N} % 4 <> 0 THEN {C} END"}, "true"),
    "calibration": ("nation", {"run_id": "n_nationkey", "snapshot_id": "n_nationkey % 3", "def_id": "n_nationkey", "venue": "'kalshi'", "mode": "CASE WHEN n_nationkey = 3 THEN 'dispersion' ELSE 'check' END"}, "n_nationkey < 4"),
    "observation": ("orders", {"observation_id": N, "run_id": f"{N} % 4", "event_id": EVENT, "outcome_id": C, "close_id": N, "offset_s": f"{N} % 5 * 900", "as_of_ms": f"CASE WHEN {N} % 8 <> 0 THEN {BASE} + {C} * 1000 - {N} % 5 * 900000 END", "candle_id": f"CASE WHEN {N} % 3 = 0 THEN {N} END"}, "true"),
    "result": ("orders", {"result_id": N, "run_id": f"{N} % 4", "kind": f"CASE WHEN {N} % 4 = 3 OR {N} % 37 = 0 THEN 'dispersion' ELSE 'check1' END"}, "true"),
}

TICKS = "tick t JOIN instrument v USING (instrument)"
KINDS = "(c.tick_id IS NOT NULL)::INT + (c.candle_id IS NOT NULL)::INT + (c.vwap_hi_ms IS NOT NULL)::INT"
#: The rules in SQL.
TWINS = {
    "tick_level_within_tick": "SELECT l.tick_id AS id FROM tick_level l JOIN tick t USING (tick_id) WHERE l.rank >= CASE l.side WHEN 0 THEN t.levels0 ELSE t.levels1 END",
    "mapping_supersedes_same_side": "SELECT n.mapping_id AS id FROM mapping n WHERE n.supersedes IS NOT NULL AND NOT EXISTS (SELECT 1 FROM mapping m WHERE m.mapping_id = n.supersedes AND m.instrument = n.instrument AND m.side = n.side)",
    "settlement_supersedes_same_subject": "SELECT n.settlement_id AS id FROM settlement n WHERE n.supersedes IS NOT NULL AND NOT EXISTS (SELECT 1 FROM settlement s WHERE s.settlement_id = n.supersedes AND s.source = n.source AND s.subject = n.subject)",
    "entry_matches_mapping": "SELECT e.entry_id AS id FROM entry e WHERE NOT EXISTS (SELECT 1 FROM mapping m JOIN outcome mo ON mo.outcome_id = m.outcome_id JOIN outcome eo ON eo.outcome_id = e.outcome_id WHERE m.mapping_id = e.mapping_id AND m.instrument = e.instrument AND m.side = e.side AND m.status <> 'rejected' AND mo.event_id = e.event_id AND eo.event_id = e.event_id AND (m.polarity = 'direct' AND m.outcome_id = e.outcome_id OR m.polarity = 'complement' AND m.outcome_id <> e.outcome_id))",
    "entry_after_signal": "SELECT e.entry_id AS id FROM entry e WHERE e.signal_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM signal s WHERE s.signal_id = e.signal_id AND s.emitted_ms <= e.decision_ms AND s.outcome_id = e.outcome_id AND s.event_id = e.event_id)",
    "quote_known_at_decision": "SELECT q.quote_id AS id FROM quote q WHERE q.concept IN ('observed_quote', 'decision_quote') AND q.observed_ms > (SELECT decision_ms FROM entry e WHERE e.entry_id = q.entry_id)",
    "close_before_start": "SELECT c.close_id AS id FROM close c LEFT JOIN off o USING (off_id) LEFT JOIN definition d USING (def_id) WHERE c.p_num IS NOT NULL AND (o.earliest_ms IS NULL OR c.cutoff_ms > o.earliest_ms OR c.cutoff_ms = o.earliest_ms AND d.family <> 'close_hist')",
    "close_book_is_reference": f"SELECT c.close_id AS id FROM close c WHERE c.tick_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {TICKS} WHERE t.tick_id = c.tick_id AND v.venue = c.venue AND t.observed_ms = c.book_observed_ms AND t.observed_ms <= c.cutoff_ms)",
    "score_matches_close": "SELECT s.score_id AS id FROM score s WHERE NOT EXISTS (SELECT 1 FROM close c JOIN run r ON r.run_id = s.run_id JOIN entry e ON e.entry_id = s.entry_id JOIN quote q ON q.quote_id = s.quote_id WHERE c.close_id = s.close_id AND c.venue = s.venue AND c.def_id = s.def_id AND c.outcome_id = e.outcome_id AND c.snapshot_id = r.snapshot_id AND q.entry_id = s.entry_id)",
    "score_reference_known": f"SELECT s.score_id AS id FROM score s WHERE s.ref_tick_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {TICKS} JOIN entry e ON e.entry_id = s.entry_id WHERE t.tick_id = s.ref_tick_id AND v.venue = s.venue AND t.observed_ms <= e.decision_ms)",
    "close_not_legacy": "SELECT close_id AS id FROM close WHERE legacy <> 0",
    "score_not_legacy": "SELECT score_id AS id FROM score WHERE legacy <> 0",
    "opposite_same_observation": "SELECT p.entry_id AS id FROM opposite p WHERE NOT EXISTS (SELECT 1 FROM entry e JOIN quote q ON q.entry_id = e.entry_id AND q.concept = 'decision_quote' WHERE e.entry_id = p.entry_id AND e.side <> p.side AND q.artifact = p.artifact AND q.line = p.line AND q.observed_ms = p.observed_ms)",
    "score_agreement_consistent": "SELECT score_id AS id FROM score WHERE legacy = 0 AND NOT coalesce((q_num IS NULL) = (q_den IS NULL) AND (q_den IS NULL OR q_den > 0 AND q_num BETWEEN 0 AND q_den) AND (outlier IS NULL) = (q_num IS NULL OR p_ref_num IS NULL) AND (outlier IS NULL) <> (agreement_reason IS NULL) AND (outlier IS NULL OR outlier IN (0, 1)), false)",
    "sighting_same_instrument": "SELECT s.sighting_id AS id FROM sighting s WHERE s.execution_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM execution x WHERE x.execution_id = s.execution_id AND x.instrument = s.instrument)",
    "settlement_outcome_of_event": "SELECT s.settlement_id AS id FROM settlement s WHERE s.outcome_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM outcome o WHERE o.outcome_id = s.outcome_id AND o.event_id = s.event_id)",
    "close_lineage_complete": "SELECT close_id AS id FROM close WHERE ((vwap_lo_ms IS NULL)::INT + (vwap_hi_ms IS NULL)::INT + (vwap_executions IS NULL)::INT + (vwap_payout_cents IS NULL)::INT) NOT IN (0, 4) OR (candle_id IS NULL) <> (candle_active IS NULL)",
    "close_lineage_one_kind": f"SELECT close_id AS id FROM close c WHERE legacy = 0 AND ({KINDS} > 1 OR p_num IS NOT NULL AND {KINDS} = 0)",
    "close_lineage_fits_family": "SELECT close_id AS id FROM close c JOIN definition d USING (def_id) WHERE tick_id IS NOT NULL AND family <> 'close_live' OR (candle_id IS NOT NULL OR vwap_hi_ms IS NOT NULL) AND family <> 'close_hist'",
    "close_candle_before_cutoff": "SELECT c.close_id AS id FROM close c WHERE c.candle_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM candle k JOIN instrument v USING (instrument) WHERE k.candle_id = c.candle_id AND v.venue = c.venue AND k.end_ms <= c.cutoff_ms)",
    "close_window_before_cutoff": "SELECT close_id AS id FROM close WHERE vwap_hi_ms IS NOT NULL AND NOT (vwap_lo_ms < vwap_hi_ms AND vwap_hi_ms <= cutoff_ms)",
    "observation_pairs_its_close": "SELECT b.observation_id AS id FROM observation b WHERE NOT EXISTS (SELECT 1 FROM close c JOIN calibration r ON r.run_id = b.run_id JOIN off o USING (off_id) WHERE c.close_id = b.close_id AND c.outcome_id = b.outcome_id AND c.venue = r.venue AND c.def_id = r.def_id AND c.snapshot_id = r.snapshot_id AND o.event_id = b.event_id AND (b.as_of_ms IS NULL OR b.as_of_ms = o.earliest_ms - b.offset_s * 1000 AND b.as_of_ms < c.cutoff_ms))",
    "observation_candle_by_as_of": "SELECT b.observation_id AS id FROM observation b WHERE b.candle_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM candle k JOIN instrument v USING (instrument) JOIN calibration r ON r.run_id = b.run_id WHERE k.candle_id = b.candle_id AND v.venue = r.venue AND k.end_ms <= b.as_of_ms)",
    "result_fits_mode": "SELECT x.result_id AS id FROM result x JOIN calibration r USING (run_id) WHERE (x.kind = 'dispersion') <> (r.mode = 'dispersion')",
}


def ledger(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {name: read(spark, d, source).where(rows).selectExpr(*(f"{e} AS {c}" for c, e in columns.items())) for name, (source, columns, rows) in LEDGER.items()}


def _with() -> str:
    return "WITH " + ", ".join(f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source} WHERE {rows})" for name, (source, columns, rows) in LEDGER.items())


def _query(name: str):
    return lambda spark, d: integrity.RULES[name](ledger(spark, d)).select(F.col("id").cast("long"))


for _name, _twin in TWINS.items():
    QUERIES[f"rule_{_name}"] = _query(_name)
    ORACLE[f"rule_{_name}"] = f"{_with()} SELECT CAST(id AS BIGINT) AS id FROM ({_twin})"
