"""Closes, identity, scoring, links, imports, calibration and the gate, on worked examples."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from booktide.functions import scalars as S
from booktide.operators import calibration, closes, identity, imports, links, reports, scoring, simulation, stats, trades

START = 1_791_504_000_000
CUT = START - 60_000


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def candle_rows(spark, *rows):
    return table(spark, "candle_id long, instrument long, side int, start_ms long, end_ms long, bid_close_e4 int, ask_close_e4 int", *((k, 1, 0, *r) for k, r in enumerate(rows)))


def one_candle(spark, candles, side=0, at=CUT):
    r = table(spark, "request_id string, instrument long, side int, as_of_ms long", ("r", 1, side, at))
    return closes.candle_close(r, candles, 1_800_000).first()


def test_candle_close(spark):
    m = 60_000
    two = [(CUT - 6 * m, CUT - 5 * m, 4000, 4200), (CUT - 3 * m, CUT - 2 * m, 5100, 5300)]
    r = one_candle(spark, candle_rows(spark, *two))
    assert (r.p_num, r.p_den, r.quote_age_ms, r.spread_e4, r.active, r.reason) == (13, 25, 120_000, 200, False, None)
    assert one_candle(spark, candle_rows(spark, (CUT - m, CUT, 5000, 5200))).quote_age_ms == 0
    r = one_candle(spark, candle_rows(spark, *two, (CUT - 1, CUT + m, 9000, 9100)))
    assert (r.p_num, r.p_den, r.active) == (13, 25, True)
    assert one_candle(spark, candle_rows(spark, (CUT - m, CUT + m, 1, 2))).reason == "ambiguous_candle" and one_candle(spark, candle_rows(spark, (CUT + m, CUT + 2 * m, 1, 2))).reason == "no_quotes"
    assert one_candle(spark, candle_rows(spark, (CUT - 60 * m, CUT - 59 * m, 1, 2))).reason == "stale_book"
    assert one_candle(spark, candle_rows(spark, (CUT - 60 * m, CUT - 59 * m, 1, 2), (CUT - 60 * m, CUT - 59 * m, 1, 3))).reason == "ambiguous_candle"
    assert one_candle(spark, candle_rows(spark, (CUT - m, CUT, None, 2))).reason == "no_quotes"
    r = one_candle(spark, candle_rows(spark, (CUT - m, CUT, 5100, 5300)), side=1)
    assert (r.p_num, r.p_den) == (12, 25)


def test_vwap_close(spark):
    at = [CUT - 600_000, CUT - 300_000, CUT - 5, CUT - 2, CUT - 1, CUT, CUT - 600_001]
    e = table(spark, "instrument long, side int, time_ms long, price_e4 int, payout_cents long", *((1, k % 2, t, 4000 if k % 2 == 0 else 6000, 10_000) for k, t in enumerate(at)))
    r = table(spark, "request_id string, instrument long, side int, as_of_ms long", ("a", 1, 0, CUT), ("b", 1, 1, CUT), ("c", 2, 0, CUT))
    got = {x.request_id: x for x in closes.vwap_close(r, e, closes.historical_definitions()[1]).collect()}
    assert (got["a"].p_num, got["a"].p_den, got["a"].executions, got["a"].payout_cents, got["a"].quote_age_ms) == (2, 5, 5, 50_000, 1)
    assert (got["b"].p_num, got["b"].p_den) == (3, 5) and (got["c"].reason, got["c"].executions) == ("few_trades", 0)


LIVE = [closes.LiveDef("top", "mid_top"), closes.LiveDef("depth", "mid_depth", 500)]
TICK = "tick_id long, instrument long, source string, observed_ms long, venue_ms long, status string, truncated boolean, complete boolean, snapshot string"
SIGN = "instrument long, source string, observed_ms long"


def live(spark, ticks, signs=(), gaps=(), levels=None, at=CUT, sources=("stream", "poll")):
    levels = levels or [(k, s, r, p, c) for k in range(1, 9) for s, r, p, c in ((0, 0, 4000, 30_000), (0, 1, 3500, 40_000), (1, 0, 4000, 20_000), (1, 1, 3500, 50_000))]
    t = table(spark, TICK, *ticks)
    q = table(spark, "request_id string, venue string, native_id string, instrument long, side int, as_of_ms long, sources array<string>", ("r", "novig", "m", 1, 0, at, list(sources)))
    g = table(spark, "gap_id long, scope string, open_ms long, close_ms long, reason string", *gaps)
    lv = table(spark, "tick_id long, side int, rank int, price_e4 int, payout_cents long", *levels)
    return {x.def_name: x for x in closes.price_as_of(q, t, table(spark, SIGN, *signs), g, lv, LIVE).collect()}


def tick(k, t, source="stream", status="OPEN", venue=None, snapshot="s", truncated=False):
    return (k, 1, source, t, venue, status, truncated, True, snapshot)


def test_live_price(spark):
    got = live(spark, [tick(1, CUT - 1000)])
    assert (got["top"].p_num, got["top"].p_den, got["top"].spread_e4) == (1, 2, 2000) and (got["depth"].p_num, got["depth"].p_den) == (101, 200)
    assert live(spark, [tick(1, CUT - 1000)], levels=[(1, 0, 0, 4000, 30_000), (1, 1, 0, 4000, 90_000)])["depth"].reason == "insufficient_depth"
    assert live(spark, [tick(1, CUT - 1000, truncated=True)], levels=[(1, 0, 0, 4000, 30_000), (1, 1, 0, 4000, 90_000)])["depth"].reason == "truncated_ladder"
    assert live(spark, [tick(1, CUT + 1)])["top"].reason == "no_quotes"
    assert live(spark, [tick(1, CUT - 40_000)])["top"].reason == "feed_stalled"
    assert live(spark, [tick(1, CUT - 1000, status="SUSPENDED")])["top"].reason == "halted" and live(spark, [tick(1, CUT - 1000, venue=CUT - 7000)])["top"].reason == "venue_lag"
    assert live(spark, [tick(1, CUT - 1_900_000)], signs=[(1, "stream", CUT - 5)])["top"].reason == "stale_book"
    gap = lambda lo, hi, why: [(9, "novig:market:m/book", lo, hi, why)]
    assert live(spark, [tick(1, CUT - 1000)], gaps=gap(CUT - 500, None, "sequence_gap"))["top"].reason == "collection_gap" and live(spark, [tick(1, CUT - 1000)], gaps=gap(CUT - 500, CUT - 400, "crossed_book"))["top"].reason == "crossed_book"
    assert live(spark, [tick(1, CUT - 1000)], gaps=gap(CUT - 5000, CUT - 1000, "reconnect"))["top"].reason is None
    fresh = live(spark, [tick(1, CUT - 9000), tick(2, CUT - 1000, source="poll")])["top"]
    assert (fresh.source, fresh.tick_id) == ("poll", 2) and live(spark, [tick(1, CUT - 1000), tick(2, CUT - 1000, source="poll")])["top"].source == "stream"


def test_bracket(spark):
    old = tick(1, CUT - 60_000)
    assert live(spark, [old], signs=[(1, "stream", CUT + 10)])["top"].bracket_ms == CUT + 10
    assert live(spark, [old, tick(2, CUT + 10)])["top"].bracket_ms == CUT + 10 and live(spark, [old, tick(2, CUT + 10, snapshot="new")])["top"].reason == "feed_stalled"
    tie = live(spark, [old, tick(2, CUT + 10, snapshot="new")], signs=[(1, "stream", CUT + 10)])["top"]
    assert tie.reason == "feed_stalled"
    late = live(spark, [old], signs=[(1, "stream", CUT + 10)], gaps=[(9, "novig:market:m/book", CUT + 5, None, "reconnect")])["top"]
    assert late.reason == "collection_gap"


def test_definitions(spark):
    defs = [*closes.live_definitions(), *closes.historical_definitions(closes.BUFFER_SWEEP_S)]
    rows = closes.definition_rows(spark, defs)
    assert rows.count() == 14 and rows.select("params_sha256").distinct().count() == 14 and closes.new_definitions(rows, rows.limit(10)).count() == 4


def test_scalars(spark):
    df = table(spark, "p string, n string, d string", ("0.485", "6", "-4"), ("0.00015", str(2**70), str(2**69)), ("0.50000000000000000000", None, "1"), ("0.4850000000001", "0", "5"))
    rows = df.withColumns({k: F.col(k).cast("decimal(38,0)") for k in ("n", "d")}).select(S.price_e4(F.col("p")).alias("e"), S.rational(F.col("n"), F.abs("d")).alias("r")).collect()
    assert [r.e for r in rows] == [4850, None, 5000, None] and [r.r and tuple(r.r) for r in rows] == [(3, 2), (2, 1), None, (0, 1)]
    x = spark.range(1).select(S.reduced(F.lit(2**60), F.lit(3 * 2**59)).alias("r"), S.whole_cents(F.lit("2.5"), F.lit(100)).alias("c"), S.whole_cents(F.lit("0.001"), F.lit(100)).alias("n")).first()
    assert (tuple(x.r), x.c, x.n) == ((2, 3), 250, None)


def test_identity(spark):
    m = table(spark, "mapping_id long, instrument long, side int, outcome_id long, polarity string, status string, equivalence string, supersedes long", (1, 1, 0, 10, "direct", "exact", "equivalent", None), (2, 1, 1, 10, "complement", "exact", "equivalent", None), (3, 2, 0, 11, "direct", "exact", "pending", None), (4, 3, 0, 11, "direct", "exact", "equivalent", None), (5, 4, 0, 12, "direct", "exact", "equivalent", None), (6, 4, 1, 12, "direct", "exact", "equivalent", None), (7, 5, 0, 13, "direct", "rejected", "equivalent", None))
    i = table(spark, "instrument long, venue string, native_id string", *((k, "novig", f"n{k}") for k in range(1, 6)))
    got = {r.outcome_id: r.reason for r in identity.lookup(table(spark, "venue string, outcome_id long", *(("novig", o) for o in range(10, 14))), identity.references(identity.current_mappings(m), i)).collect()}
    assert got == {10: None, 11: "ambiguous_reference", 12: "ambiguous_reference", 13: "unmapped"}
    spec = table(spark, "venue string, native_id string, side int, method string, evidence string, status string, polarity string, outcome string, equivalence string", ("novig", "n2", 0, "manual", "e", "manual_verified", None, None, None), ("novig", "zz", 0, "manual", "e", None, None, None, None))
    o = table(spark, "outcome_id long, event_id long, abbreviation string", (10, 1, "A"), (11, 1, "B"))
    rows = {r.error: r for r in identity.corrections(identity.current_mappings(m), i, o, spec).collect()}
    assert (rows[None].status, rows[None].equivalence, rows[None].supersedes) == ("manual_verified", "pending", 3) and "no_instrument" in rows
    heads = identity.current_mappings(m).withColumn("rules", F.lit("R"))
    new = table(spark, "instrument long, side int, outcome_id long, polarity string, status string, equivalence string, rules string, evidence string", (1, 0, 10, "direct", "exact", "pending", None, "e"), (9, 0, 10, "direct", "exact", "pending", None, "e"), (1, 1, 99, "complement", "exact", "pending", None, "e"))
    assert {(r.instrument, r.side): r.action for r in identity.mappings_merged(new, heads).collect()} == {(1, 0): "same", (9, 0): "insert", (1, 1): "conflict"}


def test_decision_quotes(spark):
    q = table(spark, "response_id string, item string, recv_ms long, vendor_event string, bookmaker string, market string, outcome_name string, price_american long, book_update_ms long", ("a", "0", 10, "e", "b", "h2h", "H", -118, 1), ("a", "1", 10, "e", "b", "h2h", "A", 100, 1), ("c", "0", 20, "e", "b", "h2h", "H", -120, 2), ("c", "1", 20, "e", "b", "h2h", "A", 102, 2), ("c", "2", 20, "e", "b", "h2h", "A", 103, 2), ("d", "0", 99, "e", "b", "h2h", "H", 200, 3))
    s = table(spark, "signal_id long, vendor_event string, operator string, name string, other_name string, decision_ms long", (1, "e", "b", "H", "A", 15), (2, "e", "b", "H", "A", 20), (3, "e", "b", "H", "A", 5))
    got = {r.signal_id: (r.response_id, r.d_num, r.d_den, r.o_num) for r in scoring.decision_quotes(s, q).collect()}
    assert got == {1: ("a", 109, 59, 2), 2: ("c", 11, 6, None)}


GAMES = "game long, official_date date, start_ms long, final boolean, away string, home string, away_name string, home_name string, winner string, double boolean, moved boolean"


def test_links(spark):
    from datetime import date

    day = 1743638400000  # 2025-04-03
    g = table(spark, GAMES, (1, date(2025, 4, 3), day, True, "A", "AZ", "Aa", "Athletics", "A", False, False), (2, date(2025, 4, 3), day, True, "C", "D", "Cc", "Dd", "D", True, False), (3, date(2025, 4, 5), day + 2 * 86_400_000, True, "E", "F", "Ee", "Ff", "E", False, True))
    m = lambda ev, a, b, ra="yes", rb="no", status="settled", close=day + 10_000_000: [(ev, f"{ev}-{a}", status, ra, close), (ev, f"{ev}-{b}", status, rb, close)]
    rows = m("KXMLBGAME-25APR03AARI", "A", "ARI") + m("KXMLBGAME-25APR03CD", "C", "D") + m("KXMLBGAME-25APR03EF", "E", "F", close=day + 2 * 86_400_000 + 1) + m("KXMLBGAME-25APR03AZA", "A", "AZ", "scalar", "scalar") + m("KXMLBGAME-25APR03XY", "X", "Y") + m("KXMLBGAME-25APR04AAZ", "A", "AZ", status="open")
    got = {r.event: (r.game, r.status, r.reasons) for r in links.kalshi_links(table(spark, "event string, ticker string, status string, result string, close_ms long", *rows), g).collect()}
    assert got["KXMLBGAME-25APR03AARI"] == (1, "clean", []) and got["KXMLBGAME-25APR03CD"] == (2, "edge", ["winner_disagrees", "doubleheader"])
    assert got["KXMLBGAME-25APR03EF"] == (3, "edge", ["moved", "other_day"]) and got["KXMLBGAME-25APR03XY"] == (None, "edge", ["unknown_teams"]) and got["KXMLBGAME-25APR04AAZ"][1] == "excluded"
    assert got["KXMLBGAME-25APR03AZA"][1] in ("excluded", "edge") and "results" in got["KXMLBGAME-25APR03AZA"][2]
    mk = table(spark, "market string, event string, status string, outcomes array<struct<name:string,grade:string>>", ("m1", "e1", "SETTLED", [("A", "WIN"), ("AZ", "LOSS")]), ("m2", "e2", "SETTLED", [("C", "WIN"), ("D", "LOSS")]))
    ev = table(spark, "event string, away string, home string, starts_ms long, status string", ("e1", "Aa", "Oakland Athletics", day, "FINAL"), ("e2", "Cc", "Dd", day + 7 * 3_600_000, "FINAL"))
    got = {r.market: (r.game, r.status, r.reasons, r.mapped) for r in links.novig_links(mk, ev, g).collect()}
    assert got == {"m1": (1, "clean", [], True), "m2": (None, "edge", ["not_one_game"], False)}


def test_captures(spark):
    s = "event string, markets array<string>, open_ms long, close_ms long"
    got = {r.event: (r.markets, r.open_ms, r.close_ms) for r in links.merged_captures(table(spark, s, ("w", ["a"], 200, 300), ("o", ["a"], 50, 150), ("d", ["a"], 10, 20), ("x", ["a"], 50, 150)), table(spark, s, ("w", ["b"], 210, 290), ("o", ["b"], 60, 200), ("d", ["b"], 10, 90), ("n", ["c"], 1, 2)), 100).collect()}
    assert got == {"w": (["b"], 210, 290), "o": (["a", "b"], 50, 200), "d": (["a"], 10, 20), "x": (["a"], 50, 150), "n": (["c"], 1, 2)}


def test_daily_import(spark):
    b = table(spark, "instrument long, native_id string, side0_id string, side1_id string, first_pitch_ms long, why string", (1, "m", "A", "B", 1000, None))
    r = lambda i, t, o, c, q, side, kind="STRAIGHT": ("f", "d", 5, "p", 0, i, f"t{t}", t, o, "m", "MLB", "MONEY", kind, c, q, side)
    rows = [r(0, 10, "A", "4", "10", "MAKER"), r(1, 10, "A", "4", "10", "MAKER"), r(2, 10, "B", "12", "20", "TAKER"), r(3, 20, "A", "1", "3", "MAKER"), r(4, 20, "A", "2", "3", "TAKER"), r(5, 1000, "A", "1", "3", "MAKER"), r(6, 30, "A", "1", "3", "MAKER", "COMBO"), r(7, 40, "Z", "1", "3", "MAKER")]
    e, s = imports.novig_daily(table(spark, "request_id string, day string, recv_ts_ms long, relpath string, line int, item int, timestamp string, ts_ms long, outcome string, market string, league string, market_type string, trade_type string, cost string, qty string, side string", *rows), b)
    assert {r.item: r.verdict for r in s.collect()} == {0: "maker", 1: "maker", 2: "balanced", 3: "maker", 4: "ambiguous", 5: "after_first_pitch", 6: "combo", 7: "unknown_outcome"}
    got = sorted((x.execution_key, x.price_num, x.price_den, x.payout_cents) for x in e.collect())
    assert got == [("novig:maker:A:10:4:10:0", 2, 5, 1000), ("novig:maker:A:10:4:10:1", 2, 5, 1000), ("novig:maker:A:20:1:3:0", 1, 3, 300)]


def test_settle(spark):
    s = "source string, subject string, result string, value string, place long"
    got = {r.place: (r.action, r.supersedes) for r in imports.settle(table(spark, s, ("a", "x", "win", None, 5), ("a", "x", "win", None, 7), ("a", "x", "lose", None, 9), ("a", "x", "win", None, 11)), table(spark, s, ("a", "x", "lose", None, 3), ("a", "x", "win", None, 5))).collect()}
    assert got == {5: ("considered", None), 7: ("repeat", None), 9: ("insert", 5), 11: ("insert", 9)}
    assert imports.out_of_order(table(spark, "source string, subject string, id long, place long", ("a", "x", 1, 5), ("a", "x", 2, 4), ("a", "x", 3, 9))).count() == 1


def test_greedy_runs_agree(spark):
    rng = np.random.default_rng(2)
    s = table(spark, "k string, stream_id long, s_ms long, s_price int", *(("k", k, int(t), 5000) for k, t in enumerate(rng.integers(0, 20_000, 60))))
    e = table(spark, "k string, execution_id long, e_ms long, e_price int", *(("k", 100 + k, int(t), 5000) for k, t in enumerate(rng.integers(0, 20_000, 40))))
    c = trades.match_candidates(s, e, ["k"], 300, 6).cache()
    pairs = lambda df: sorted((r.stream_id, r.execution_id) for r in df.collect())
    assert pairs(trades.greedy_match(c, ["k"], 300)) == pairs(trades.greedy_match(c, ["k"])) and c.count() > 20


def test_calibration_verdicts(spark):
    rng = np.random.default_rng(0)
    p = rng.uniform(0.3, 0.7, 400)
    make = lambda close: table(spark, "offset_s int, event_id long, p_entry double, p_close double", *((900, k, float(a), float(b)) for k, (a, b) in enumerate(zip(p, close, strict=True))))
    good = p + rng.normal(0, 0.002, 400)
    spec = calibration.Spec(offsets_s=(900,), sample_events=300)
    out, why, rows = calibration.check(make(good), spec)
    assert out == "passed" and why is None and rows.where("kind = 'bin' and outcome = 'not_flagged'").count() == 5
    out, _, rows = calibration.check(make(1 - good), spec)
    slope = rows.where("component = 'slope'").first()
    assert out == "failed" and abs(slope.estimate + 2) < 0.05
    assert calibration.check(make(good), calibration.Spec(offsets_s=(900,)))[0] == "insufficient_data" and calibration.check(make(good), calibration.Spec(offsets_s=(900, 60)))[0] == "insufficient_data"
    with pytest.raises(ValueError, match="not asked"):
        calibration.check(make(good), calibration.Spec(offsets_s=(60,)))
    assert [r.n for r in calibration.invalid_inputs(make(good + 9)).orderBy("rule").collect()] == [0, 400, 0]


def test_simulation(spark):
    got = {r.fault: r for r in simulation.operating_characteristics(simulation.replicates(spark, 20, [1500] * 4, faults=("correct", "level_drift", "close_flip"))).collect()}
    assert got["correct"].passes >= 0.8 and got["level_drift"].fails >= 0.8 and got["close_flip"].fails == 1
    assert calibration.increments([0.05, 0.03, 0.04]) == pytest.approx([0.04, 0, 0.04])


def test_quantiles(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=501).round(2)
    df = table(spark, "g string, v double", *(("a", float(x)) for x in v), ("b", 1.0))
    r = {x.g: x for x in stats.quantiles(df, "v", ["g"], {"q": 0.37, "m": 0.5}).collect()}
    assert abs(r["a"].q - np.quantile(v, 0.37)) < 1e-12 and r["b"].m == 1.0
    n = stats.quantiles(df, "v", ["g"], {"q": 0.37}, linear=False).where("g = 'a'").first().q
    assert n == np.sort(v)[int(np.ceil(501 * 0.37)) - 1]


def test_gate(spark):
    e = [(1, {"type": "fault_injected", "fault_id": "f", "kind": "sequence_skip"}), (2, {"type": "fault_applied", "fault_id": "f", "report": {"dropped": [{"ts_ms": 100, "markets": {"m": {"book": 12}}}]}}), (3, {"type": "fault_injected", "fault_id": "g", "kind": "socket_kill"})]
    f = reports.faults(table(spark, "at_ms long, ref string, frame string", *((t, f"r{t}", json.dumps(x)) for t, x in e))).cache()
    want = reports.expectations(f)
    assert [tuple(r)[1:] for r in want.collect()] == [("sequence_skip", "m", "book", 100, 12)] or want.first().seq == 12
    gap = "gap_id long, market string, channel string, reason string, start_ms long, end_ms long, start_ref string, end_ref string, start_conn string"
    ev, sn = table(spark, "market string, at_ms long, seq long", ("m", 90, 11), ("m", 105, 13)), table(spark, "ref string, market string, channel string, conn string, seq long, subscribed boolean", ("s", "m", "book", "c", 14, False))
    judge = lambda *g: reports.judged(want, table(spark, gap, g), ev, sn).first()
    assert judge(7, "m", "book", "sequence_gap", 90, 200, "x", "s", "c").gap_id == 7
    assert judge(7, "m", "book", "reconnect", 80, 95, "x", "q", "c").problems == ["no_gap"]
    assert set(judge(7, "m", "book", "reconnect", 80, 200, "x", "q", "c").problems) == {"reason", "start", "closes_at_no_snapshot"}
    g = reports.gate(reports.judged(want, table(spark, gap, (7, "m", "book", "sequence_gap", 90, 200, "x", "s", "c")), ev, sn), f, 1).first()
    assert not g.passed and g.n_wrong == 0 and g.n_without_result == 1 and g.sequence_skip == 1


def test_coverage(spark):
    events = table(spark, "event_id long, game long", (1, 11), (2, 12), (3, 13))
    detail = json.dumps({"home": "H", "official_date": "2026-04-01", "status": "Final", "double_header": "N"})
    aliases = table(spark, "alias_id long, event_id long, provider string, detail string", *((k, e, "mlb_statsapi", detail) for k, e in enumerate((1, 2, 3))))
    outcomes = table(spark, "outcome_id long, event_id long, abbreviation string", *((10 * e + k, e, a) for e in (1, 2, 3) for k, a in enumerate(("H", "A"))))
    insts = table(spark, "instrument long, venue string, native_id string", *((100 + e, "kalshi", f"k{e}") for e in (1, 2)), *((200 + e, "novig", f"n{e}") for e in (1, 2)))
    m = table(spark, "mapping_id long, instrument long, side int, outcome_id long, polarity string, status string, equivalence string, supersedes long", *((e, 100 + e, 0, 10 * e, "direct", "exact" if e == 1 else "fuzzy_candidate", "equivalent", None) for e in (1, 2)), *((10 + e, 200 + e, 0, 10 * e, "direct", "exact", "equivalent", None) for e in (1, 2)))
    claims = table(spark, "event_id long, source string, kind string, at_ms long", *((e, "mlb_statsapi", "first_pitch", START) for e in (1, 2)))
    candles = candle_rows(spark, (CUT - 120_000, CUT - 60_000, 1, 2), (START - 900_000 - 90_000, START - 900_000 - 30_000, 1, 2)).withColumn("instrument", F.lit(101).cast("long"))
    sightings = table(spark, "sighting_id long, execution_id long, instrument long, role string, venue_ts_ms long", *((k, k, 201, "maker", CUT - 1000 - k) for k in range(5)), (9, 9, 101, "tape", CUT - 5))
    executions = table(spark, "execution_id long, instrument long, payout_cents long", *((k, 201, 6000) for k in range(5)), (9, 101, 100))
    t = links.coverage(events, aliases, outcomes, insts, identity.current_mappings(m), claims, candles, sightings, executions)
    got = {r.game: r for r in t.collect()}
    assert (got[11].off, got[11].kalshi_link, got[11].kalshi_candle_age_s, got[11].kalshi_candle_age_s_at_900, got[11].kalshi_candle_age_s_at_3600, got[11].kalshi_trades_in_window, got[11].kalshi_reason) == ("trusted", "exact", 60, 30, None, 1, "ok")
    assert (got[11].novig_executions_in_window, got[11].novig_window_payout_cents, got[11].novig_reason, got[11].official_date) == (5, 30_000, "ok", "2026-04-01")
    assert (got[12].kalshi_reason, got[12].novig_reason, got[13].off, got[13].kalshi_reason) == ("mapping_unverified", "vwap_insufficient", "no_trusted_off", "no_trusted_off")
    assert [(r.step, r.dropped, r.left) for r in links.coverage_waterfall(t, "kalshi").collect()] == [("no_trusted_off", 1, 2), ("off_disagreement", 0, 2), ("no_link", 0, 2), ("mapping_unverified", 1, 1), ("no_candle_before_cutoff", 0, 1)]
    assert links.candle_conflicts(candles).first().conflicts == 0


def test_quiet_and_leads(spark):
    acts = table(spark, "instrument long, observed_ms long", *((1, START + 1000 * s) for s in (-100_000, -99_990, -30_000, -100, -90, -90, 3000, 3010)))
    ev = table(spark, "instrument long, scope string, start_ms long, from_ms long, to_ms long", (1, "s", START, 0, START + 10**9))
    gaps = table(spark, "scope string, open_ms long, close_ms long", ("s", START - 95_000, None))
    got = {r.bucket: (r.n, r.gapped, r.longest_s) for r in reports.quiet_by_start(acts, ev, gaps).collect()}
    assert got["before -86400"] == (2, 0, 69990.0) or got["before -86400"][0] + got["before -86400"][1] == 2
    assert got["-900 to 1800"][1] == 2 and got["after 1800"] == (0, 1, None)
    listed = table(spark, "market string, league string, at_ms long", ("a", "L", 1000), ("a", "L", 5000), ("b", "L", 2_000_000))
    mk = table(spark, "market string, league string, start_ms long", ("a", "L", 9_000_000), ("b", "L", 9_000_000), ("c", "L", 1))
    assert {r.market: (r.lead_ms, r.censored) for r in reports.listing_leads(listed, mk).collect()} == {"a": (8_999_000, True), "b": (7_000_000, False), "c": (None, None)}
    e = [{"type": "probe_sent", "channel": "book", "markets": ["a", "b"], "outside_dense": ["a"]}, {"type": "probe_skipped", "channel": "book", "markets": ["a"]}]
    p = reports.probe_tallies(table(spark, "frame string", *((json.dumps(x),) for x in e)))
    assert sorted(tuple(r) for r in p.collect()) == [("probe_sent", "book", "dense", 1), ("probe_sent", "book", "quiet", 1), ("probe_skipped", "book", "unclassified", 1)]
    s = table(spark, "source string, state string", ("x", "OK"), ("x", "WARN"), ("y", "OK"))
    assert {r.source: r.state for r in reports.capture_status(s).collect()} == {"x": "WARN", "y": "OK", None: "WARN"}


def test_window_vwap_broadcasts_nothing(spark):
    r = spark.sql("SELECT * FROM VALUES ('a', 1L, 100L), ('b', 2L, 50L) AS t(request_id, instrument, as_of_ms)")  # of a known, small size
    e = spark.createDataFrame([(1, 95, 5000, 10), (1, 100, 9000, 10), (1, 89, 1, 1), (1, 90, 6000, 30)], "instrument long, time_ms long, price_e4 int, payout_cents long")
    out = trades.window_vwap(r, e, "instrument", 10)
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {x.request_id: (x.n, x.payout, x.paid, x.last_ms) for x in out.collect()} == {"a": (2, 40, 230000, 95), "b": (0, 0, None, None)}
