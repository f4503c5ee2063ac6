"""The archive, the venues' payloads, and the replay of streams, on payloads as the venues send them."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from booktide.operators import spans as G
from booktide.sources import archive, sinks, venues
from booktide.streaming import replay as R


def frame(t, conn, d, text):
    return {"recv_ts_ms": t, "conn_id": conn, "dir": d, "frame": text if isinstance(text, str) else json.dumps(text)}


def exchange(k, path, body, query="", purpose="p", subjects=(), headers=(), status=200):
    request = {"type": "rest_request", "request_id": f"r{k}", "path": path, "query": query, "purpose": purpose, "subjects": list(subjects), "origin": "https://x", "session_id": "s", "start_ts_ms": 10 * k}
    done = {"type": "rest_complete", "request_id": f"r{k}", "status": status, "failure": None, "response_headers": [list(h) for h in headers]}
    return [frame(10 * k, f"r{k}", "event", request), frame(10 * k + 5, f"r{k}", "in", body), frame(10 * k + 6, f"r{k}", "event", done)]


def framed(spark, rows):
    return spark.createDataFrame([("v/2026-01-01/f", "2026-01-01/000000000", k, r["recv_ts_ms"], r["conn_id"], r["dir"], r["frame"]) for k, r in enumerate(rows)], archive.FRAME)


def exchanges(spark, *rows):
    return archive.rest_exchanges(framed(spark, [x for r in rows for x in r])).cache()


def test_archive(spark, tmp_path):
    root, day = str(tmp_path), 1767312000000  # 2026-01-02
    book = {"orderbook_fp": {"yes_dollars": [["0.4000", "10.00"], ["0.40", "2"]], "no_dollars": None}}
    rows = [*exchange(1, "/trade-api/v2/markets/T1/orderbook", book, "depth=0", subjects=["kalshi:market:T1"]), frame(40, "r2", "event", {"type": "rest_request", "request_id": "r2", "path": "/x"})]
    archive.write_segment(root, "venue", "2026-01-01", "s.jsonl.gz", rows)
    archive.write_segment(root, "venue", "2026-01-02", "t.jsonl.gz", [frame(day + 90, "z", "in", "x")])
    with (tmp_path / "venue/2026-01-01/manifest.jsonl").open("a") as out:
        out.write('{"file": "torn')
    segs = archive.segments(spark, root, "venue")
    assert segs.count() == 2 and archive.segments(spark, root, "venue", ["2026-01-01"]).count() == 1 and archive.segments(spark, root, "venue", ["2020-01-01"]).count() == 0
    assert archive.overlapping(segs, 50, 99).count() == 0 and archive.overlapping(segs, 40, 80).count() == 1
    assert [r.line for r in archive.window(spark, root, "venue", 15, day + 90).collect()] == [1, 2, 3, 0]
    x = archive.rest_exchanges(archive.frames(spark, root, segs))
    assert {(r.request_id, r.ok) for r in x.collect()} == {("r1", True), ("r2", False)}
    assert [(r.ticker, r.side, r.price, r.price_e4, r.complete) for r in venues.order_book(x.where("ok")).orderBy("pos").collect()] == [("T1", 0, "0.4000", 4000, True), ("T1", 0, "0.40", 4000, True)]
    assert archive.verify(spark, root, "venue").count() == 0
    part = tmp_path / "venue/2026-01-02/u.jsonl.part"
    part.write_text(json.dumps(frame(day + 95, "z", "in", "y"), separators=(",", ":")) + '\n{"recv_ts')
    assert [r.frame for r in archive.all_frames(spark, root, "venue", day + 90, day + 99).orderBy("recv_ts_ms").collect()] == ["x", "y"]
    assert archive.sealed_through(spark, root) is None
    (tmp_path / "sealed_through.json").write_text('{"sealed_through_ms": 100}')
    w = spark.createDataFrame([("a", 99), ("b", 100), ("c", 5)], "id string, window_end_ms long")
    assert [r.id for r in archive.admitted(w, archive.sealed_through(spark, root), spark.createDataFrame([("c",)], "id string"), ["id"]).collect()] == ["a"]
    file = tmp_path / "venue/2026-01-01/s.jsonl.gz"
    file.write_bytes(file.read_bytes()[:-1] + b"x")
    with pytest.raises(Exception, match="size or hash"):
        archive.frames(spark, root, segs).count()
    assert {r.problem for r in archive.verify(spark, root, "venue").collect()} == {"sha256 differs", "active, not sealed"}
    file.unlink()
    with pytest.raises(archive.ArchiveError, match="missing"):
        archive.frames(spark, root, segs)


@pytest.mark.parametrize("lines,match", [([b'{"conn_id":"c","recv_ts_ms":1,"dir":"in","frame":""}\n'], "not a frame"), ([b'{"recv_ts_ms":1,"conn_id":"c","dir":"in","frame":""}'], "torn"), ([], "0 frames")])
def test_bad_segments(lines, match):
    with pytest.raises(archive.ArchiveError, match=match):
        list(archive.decoded("f", iter(lines), 1))


def test_second_body(spark):
    rows = exchange(1, "/x", "{}")
    with pytest.raises(Exception, match="second body"):
        archive.rest_exchanges(framed(spark, [*rows, frame(17, "r1", "in", "again")])).collect()


def test_rest_stream(spark, tmp_path):
    src, rows = tmp_path / "in", exchange(1, "/x", "{}") + exchange(2, "/y", "[]")[:2]
    framed(spark, rows).write.parquet(str(src))
    stream = archive.rest_stream(spark.readStream.schema(archive.FRAME).parquet(str(src)))
    q = stream.writeStream.format("memory").queryName("rest_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.request_id, r.body) for r in spark.table("rest_out").collect()] == [("r1", "{}")]


def test_kalshi_payloads(spark):
    candle = {"end_period_ts": 120, "yes_bid": {"close": "0.5"}, "yes_ask": {"close_dollars": "0.52"}, "volume_fp": "3"}
    market = {"ticker": "T", "event_ticker": "E", "title": "t", "status": "settled", "result": "yes", "notional_value_dollars": "1.0", "close_time": "2026-01-01T00:00:00Z", "custom_strike": {"baseball_team": "X"}}
    x = exchanges(
        spark, exchange(1, "/historical/markets/T/candlesticks", {"ticker": "T", "candlesticks": [candle]}, "a=1&period_interval=5"), exchange(2, "/trade-api/v2/markets/trades", {"trades": [{"trade_id": "a", "ticker": "T", "created_time": "2026-01-01T00:00:00.0006Z", "yes_price_dollars": "0.62", "count_fp": "100.00"}]}),
        exchange(3, "/events", {"events": [{"markets": [market]}, {"markets": [dict(market, ticker="U")]}]}), exchange(4, "/historical/markets", {"markets": [dict(market, result="no")]}),
    )
    c = venues.candles(x).first()
    assert (c.tier, c.resolution_s, c.interval_start_ms, c.interval_end_ms, c.bid_close_e4, c.ask_close_e4, c.volume) == ("historical", 300, -180000, 120000, 5000, 5200, "3")
    t = venues.tape(x).first()
    assert (t.tier, t["count"], t.price_e4, t.time_ms) == ("live", "100.00", 6200, 1767225600001)
    got = {r.ticker: (r.result, r.custom_strike, r.pos) for r in venues.latest_listings(venues.listed_markets(x)).collect()}
    assert got == {"T": ("no", "X", 0), "U": ("yes", "X", 1)}
    wrong = exchanges(spark, exchange(1, "/markets/T/orderbook", {"orderbook_fp": {}}, subjects=["kalshi:market:U"]))
    with pytest.raises(Exception, match="declared ticker"):
        venues.order_book(wrong).collect()


def test_novig_payloads(spark):
    m = {"marketId": "m", "eventId": "e", "description": "d", "marketType": "MONEY", "status": "OPEN", "startsTs": 5, "outcomes": [{"outcomeId": "A", "name": "a", "status": "OPEN"}]}
    x = exchanges(
        spark, exchange(1, "/v3/public/catalog/markets", {"items": [m, dict(m, marketId="n")]}, purpose="catalog"), exchange(2, "/v3/public/catalog/markets/m", m, purpose="catalog"), exchange(3, "/v3/history/markets/m", dict(m, status="SETTLED")),
        exchange(4, "/v3/history/events/e", {"eventId": "e", "description": "Aa @ Bb", "league": "MLB", "status": "FINAL", "startsTs": 5}), exchange(5, "/v3/public/catalog/markets/m/book", {"marketId": "m", "orders": {"A": [{"price": "0.5", "qty": 1}, {"price": "0.50", "qty": 2}]}}, "depth=2"),
    )
    assert sorted(r.market for r in venues.catalog(x).collect()) == ["m", "m", "n"]
    found, events = venues.latest_markets(venues.history_markets(x), venues.history_events(x))
    assert [r.status for r in found.collect()] == ["SETTLED"] and [(r.away, r.home) for r in events.collect()] == [("Aa", "Bb")]
    book = exchanges(spark, exchange(5, "/b", {"marketId": "m", "orders": {"A": [{"price": "0.5", "qty": 1}, {"price": "0.50", "qty": 2}]}}, "depth=2"))
    got = venues.public_book(book, spark.createDataFrame([("m", ["A", "B"])], "market string, outcomes array<string>")).orderBy("outcome").collect()
    assert [(r.outcome, r.price_e4, r.qty and int(r.qty), r.complete) for r in got] == [("A", 5000, 3, True), ("B", None, None, True)]
    csv = 'timestamp,outcomeId,marketId,league,marketType,tradeType,cost,qty,side,note\n2026-01-01T00:00:00Z,A,m,MLB,MONEY,STRAIGHT,4,10,MAKER,"x,\n""y"""\n2026-01-01T00:00:00.5Z,B,m,MLB,MONEY,COMBO,6,10,TAKER,\n'
    rows = venues.daily_trades(exchanges(spark, exchange(1, "/a/2026-01-01/trades.csv", csv))).orderBy("item").collect()
    assert [(r.item, r.day, r.outcome, r.ts_ms, r.side) for r in rows] == [(0, "2026-01-01", "A", 1767225600000, "MAKER"), (1, "2026-01-01", "B", 1767225600500, "TAKER")]
    with pytest.raises(Exception, match="no column side"):
        venues.daily_trades(exchanges(spark, exchange(1, "/a/2026-01-01/trades.csv", csv.replace(",side,", ",sides,")))).collect()


def test_mlb_and_odds_payloads(spark):
    plays = {"allPlays": [{"playEvents": [{"type": "action", "details": {"description": "Status Change - In Progress"}, "startTime": "2026-01-01T00:00:00Z"}, {"type": "action", "details": {"description": "other"}, "startTime": "2026-01-01T00:00:01Z"}, {"isPitch": True, "details": {"description": "Ball"}, "startTime": "2026-01-01T00:00:02Z"}, {"type": "action", "details": {"description": "Status Change - x"}, "startTime": "2026-01-01T00:00:03Z"}]}]}
    x = exchanges(spark, exchange(1, "/p", plays, subjects=["mlb:game:7"]))
    assert [(r.game_pk, r.pos, r.kind) for r in venues.first_play(x).orderBy("pos").collect()] == [(7, 0, "status_change"), (7, 2, "first_pitch")]
    live = {"gameData": {"game": {"pk": 7, "doubleHeader": "N", "gameNumber": 1}, "datetime": {"dateTime": "2026-01-01T00:00:00Z", "officialDate": "2026-01-01"}, "teams": {"away": {"id": 1, "name": "Aa", "abbreviation": "A"}, "home": {"id": 2, "name": "Bb", "abbreviation": "B"}}, "status": {"detailedState": "Final", "codedGameState": "F"}}, "liveData": {"linescore": {"teams": {"away": {"runs": 3}, "home": {"runs": 2}}}}}
    g = venues.live_games(exchanges(spark, exchange(1, "/g", live))).first()
    assert (g.game_pk, g.winner, g.final, g.away_code, g.home_runs) == (7, "A", True, "A", 2)
    row = {"gamePk": 7, "season": "2026", "officialDate": "2026-01-01", "gameDate": "2026-01-01T00:00:00Z", "status": {"detailedState": "Postponed"}, "teams": {"away": {"team": {"id": 1, "name": "Aa"}}, "home": {"team": {"id": 2, "name": "Bb"}, "isWinner": False}}}
    final = dict(row, officialDate="2026-01-02", status={"detailedState": "Final"}, teams={"away": {"team": {"id": 1, "name": "Aa"}, "isWinner": True}, "home": {"team": {"id": 2, "name": "Bb"}, "isWinner": False}})
    x = exchanges(spark, exchange(1, "/s", {"dates": [{"games": [row]}, {"games": [final]}]}), exchange(2, "/s", {"dates": [{"games": [row]}]}))
    teams = venues.teams(exchanges(spark, exchange(3, "/t", {"teams": [{"id": 1, "abbreviation": "A", "name": "Aa"}]}, "sportId=1&season=2026", purpose="teams")))
    s = venues.schedule(x, teams).first()
    assert (s.game_pk, s.state, s.moved, s.winner, s.away, s.home, s.official_date) == (7, "Final", True, "A", "A", "", "2026-01-02")
    odds = [{"id": "e", "commence_time": "c", "home_team": "h", "away_team": "a", "bookmakers": [{"key": "b", "last_update": "2026-01-01T00:00:00Z", "markets": [{"key": "h2h", "last_update": "2026-01-01T00:00:01Z", "outcomes": [{"name": "h", "price": -118}, {"name": "a", "price": 100}]}]}]}]
    x = exchanges(spark, exchange(1, "/o", odds, headers=[("X-Requests-Remaining", "12.0"), ("x-requests-used", "")]))
    assert [(r.outcome_name, r.price_american, r.market_update_ms - r.book_update_ms) for r in venues.odds_quotes(x).orderBy("item").collect()] == [("h", -118, 1000), ("a", 100, 1000)]
    assert tuple(venues.credits(x).first())[1:] == (12, None, None)


def order(i, price, qty):
    return {"orderId": i, "price": price, "qty": qty}


BASE = {"A": [order("o1", "0.485", 1000), order("o2", "0.48", 500)], "B": [order("o3", "0.51", 300)]}


def snap(ts, seq, orders, subscribed=False, life=None, trades=None):
    body = {"book": {"seq": seq, "orders": orders}} | ({"lifecycle": life} if life else {}) | ({"trades": trades} if trades else {})
    return {"ts": ts, "snapshot": {"m": body}} | ({"subscribed": {"markets": {"m": "book"}}} if subscribed else {})


def delta(ts, seq, *d, channel="book"):
    return {"ts": ts, "delta": {"m": {channel: {"seq": seq, "deltas": list(d)}}}}


def feed(*messages, catalog=()):
    """Told rows of each message: (recv_ts_ms, conn, message)."""
    market, out = R.Market("m", tuple(catalog)), []
    for k, (t, conn, msg) in enumerate(messages):
        for part in ("snapshot", "delta"):
            for body in msg.get(part, {}).values():
                row = SimpleNamespace(message=json.dumps(body), conn_id=conn, recv_ts_ms=t, ref=f"f#{k}", ts=msg["ts"], subscribed="subscribed" in msg, part=part)
                out += market.part(row)
    return [r for r in out if r["kind"] != "evidence"], [r for r in out if r["kind"] == "evidence"]


def kinds(rows):
    return [(r["at_ms"], r["kind"], r.get("status")) for r in rows]


def test_replay_rebuilds():
    rows, _ = feed((100, "c", snap(1, 10, BASE, True)), (200, "c", delta(2, 11, {"kind": "update", "orderId": "o1", "remaining": 400})), (300, "c", delta(3, 12, {"kind": "remove", "orderId": "o1", "reason": "fill"}, {"kind": "add", "orderId": "o4", "outcomeId": "B", "price": "0.515", "qty": 7})))
    books = [json.loads(r["ladders"]) for r in rows if r["kind"] == "book"]
    assert books[1][0] == [["0.485", 400], ["0.48", 500]] and books[2] == [[["0.48", 500]], [["0.515", 7], ["0.51", 300]]]


def test_replay_probes():
    assert [r[2] for r in kinds(feed((100, "c", snap(1, 10, BASE, True)), (200, "c", snap(2, 10, BASE)))[0])][-1] == "confirmed"
    rows = kinds(feed((100, "c", snap(1, 10, BASE, True)), (200, "c", snap(2, 10, {"A": [], "B": BASE["B"]})))[0])
    assert rows[1:] == [(200, "probe", "mismatch"), (200, "book", None)]
    rows = kinds(feed((100, "c", snap(1, 10, BASE, True)), (150, "c", delta(2, 11)), (200, "c", snap(2, 10, BASE)))[0])
    assert rows[-1] == (200, "probe", "superseded")
    ahead = snap(2, 15, BASE, life={"seq": 3, "status": "OPEN"})
    assert kinds(feed((100, "c", snap(1, 10, BASE, True)), (200, "c", ahead))[0])[1:] == [(200, "lifecycle", "OPEN"), (200, "probe", "gap"), (200, "gap", "sequence_gap"), (200, "resync", None), (200, "book", None)]
    again = kinds(feed((100, "c", snap(1, 10, BASE, True)), (200, "c", snap(2, 3, BASE, True)))[0])
    assert again == [(100, "book", None), (200, "book", None)]


def test_replay_sequence_gap():
    rows, seen = feed((1000, "c", snap(1, 10, BASE, True)), (1100, "c", delta(2, 11)), (1200, "c", delta(3, 13)), (1300, "c", delta(4, 14)), (1500, "d", snap(5, 20, BASE, True)))
    assert kinds(rows)[2:] == [(1200, "gap", "sequence_gap"), (1500, "resync", None), (1500, "book", None)]
    assert (rows[2]["seq"], rows[2]["got"], rows[2]["from_ms"]) == (11, 13, 1100) and [e["at_ms"] for e in seen] == [1000, 1100, 1500]


def test_replay_transitions():
    live = {"ts": 2000, "delta": {"m": {"lifecycle": {"seq": 2, "deltas": [{"kind": "GOLIVE", "status": "OPEN"}]}}}}
    rows, _ = feed((1000, "c", snap(1000, 10, BASE, True)), (2000, "c", live), (2050, "c", delta(2050, 11)), (2100, "c", snap(1999, 10, BASE)), (2200, "c", snap(2200, 12, BASE)))
    assert kinds(rows)[1:] == [(2000, "lifecycle", "OPEN"), (2000, "gap", "lifecycle_reset"), (2100, "probe", "superseded"), (2200, "resync", None), (2200, "book", None)] and rows[2]["from_ms"] == 2000
    first = snap(1000, 10, BASE, True, life={"seq": 0, "status": "OPEN"})
    missed, behind = snap(1600, 10, BASE, life={"seq": 1, "status": "OPEN"}), snap(1600, 9, BASE, life={"seq": 1, "status": "OPEN"})
    rows, _ = feed((1000, "c", first), (1100, "c", delta(1100, 11)), (1600, "c", snap(1600, 12, BASE, life={"seq": 1, "status": "OPEN"})))
    gap = next(r for r in rows if r["kind"] == "gap")
    assert (gap["status"], gap["from_ms"], gap["at_ms"]) == ("lifecycle_missed", 1100, 1600) and kinds(rows)[-2:] == [(1600, "resync", None), (1600, "book", None)]
    rows, _ = feed((1000, "c", first), (1600, "c", behind), (1700, "c", snap(1700, 12, BASE)))
    assert kinds(rows)[-3:] == [(1600, "probe", "superseded"), (1700, "resync", None), (1700, "book", None)]
    rows, _ = feed((1000, "c", first), (1050, "d", {"ts": 1050, "snapshot": {"m": {"lifecycle": {"seq": 0, "status": "OPEN"}, "trades": {"seq": 1, "trades": []}}}, "subscribed": {}}), (1600, "d", {"ts": 1600, "snapshot": {"m": {"lifecycle": {"seq": 1, "status": "OPEN"}}}}))
    assert [(r["conn"], r["status"]) for r in rows if r["kind"] == "gap"] == [("c", "lifecycle_missed")] and missed


def test_replay_level_cap_and_errors():
    cut = {"A": [order(f"a{k}", f"{0.5 - 0.005 * k:.3f}", 10) for k in range(20)], "B": [order("b", "0.3", 1)]}
    low = {"kind": "add", "orderId": "x", "outcomeId": "A", "price": "0.400", "qty": 5}
    rows, _ = feed((100, "c", snap(1, 1, cut, True)), (200, "c", delta(2, 2, low, {"kind": "remove", "orderId": "unknown", "reason": "fill"})), (300, "c", delta(3, 3, {"kind": "add", "orderId": "y", "outcomeId": "A", "price": "0.405", "qty": 1})))
    last = json.loads(rows[-1]["ladders"])[0][-1]
    assert not rows[0]["complete"] and json.loads(rows[1]["ladders"])[0] == json.loads(rows[0]["ladders"])[0] and last == ["0.405", 11]
    for bad in ({"kind": "update", "orderId": "o1", "remaining": 1000}, {"kind": "update", "orderId": "o1", "remaining": 0}, {"kind": "add", "orderId": "o1", "outcomeId": "A", "price": "0.4", "qty": 1}, {"kind": "remove", "orderId": "o1", "reason": "expired"}, {"kind": "amend", "orderId": "o1"}, {"kind": "remove", "orderId": "zz", "reason": "fill"}):
        with pytest.raises(R.ReplayError):
            feed((100, "c", snap(1, 10, BASE, True)), (200, "c", delta(2, 11, bad)))


def test_replay_trades_and_sides():
    t = lambda k: {"tradeId": k, "outcomeId": "A", "price": "0.5", "qty": 1, "ts": 1}
    listed = {"seq": 5, "trades": [{"seq": 5, "deltas": [t("t1")]}]}
    rows, _ = feed((100, "c", snap(1, 10, BASE, True, trades=listed)), (200, "c", delta(2, 6, t("t1"), t("t2"), channel="trades")), (300, "c", snap(3, 10, BASE, trades=listed)))
    assert [r["status"] for r in rows if r["kind"] == "trade"] == ["t1", "t2"] and [r["status"] for r in rows if r["kind"] == "probe"] == ["confirmed", "superseded"]
    one = snap(1, 1, {"A": BASE["A"]}, True)
    assert kinds(feed((100, "c", one))[0]) == [] and json.loads(feed((100, "c", one), catalog=("A", "B"))[0][0]["ladders"])[1] == []
    assert R.levels([("0.5", 1), ("0.50", 2), ("0.505", 3), ("0.49", 0)]) == [["0.505", 3], ["0.5", 3]]


def test_replay_in_spark(spark, tmp_path):
    rows = [frame(100, "c", "in", snap(1, 10, BASE, True)), frame(200, "c", "in", delta(2, 11)), frame(300, "c", "in", delta(3, 12, {"kind": "add", "orderId": "x", "outcomeId": "B", "price": "0.6", "qty": 1})), frame(400, "c", "in", delta(4, 13, {"kind": "remove", "orderId": "x", "reason": "cancel"})), frame(500, "c", "in", snap(5, 13, BASE)), frame(600, "c", "in", delta(6, 15))]
    df = framed(spark, rows)
    told = R.replay(R.parts(df)).cache()
    assert told.where("kind = 'book'").count() == 4
    w = [(r.kind, r.reason, r.at_ms) for r in R.write_stream(told).collect()]
    assert w == [("tick", "subscribe", 100), ("snapshot", "subscribe", 100), ("evidence", "delta_unchanged", 200), ("gap_open", "crossed_book", 300), ("quarantined", "crossed_book", 300), ("tick", None, 400), ("gap_close", "crossed_book", 400), ("evidence", "probe_confirmed", 500)]
    s = R.spans(told).collect()
    assert [(r.channel, r.first_ms, r.last_ms) for r in s] == [("book", 100, 500)]
    assert [(r.reason, r.start_ms, r.end_ms) for r in G.break_gaps(*R.breaks(told)).collect()] == [("sequence_gap", 500, None)]
    src = tmp_path / "in"
    df.write.parquet(str(src))
    q = R.replay_stream(R.parts(spark.readStream.schema(archive.FRAME).parquet(str(src)))).writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda d: sorted((r.kind, r.status or "", r.at_ms, r.ladders or "") for r in d.collect())
    assert key(spark.table("replayed")) == key(told)


def test_polled_books(spark):
    book = json.dumps([[["0.4", 5]], [["0.5", 5]]])
    rows = [("m", 10, "f#1", "s1", "OPEN", True, book, False), ("m", 20, "f#2", "s1", "OPEN", True, book, False), ("m", 30, "f#3", "s1", "HALT", True, book, False), ("m", 40, "f#4", "s2", "HALT", True, book, False), ("m", 50, "f#5", "s2", "HALT", True, book, True)]
    df = spark.createDataFrame(rows, "market string, at_ms long, ref string, session string, status string, complete boolean, ladders string, gap boolean")
    assert [(r.kind, r.reason, r.at_ms) for r in R.write_polls(df).collect()] == [("tick", "first_poll", 10), ("snapshot", "first_poll", 10), ("evidence", "poll_unchanged", 20), ("tick", None, 30), ("tick", "first_poll", 40), ("snapshot", "first_poll", 40), ("tick", "resync", 50), ("snapshot", "resync", 50)]


@pytest.mark.parametrize("spans,commands,ends,losses,want", [
    ([("c", 100, 200), ("d", 300, 400)], [], {"c": "io_error", "d": "io_error"}, [], [("reconnect", 200, 300), ("connection_lost", 400, None)]),
    ([("c", 100, 200)], [], {}, [], [("connection_end_unrecorded", 200, None)]),
    ([("c", 100, 200)], [], {"c": "recorder_stop"}, [], []),
    ([("c", 100, 150), ("c", 220, 300)], [], {"c": "recorder_stop"}, [("c", 180)], [("subscription_lost", 150, 220)]),
    ([("c", 100, 201)], [], {"c": "recorder_stop"}, [("c", 180)], [("subscription_lost", 201, None)]),
    ([("c", 100, 200), ("c", 300, 400)], [("c", 0, 90, "subscribe"), ("c", 1, 210, "unsubscribe"), ("c", 2, 290, "subscribe")], {"c": "recorder_stop"}, [], []),
    ([("c", 100, 250)], [("c", 0, 90, "subscribe"), ("c", 1, 240, "unsubscribe")], {"c": "io_error"}, [], []),
    ([("c", 100, 200), ("c", 250, 250)], [("c", 0, 90, "subscribe"), ("c", 1, 210, "unsubscribe"), ("c", 2, 210, "subscribe")], {"c": "io_error"}, [], [("connection_lost", 250, None)]),
    ([("c", 100, 300), ("d", 150, 250)], [], {"c": "recorder_stop"}, [], []),
])
def test_span_gaps(spark, spans, commands, ends, losses, want):
    s = spark.createDataFrame([(f"{k}", c, "m", "book", a, b, "x", "y") for k, (c, a, b) in enumerate(spans)], "span_id string, conn string, market string, channel string, first_ms long, last_ms long, first_ref string, last_ref string")
    c = spark.createDataFrame([(x[0], "m", *x[1:]) for x in commands], "conn string, market string, seq int, at_ms long, kind string")
    e = spark.createDataFrame(list(ends.items()), "conn string, reason string")
    lost = spark.createDataFrame([(x[0], "m", x[1]) for x in losses], "conn string, market string, at_ms long")
    assert sorted(((r.reason, r.start_ms, r.end_ms) for r in G.span_gaps(s, c, e, lost).collect()), key=lambda x: x[1]) == want


def test_commit(spark, tmp_path):
    root, schema = f"file://{tmp_path}", "id long, v string"
    t = {"a": spark.createDataFrame([(1, "x")], schema)}
    count = lambda n: lambda w: w["a"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("r").alias("rule"), (F.col("n") - n).alias("n"))
    assert sinks.commit(spark, root, "u1", t, count(1)) and not sinks.commit(spark, root, "u1", t)
    with pytest.raises(ValueError, match="rules broken"):
        sinks.commit(spark, root, "u2", t, count(0))
    assert [(r.id, r.unit) for r in sinks.facts(spark, root, "a", schema).collect()] == [(1, "u1")]
    files = sinks.artifacts(spark.createDataFrame([("p", "h"), ("q", "i")], "relpath string, sha256 string"), spark.createDataFrame([(4, "p", "v1")], "artifact_id long, relpath string, parser_version string"), "v1")
    assert [tuple(r)[:2] for r in files.collect()] == [(5, "q")]
    assert sinks.markdown(t["a"], "T") == "## T\n\n| id | v |\n|---|---|\n| 1 | x |\n" and sinks.recomputed(t["a"], t["a"], ["id"], ["v"]).count() == 0
