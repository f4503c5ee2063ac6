"""Parsers of venue payloads: each takes exchanges (rows of archive.rest_exchanges) and returns rows numbered in the payload's order."""

from __future__ import annotations

import csv
import io
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import e4, header, iso_ms, price_e4

BODY = "body.frame"
#: The paths by which payloads are known.
ORDERBOOK, CANDLES, TRADES = r"/markets/([A-Z0-9.-]+)/orderbook$", r"/markets/([A-Z0-9.-]+)/candlesticks$", r"/(historical/trades|markets/trades)$"
CATALOG, HISTORY_MARKET, HISTORY_EVENT = "/v3/public/catalog/markets", r"/v3/history/markets/([^/]+)$", r"/v3/history/events/([^/]+)$"
DAILY = r"/([0-9]{4}-[0-9]{2}-[0-9]{2})/trades\.csv$"
TRADE_COLUMNS = ["timestamp", "outcomeId", "marketId", "league", "marketType", "tradeType", "cost", "qty", "side"]


def parameter(name: str, query: str = "query") -> Column:
    """A parameter of a query string; null if it is not there."""
    found = F.regexp_extract(F.concat(F.lit("&"), F.coalesce(query, F.lit(""))), f"&{name}=([^&]*)", 1)
    return F.when(found != "", found)


def read_order() -> Column:
    """The place of an exchange's body in the order of receipt."""
    return F.struct("body.recv_ts_ms", "body.seg_pos", "body.line")


def _known(test: Column, message: str) -> Column:
    """An id that can be had only if the test holds; else the job ends with the message."""
    return F.when(test, F.col("request_id")).otherwise(F.raise_error(F.concat(F.lit(message + ": "), "request_id")))


def subject(c: Column) -> Column:
    """struct(venue, kind, id, channel) of venue:kind:id or venue:kind:id/channel."""
    head, rest = F.substring_index(c, "/", 1), F.when(F.instr(c, "/") > 0, F.substring_index(c, "/", -1))
    part = F.split(head, ":", 3)
    return F.struct(F.get(part, F.lit(0)).alias("venue"), F.get(part, F.lit(1)).alias("kind"), F.get(part, F.lit(2)).alias("id"), rest.alias("channel"))


def order_book(exchanges: DataFrame) -> DataFrame:
    """Levels of polled books: request_id, ticker (from the path; it must be the declared subject), side, pos, price, price_e4, qty, complete (no depth was asked for)."""
    kind = "struct<orderbook_fp:struct<yes_dollars:array<array<string>>,no_dollars:array<array<string>>>>"
    ticker = F.regexp_extract("path", ORDERBOOK, 1)
    declared = (ticker != "") & F.coalesce(F.array_contains("subjects", F.concat(F.lit("kalshi:market:"), ticker)), F.lit(False))
    x = exchanges.select(_known(declared, "not an order book of one declared ticker").alias("request_id"), ticker.alias("ticker"), (F.coalesce(parameter("depth"), F.lit("0")).cast("int") == 0).alias("complete"), F.from_json(BODY, kind).alias("b"))
    sides = F.array(*(F.struct(F.lit(k).alias("side"), F.coalesce(F.col(f"b.orderbook_fp.{n}_dollars"), F.array().cast("array<array<string>>")).alias("levels")) for k, n in enumerate(("yes", "no"))))
    rows = x.withColumn("s", F.explode(sides)).select("request_id", "ticker", "complete", "s.side", F.posexplode("s.levels").alias("pos", "l"))
    return rows.select("request_id", "ticker", "complete", "side", "pos", F.col("l")[0].alias("price"), price_e4(F.col("l")[0]).alias("price_e4"), F.col("l")[1].cast("decimal(38,6)").alias("qty"))


def public_book(exchanges: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Levels of the unsigned poll: request_id, market, outcome, price, price_e4, qty, complete. A side without orders has one row without a price.

    complete: no depth was asked for, or so many levels that neither one side nor both together can have been cut. catalog (market,
    outcomes) names sides that the payload leaves out; a book with other than two sides is an error.
    """
    b = F.from_json(BODY, "struct<marketId:string,orders:map<string,array<struct<price:string,qty:string>>>>")
    x = exchanges.select("request_id", parameter("depth").cast("int").alias("depth"), b.alias("b")).select("request_id", F.when(F.col("depth") > 0, F.col("depth")).alias("depth"), F.col("b.marketId").alias("market"), F.col("b.orders").alias("orders"))
    if catalog is not None:
        x = x.join(catalog.select("market", "outcomes"), "market", "left")
        x = x.withColumn("names", F.array_union(F.map_keys("orders"), F.coalesce("outcomes", F.array().cast("array<string>")))).drop("outcomes")
    else:
        x = x.withColumn("names", F.map_keys("orders"))
    x = x.withColumn("request_id", _known(F.size("names") == 2, "a book without two outcomes"))
    o = x.select("request_id", "market", "depth", F.explode("names").alias("outcome"), "orders").withColumn("l", F.explode_outer(F.element_at("orders", F.col("outcome"))))
    at = F.col("l.price").cast("decimal(20,10)")
    g = o.groupBy("request_id", "market", "depth", "outcome", at.alias("at")).agg(F.min("l.price").alias("price"), F.sum(F.col("l.qty").cast("decimal(38,6)")).alias("qty"))
    g = g.where("at is null or qty > 0")
    side, both = Window.partitionBy("request_id", "outcome"), Window.partitionBy("request_id")
    n = F.count("at").over(side)
    whole = F.col("depth").isNull() | ((F.max("_n").over(both) < F.col("depth")) & (F.count("at").over(both) < F.col("depth")))
    return g.withColumn("_n", n).select("request_id", "market", "outcome", "price", price_e4(F.col("price")).alias("price_e4"), "qty", whole.alias("complete"))


_MARKET = "struct<marketId:string,eventId:string,description:string,marketType:string,status:string,voids:string,startsTs:bigint,settledTs:bigint,outcomes:array<struct<outcomeId:string,name:string,status:string>>>"


def _catalog_rows(x: DataFrame) -> DataFrame:
    return x.select("request_id", "recv_ts_ms", "place", "item", F.col("m.marketId").alias("market"), F.col("m.eventId").alias("event"), "m.description", F.col("m.marketType").alias("market_type"), "m.status", "m.voids", F.col("m.startsTs").alias("starts_ms"), F.col("m.settledTs").alias("settled_ms"), "m.outcomes")


def catalog(exchanges: DataFrame) -> DataFrame:
    """Markets of catalog responses: a page of the league's listing, or one market."""
    ok = exchanges.where("ok and purpose = 'catalog'")
    own = lambda df, body, one: df.select("request_id", F.col("body.recv_ts_ms").alias("recv_ts_ms"), read_order().alias("place"), one(F.from_json(BODY, body)))
    page = own(ok.where(F.col("path") == CATALOG), f"struct<items:array<{_MARKET}>>", lambda b: F.posexplode(b["items"]).alias("item", "m"))
    single = own(ok.where(F.rlike("path", F.lit(f"^{CATALOG}/[^/]+$"))), _MARKET, lambda b: F.posexplode(F.array(b)).alias("item", "m"))
    return _catalog_rows(page.unionByName(single))


def history_markets(exchanges: DataFrame) -> DataFrame:
    """Markets of history responses, one each."""
    x = exchanges.where(F.col("ok") & F.rlike("path", F.lit(HISTORY_MARKET)))
    return _catalog_rows(x.select("request_id", F.col("body.recv_ts_ms").alias("recv_ts_ms"), read_order().alias("place"), F.lit(0).alias("item"), F.from_json(BODY, _MARKET).alias("m")))


def history_events(exchanges: DataFrame) -> DataFrame:
    """Events of history responses, with the two names in "Away @ Home"."""
    b = F.from_json(BODY, "struct<eventId:string,description:string,league:string,status:string,startsTs:bigint>")
    x = exchanges.where(F.col("ok") & F.rlike("path", F.lit(HISTORY_EVENT))).select("request_id", F.col("body.recv_ts_ms").alias("recv_ts_ms"), read_order().alias("place"), b.alias("e"))
    at = F.instr("e.description", " @ ")
    name = lambda c: F.when(at > 0, c)
    return x.select("request_id", "recv_ts_ms", "place", F.col("e.eventId").alias("event"), "e.description", "e.league", "e.status", F.col("e.startsTs").alias("starts_ms"), name(F.substring_index("e.description", " @ ", 1)).alias("away"), name(F.expr("substring(e.description, instr(e.description, ' @ ') + 3)")).alias("home"))


def latest_markets(markets: DataFrame, events: DataFrame, league: str = "MLB", market_type: str = "MONEY") -> tuple[DataFrame, DataFrame]:
    """The last response of each market of a type whose event is of a league, and of each event; of equal times the later read."""
    last = lambda df, key: df.groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != key)), "place").alias("r")).select(key, "r.*")
    e = last(events, "event")
    m = last(markets.where(F.col("market_type") == market_type), "market")
    return m.join(e.where(F.col("league") == league).select("event"), "event", "left_semi"), e


def candles(exchanges: DataFrame) -> DataFrame:
    """Candles of either tier: ticker, tier, resolution_s, interval, open to close of bid, ask and price on the e4 grid, volume, open interest.

    Fields are named close or close_dollars, volume or volume_fp; the resolution is the query's. A body of another ticker is an error.
    """
    quote = "struct<" + ",".join(f"{k}:string,{k}_dollars:string" for k in ("open", "high", "low", "close")) + ">"
    kind = f"struct<ticker:string,candlesticks:array<struct<end_period_ts:bigint,yes_bid:{quote},yes_ask:{quote},price:{quote},volume:string,volume_fp:string,open_interest:string,open_interest_fp:string>>>"
    ticker = F.regexp_extract("path", CANDLES, 1)
    x = exchanges.where(F.col("ok") & (ticker != "")).select("request_id", "path", "query", "body", F.from_json(BODY, kind).alias("b"), ticker.alias("ticker"))
    same = F.coalesce(F.col("b.ticker") == F.col("ticker"), F.lit(True))
    x = x.select(_known(same, "candles of another ticker").alias("request_id"), "ticker", F.when(F.contains("path", F.lit("/historical/")), "historical").otherwise("live").alias("tier"), (F.coalesce(parameter("period_interval"), F.lit("1")).cast("int") * 60).alias("resolution_s"), F.col("body.recv_ts_ms").alias("recv_ts_ms"), F.col("body.relpath").alias("relpath"), F.col("body.line").alias("line"), F.posexplode("b.candlesticks").alias("pos", "c"))
    of = lambda side, k: e4(F.coalesce(F.col(f"c.{side}.{k}"), F.col(f"c.{side}.{k}_dollars")))
    end = F.col("c.end_period_ts") * 1000
    return x.select(
        "request_id", "ticker", "tier", "resolution_s", "recv_ts_ms", "relpath", "line", "pos", (end - F.col("resolution_s") * 1000).alias("interval_start_ms"), end.alias("interval_end_ms"),
        *(of(side, k).alias(f"{n}_{k}_e4") for n, side in (("bid", "yes_bid"), ("ask", "yes_ask"), ("price", "price")) for k in ("open", "high", "low", "close")),
        F.coalesce("c.volume", "c.volume_fp").alias("volume"), F.coalesce("c.open_interest", "c.open_interest_fp").alias("open_interest"),
    )


def tape(exchanges: DataFrame) -> DataFrame:
    """Trades of a page of the tape, of either tier."""
    kind = "struct<trades:array<struct<trade_id:string,ticker:string,created_time:string,yes_price_dollars:string,count_fp:string,taker_side:string>>>"
    tier = F.regexp_extract("path", TRADES, 1)
    x = exchanges.where(F.col("ok") & (tier != "")).select("request_id", F.when(tier.startswith("historical"), "historical").otherwise("live").alias("tier"), F.col("body.recv_ts_ms").alias("recv_ts_ms"), F.col("body.relpath").alias("relpath"), F.col("body.line").alias("line"), F.posexplode(F.from_json(BODY, kind)["trades"]).alias("pos", "t"))
    return x.select("request_id", "tier", "recv_ts_ms", "relpath", "line", "pos", "t.trade_id", "t.ticker", iso_ms(F.col("t.created_time")).alias("time_ms"), F.col("t.yes_price_dollars").alias("price"), price_e4(F.col("t.yes_price_dollars")).alias("price_e4"), F.col("t.count_fp").alias("count"), "t.taker_side")


def listed_markets(exchanges: DataFrame) -> DataFrame:
    """Markets of a listing, flat (/markets, /historical/markets) or inside events (/events), numbered in the response's order."""
    text = ["ticker", "event_ticker", "title", "yes_sub_title", "status", "result", "notional_value_dollars", "occurrence_datetime", "close_time", "rules_primary", "rules_secondary", "price_level_structure", "settlement_ts", "settlement_value_dollars"]
    market = "struct<" + ",".join(f"{c}:string" for c in text) + ",can_close_early:boolean,custom_strike:struct<baseball_team:string>>"
    b = F.from_json(BODY, f"struct<markets:array<{market}>,events:array<struct<markets:array<{market}>>>>")
    nested = F.flatten(F.transform(b["events"], lambda e: F.coalesce(e["markets"], F.array().cast(f"array<{market}>"))))
    x = exchanges.where(F.col("ok") & F.rlike("path", F.lit("/(historical/markets|markets|events)$")))
    rows = x.select("request_id", F.col("body.recv_ts_ms").alias("recv_ts_ms"), read_order().alias("place"), F.posexplode(F.when(F.col("path").endswith("/events"), nested).otherwise(b["markets"])).alias("pos", "m"))
    return rows.select("request_id", "recv_ts_ms", "place", "pos", *(F.col(f"m.{c}").alias(c) for c in text), F.coalesce("m.can_close_early", F.lit(False)).alias("can_close_early"), F.col("m.custom_strike.baseball_team").alias("custom_strike"), iso_ms(F.col("m.close_time")).alias("close_ms"))


def latest_listings(markets: DataFrame) -> DataFrame:
    """The last listing of each ticker; of equal times the later read."""
    rest = [c for c in markets.columns if c != "ticker"]
    return markets.groupBy("ticker").agg(F.max_by(F.struct(*rest), F.struct("place", "pos")).alias("m")).select("ticker", "m.*")


def odds_quotes(exchanges: DataFrame) -> DataFrame:
    """Quotes of bookmakers: one row for each event, book, market and outcome, with both update times and the time of receipt."""
    kind = "array<struct<id:string,commence_time:string,home_team:string,away_team:string,bookmakers:array<struct<key:string,last_update:string,markets:array<struct<key:string,last_update:string,outcomes:array<struct<name:string,price:bigint>>>>>>>>"
    x = exchanges.select(F.col("request_id").alias("response_id"), F.col("body.recv_ts_ms").alias("recv_ms"), F.posexplode(F.from_json(BODY, kind)).alias("i", "e"))
    x = x.select("*", F.posexplode("e.bookmakers").alias("j", "b")).select("*", F.posexplode("b.markets").alias("k", "m")).select("*", F.posexplode("m.outcomes").alias("l", "o"))
    return x.select(
        "response_id", F.format_string("%06d/%06d/%06d/%06d", "i", "j", "k", "l").alias("item"), "recv_ms", F.col("e.id").alias("vendor_event"), F.col("e.commence_time").alias("commence_time"), F.col("e.home_team").alias("home_team"), F.col("e.away_team").alias("away_team"),
        F.col("b.key").alias("bookmaker"), F.col("m.key").alias("market"), F.col("o.name").alias("outcome_name"), F.col("o.price").alias("price_american"), iso_ms(F.col("b.last_update")).alias("book_update_ms"), iso_ms(F.col("m.last_update")).alias("market_update_ms"),
    )


def credits(exchanges: DataFrame) -> DataFrame:
    """What a response's headers say of the quota: remaining, used, last."""
    number = lambda n: F.floor(header(F.col("headers"), f"x-requests-{n}").try_cast("double")).cast("long").alias(n)
    return exchanges.select("request_id", number("remaining"), number("used"), number("last"))


def live_games(exchanges: DataFrame) -> DataFrame:
    """Identity, state and result of games from their live feed; the winner of a final game by its runs."""
    at = lambda p, t="string": F.get_json_object(BODY, f"$.{p}").cast(t)
    runs = {s: at(f"liveData.linescore.teams.{s}.runs", "int") for s in ("away", "home")}
    final = at("gameData.status.codedGameState") == "F"
    won = F.when(final & (runs["away"] > runs["home"]), at("gameData.teams.away.abbreviation")).when(final & (runs["away"] < runs["home"]), at("gameData.teams.home.abbreviation"))
    return exchanges.select(
        "request_id", at("gameData.game.pk", "long").alias("game_pk"), iso_ms(at("gameData.datetime.dateTime")).alias("scheduled_ms"), at("gameData.datetime.officialDate").alias("official_date"), at("gameData.datetime.originalDate").alias("original_date"),
        at("gameData.game.doubleHeader").alias("double_header"), at("gameData.game.gameNumber", "int").alias("game_number"), *(at(f"gameData.teams.{s}.{k}").alias(f"{s}_{n}") for s in ("away", "home") for k, n in (("id", "id"), ("abbreviation", "code"), ("name", "name"))),
        at("gameData.status.detailedState").alias("status"), F.coalesce(final, F.lit(False)).alias("final"), runs["away"].alias("away_runs"), runs["home"].alias("home_runs"), won.alias("winner"),
    )


def teams(exchanges: DataFrame) -> DataFrame:
    """Teams of a season: season, team_id, code, name."""
    x = exchanges.where("ok and purpose = 'teams'").select(parameter("season").cast("int").alias("season"), F.explode(F.from_json(BODY, "struct<teams:array<struct<id:bigint,abbreviation:string,name:string>>>")["teams"]).alias("t"))
    return x.select("season", F.col("t.id").alias("team_id"), F.col("t.abbreviation").alias("code"), F.col("t.name").alias("name")).dropDuplicates(["season", "team_id"])


def schedule(exchanges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Games of schedules: of several rows of one game the last final one, else the last read; moved if listed on two dates, postponed or rescheduled.

    known: rows of teams, for their codes; without it codes are empty.
    """
    team = "struct<team:struct<id:bigint,name:string>,isWinner:boolean>"
    game = f"struct<gamePk:bigint,season:string,officialDate:string,gameDate:string,doubleHeader:string,gameNumber:int,rescheduledFrom:string,rescheduledFromDate:string,status:struct<detailedState:string>,teams:struct<away:{team},home:{team}>>"
    g = exchanges.select(read_order().alias("place"), F.posexplode(F.from_json(BODY, f"struct<dates:array<struct<games:array<{game}>>>>")["dates"]).alias("d", "day")).select("place", "d", F.posexplode("day.games").alias("pos", "g"))
    final = F.coalesce(F.col("g.status.detailedState") == "Final", F.lit(False))
    late = F.coalesce(F.col("g.status.detailedState") == "Postponed", F.lit(False)) | F.col("g.rescheduledFrom").isNotNull() | F.col("g.rescheduledFromDate").isNotNull()
    rows = g.groupBy(F.col("g.gamePk").alias("game_pk")).agg(F.max_by("g", F.struct(final, "place", "d", "pos")).alias("g"), ((F.count_distinct("g.officialDate") > 1) | F.max(late)).alias("moved"))
    x = rows.select(
        "game_pk", "moved", F.coalesce("g.season", F.substring("g.officialDate", 1, 4)).cast("int").alias("season"), F.col("g.officialDate").alias("official_date"), iso_ms(F.col("g.gameDate")).alias("start_ms"), F.col("g.status.detailedState").alias("state"),
        F.coalesce("g.doubleHeader", F.lit("N")).alias("double_header"), F.coalesce("g.gameNumber", F.lit(1)).alias("game_number"), *(F.col(f"g.teams.{s}.team.{k}").alias(f"{s}_{k}") for s in ("away", "home") for k in ("id", "name")),
        F.when(F.col("g.teams.away.isWinner"), "away").when(F.col("g.teams.home.isWinner"), "home").alias("won"),
    )
    for s in ("away", "home"):
        codes = known.select("season", F.col("team_id").alias(f"{s}_id"), F.col("code").alias(s)) if known is not None else None
        x = x.join(codes, ["season", f"{s}_id"], "left") if codes is not None else x.withColumn(s, F.lit(None).cast("string"))
        x = x.withColumn(s, F.coalesce(s, F.lit("")))
    return x.withColumns({"winner": F.when(F.col("won") == "away", F.col("away")).when(F.col("won") == "home", F.col("home")), "final": F.col("state") == "Final"}).drop("won")


def first_play(exchanges: DataFrame) -> DataFrame:
    """Status changes of the first play, and the game's first pitch, after which nothing counts: request_id, game_pk, pos, kind, description, at_ms."""
    play = "array<struct<playEvents:array<struct<isPitch:boolean,type:string,startTime:string,details:struct<description:string>>>>>"
    b = F.from_json(BODY, f"struct<allPlays:{play},liveData:struct<plays:struct<allPlays:{play}>>>")
    plays = F.coalesce(b["liveData"]["plays"]["allPlays"], b["allPlays"])
    game = F.get(F.filter("subjects", lambda s: s.startswith("mlb:game:")), F.lit(0)) if "subjects" in exchanges.columns else F.lit(None).cast("string")
    x = exchanges.select("request_id", F.substring_index(game, ":", -1).cast("long").alias("game_pk"), F.get(plays, F.lit(0))["playEvents"].alias("e"))
    e = x.select("request_id", "game_pk", F.posexplode("e").alias("pos", "e"), F.array_position(F.transform("e", lambda x: F.coalesce(x["isPitch"], F.lit(False))), True).alias("first"))
    pitch = F.col("pos") == F.col("first") - 1
    change = (F.col("e.type") == "action") & F.coalesce(F.col("e.details.description").startswith("Status Change"), F.lit(False))
    e = e.where(((F.col("first") == 0) | (F.col("pos") < F.col("first"))) & (pitch | change))
    return e.select("request_id", "game_pk", "pos", F.when(pitch, "first_pitch").otherwise("status_change").alias("kind"), F.coalesce("e.details.description", F.lit("")).alias("description"), iso_ms(F.col("e.startTime")).alias("at_ms"))


def off_claims(plays: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Claims of a start from play events (event_id, kind, description, at_ms) and venue transitions (event_id, detail, venue_ms): event_id, source, kind, at_ms."""
    kind = F.when(F.col("kind") == "first_pitch", "first_pitch").when(F.col("description") == "Status Change - In Progress", "status_in_progress").when(F.col("description") == "Status Change - Warmup", "status_warmup")
    official = plays.select("event_id", F.lit("mlb_statsapi").alias("source"), kind.alias("kind"), "at_ms")
    venue = lifecycle.where("detail = 'GOLIVE'").select("event_id", F.lit("novig_stream").alias("source"), F.lit("venue_golive").alias("kind"), F.col("venue_ms").alias("at_ms"))
    return official.unionByName(venue).where("kind is not null")


def daily_trades(exchanges: DataFrame) -> DataFrame:
    """Rows of daily trade files (CSV inside a body, fields and line feeds may be quoted), columns by name, numbered from 0. A file without a needed column is an error.

    Quoting makes a file one sequence, so each is read from start to end in one task, and told in batches.
    """
    x = exchanges.where(F.col("ok") & F.rlike("path", F.lit(DAILY))).select("request_id", F.regexp_extract("path", DAILY, 1).alias("day"), F.col("body.recv_ts_ms").alias("recv_ts_ms"), F.col("body.relpath").alias("relpath"), F.col("body.line").alias("line"), F.col(BODY).alias("text"))
    kept, names = ["request_id", "day", "recv_ts_ms", "relpath", "line"], ["timestamp", "outcome", "market", "league", "market_type", "trade_type", "cost", "qty", "side"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own, rows = [batch.column(c)[k].as_py() for c in kept], csv.DictReader(io.StringIO(batch.column("text")[k].as_py()))
                if missing := [c for c in TRADE_COLUMNS if c not in (rows.fieldnames or ())]:
                    raise ValueError(f"{own[0]}: no column {', '.join(missing)}")
                at = 0
                while part := list(itertools.islice(rows, 10_000)):
                    fixed = [pa.array([v] * len(part), t) for v, t in zip(own, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array(range(at, at + len(part)), pa.int32()), *(pa.array([r[c] for r in part], pa.string()) for c in TRADE_COLUMNS)], [*kept, "item", *names])
                    at += len(part)

    out = x.mapInArrow(read, "request_id string, day string, recv_ts_ms long, relpath string, line int, item int, " + ", ".join(f"{n} string" for n in names))
    return out.withColumn("ts_ms", iso_ms(F.col("timestamp")))


def stream_trades(framed: DataFrame) -> DataFrame:
    """Trades that stream frames list, in snapshots (batches) and deltas, numbered over the whole frame: relpath, line, recv_ts_ms, item, market, trade_id, outcome, price, qty, ts_ms."""
    trade = "struct<tradeId:string,outcomeId:string,price:string,qty:string,ts:bigint>"
    body = f"struct<trades:struct<trades:array<struct<deltas:array<{trade}>>>,deltas:array<{trade}>>>"
    m = F.from_json("frame", f"struct<snapshot:map<string,{body}>,delta:map<string,{body}>>")
    none = F.array().cast(f"array<{trade}>")
    named = lambda es, pick: F.flatten(F.transform(F.coalesce(es, F.array().cast(f"array<struct<key:string,value:{body}>>")), lambda e: F.transform(F.coalesce(pick(e["value"]["trades"]), none), lambda t: F.struct(e["key"].alias("market"), t.alias("t")))))
    snapshot = named(F.map_entries(m["snapshot"]), lambda t: F.flatten(F.transform(t["trades"], lambda b: F.coalesce(b["deltas"], none))))
    delta = named(F.map_entries(m["delta"]), lambda t: t["deltas"])
    x = framed.where((F.col("dir") == "in") & F.contains("frame", F.lit('"trades"'))).select("relpath", "line", "recv_ts_ms", F.posexplode(F.concat(snapshot, delta)).alias("item", "e"))
    return x.select("relpath", "line", "recv_ts_ms", "item", "e.market", F.col("e.t.tradeId").alias("trade_id"), F.col("e.t.outcomeId").alias("outcome"), F.col("e.t.price").alias("price"), F.col("e.t.qty").alias("qty"), F.col("e.t.ts").alias("ts_ms"))


def not_ours(framed: DataFrame, markets: list[str]) -> DataFrame:
    """Frames that name none of the markets, a list that one event has."""
    return framed.where(~F.exists(F.array(*map(F.lit, markets)), lambda m: F.contains("frame", m)))
