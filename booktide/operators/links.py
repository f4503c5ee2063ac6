"""Which game a market settled on, and which games have what it takes: links, discovery, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import eastern_day
from . import closes, facts, series
from .facts import waterfall
from .trades import execution_time

#: Days around a ticker's date, longest game, how far starts may lie apart, names that differ between sources.
CANDIDATE_DAYS, GAME_MS, START_MS = 3, 8 * 3_600_000, 6 * 3_600_000
KALSHI_CODES = {"ARI": "AZ"}
NOVIG_NAMES = {"Athletics": "Oakland Athletics"}
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC"
REVIEWED, SAMPLE_SEED = 50, 20261014
LINK_RANK = {"rejected": 0, "fuzzy_candidate": 1, "manual_verified": 2, "exact": 2}
COHORT = ["exact", "manual_verified"]
OFFSETS_S = (86_400, 21_600, 3_600, 900)


def translated(c: Column, table: dict[str, str]) -> Column:
    """c by a small table of names; others stay."""
    return reduce(lambda e, kv: F.when(c == kv[0], kv[1]).otherwise(e), table.items(), c)


def ticker_date(ticker: Column) -> Column:
    """The date in a ticker such as KXMLBGAME-25APR03...; null if it has none."""
    part = lambda k: F.regexp_extract(ticker, r"^KXMLBGAME-([0-9]{2})([A-Z]{3})([0-9]{2})", k)
    at = F.instr(F.lit(MONTHS), part(2))
    found = F.when((part(2) != "") & (at > 0), F.concat(F.lit("20"), part(1), F.lit("-"), F.lpad((F.floor((at - 1) / 4) + 1).cast("string"), 2, "0"), F.lit("-"), part(3)))
    return found.try_cast("date")


def _reasons(*pairs: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*(F.when(t, F.lit(r) if isinstance(r, str) else r) for t, r in pairs)))


def kalshi_links(markets: DataFrame, games: DataFrame) -> DataFrame:
    """The game of each event of two markets, by the one Final game that it can have settled on: status clean, edge or excluded, and why.

    markets: event, ticker, status, result, close_ms. games: game, official_date, start_ms, final, away, home (codes), winner, double
    (header), moved. Candidates are the games of the two teams within CANDIDATE_DAYS of the ticker's date; the game started before the
    markets closed, GAME_MS before that at most. n_candidates and n_fits count them. An edge case is never proposed.
    """
    team = translated(F.substring_index("ticker", "-", -1), KALSHI_CODES)
    m = markets.withColumn("team", team)
    yes = F.when(F.col("result") == "yes", F.col("team"))
    e = m.groupBy("event").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin("finalized", "settled")).alias("n_settled"), F.array_sort(F.collect_set("team")).alias("teams"),
        F.array_sort(F.collect_set("result")).alias("results"), F.min(yes).alias("won"), F.max("close_ms").alias("close_ms"), F.array_sort(F.collect_list(F.struct("ticker", "result"))).alias("sides"),
    )
    e = e.withColumn("day", ticker_date(F.col("event")))
    g = games.select("*", F.array_sort(F.array("away", "home")).alias("teams"))
    pairs = g.select("teams").distinct().withColumn("known", F.lit(True))
    near = e.join(g, "teams").where(F.abs(F.datediff("official_date", "day")) <= CANDIDATE_DAYS)
    fits = F.col("final") & (F.col("start_ms") < F.col("close_ms")) & (F.col("close_ms") <= F.col("start_ms") + GAME_MS)
    one = F.when(fits, F.struct("game", "official_date", "start_ms", "winner", "double", "moved"))
    c = near.groupBy("event").agg(F.count(F.lit(1)).alias("n_candidates"), F.count(one).alias("n_fits"), F.min(one).alias("g"), F.collect_list(F.struct("start_ms", "double")).alias("others"))
    x = e.join(pairs, "teams", "left").join(c, "event", "left").withColumns({"n_candidates": F.coalesce("n_candidates", F.lit(0)), "n_fits": F.coalesce("n_fits", F.lit(0)), "known": F.coalesce("known", F.lit(False))})
    two, split = (F.col("n") == 2) & (F.col("n_settled") == 2), F.col("results") == F.array(F.lit("no"), F.lit("yes"))
    single = F.col("known") & (F.col("n_fits") == 1)
    double = F.col("g.double") | F.exists("others", lambda o: o.double & (F.abs(o.start_ms - F.col("g.start_ms")) < 2 * 86_400_000))
    why = F.when(~two, F.array(F.lit("not_two_settled_markets"))).otherwise(_reasons(
        (~split, "results"), (~F.col("known"), "unknown_teams"), (F.col("known") & (F.col("n_fits") != 1), "not_one_final_game"),
        (single & ~F.col("g.winner").eqNullSafe(F.col("won")), "winner_disagrees"), (single & double, "doubleheader"), (single & F.col("g.moved"), "moved"),
        (single & F.col("day").isNotNull() & (F.col("g.official_date") != F.col("day")), "other_day"),
    ))
    scalar = F.col("results") == F.array(F.lit("scalar"))
    status = F.when(~two | (scalar & ~single), "excluded").when(F.size("reasons") == 0, "clean").when(scalar, "excluded").otherwise("edge")
    x = x.withColumn("reasons", why)
    return x.select("event", F.when(two & single, F.col("g.game")).alias("game"), status.alias("status"), "reasons", "n_candidates", "n_fits", "sides", F.when(two & single & F.col("won").eqNullSafe(F.col("g.winner")), True).otherwise(False).alias("mapped"))


def novig_links(markets: DataFrame, events: DataFrame, games: DataFrame) -> DataFrame:
    """The game of each market by its event's two names and start: status clean or edge, and why.

    markets: market, event, status, outcomes (array of name, grade). events: event, away, home, starts_ms, status. games as in kalshi_links,
    with away_name and home_name. Clean needs exactly one game whose start is within START_MS, outcomes that are its teams, a settled
    market and a Final game whose winner is the one graded WIN.
    """
    m = markets.join(events.select("event", "away", "home", "starts_ms", F.col("status").alias("event_status")), "event", "left")
    g = games.select("game", "start_ms", "final", "winner", "double", "moved", F.col("away").alias("away_code"), F.col("home").alias("home_code"), translated(F.col("away_name"), NOVIG_NAMES).alias("away"), translated(F.col("home_name"), NOVIG_NAMES).alias("home"))
    near = m.select("market", "away", "home", "starts_ms").join(g, ["away", "home"]).where(F.abs(F.col("start_ms") - F.col("starts_ms")) <= START_MS)
    c = near.groupBy("market").agg(F.count(F.lit(1)).alias("n_candidates"), F.min(F.struct("game", "final", "winner", "double", "moved", "away_code", "home_code")).alias("g"))
    x = m.join(c, "market", "left").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    named = F.col("away").isNotNull() & F.col("starts_ms").isNotNull()
    one = named & (F.col("n_candidates") == 1)
    teams = F.array_sort(F.array_distinct(F.transform("outcomes", lambda o: o["name"]))) == F.array_sort(F.array("g.away_code", "g.home_code"))
    same = one & teams
    settled = (F.col("status") == "SETTLED") & F.coalesce(F.col("event_status") == "FINAL", F.lit(False))
    ended = F.col("g.final") & F.col("g.winner").isNotNull()
    graded = F.transform(F.filter("outcomes", lambda o: o["grade"] == "WIN"), lambda o: o["name"]) == F.array("g.winner")
    why = _reasons(
        (~named, "no_names_or_start"), (named & (F.col("n_candidates") != 1), "not_one_game"), (one & ~teams, "other_outcomes"), (same & ~settled, "unsettled"),
        (same & settled & ~ended, "no_winner"), (same & settled & ended & ~graded, "grade_disagrees"), (same & F.col("g.double"), "doubleheader"), (same & F.col("g.moved"), "moved"),
    )
    x = x.withColumn("reasons", why)
    return x.select("market", F.when(one, F.col("g.game")).alias("game"), F.when(F.size("reasons") == 0, "clean").otherwise("edge").alias("status"), "reasons", "n_candidates", F.coalesce(same & settled & ended & graded, F.lit(False)).alias("mapped"))


def review_sample(links: DataFrame, key: str, n: int = REVIEWED, seed: int = SAMPLE_SEED) -> DataFrame:
    """Clean links for a person to look at: n at most, drawn by a hash of key and seed, the same on each run."""
    return links.where("status = 'clean'").orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def discovery(schedule: DataFrame, novig: DataFrame, kalshi: DataFrame) -> DataFrame:
    """The schedule's games with the markets and events of two catalogs that can be theirs: game, novig (markets), kalshi (events), sorted.

    schedule: game, start_ms, away, home, codes (two); novig: market, start_ms, names; kalshi: event, day, codes. A Novig market has the
    same set of names and starts within START_MS; a Kalshi event the same set of codes on the game's Eastern day. Several may fit.
    """
    s = schedule.select("game", "start_ms", F.array_sort(F.array("away", "home")).alias("names"), F.array_sort("codes").alias("codes"), eastern_day(F.col("start_ms")).alias("day"))
    n = novig.select("market", F.col("start_ms").alias("n_ms"), F.array_sort("names").alias("names"))
    found = s.join(n, "names").where(F.abs(F.col("start_ms") - F.col("n_ms")) <= START_MS).groupBy("game").agg(F.array_sort(F.collect_set("market")).alias("novig"))
    k = kalshi.select("event", "day", F.array_sort("codes").alias("codes"))
    events = s.join(k, ["codes", "day"]).groupBy("game").agg(F.array_sort(F.collect_set("event")).alias("kalshi"))
    empty = F.array().cast("array<string>")
    return s.select("game", "start_ms").join(found, "game", "left").join(events, "game", "left").withColumns({"novig": F.coalesce("novig", empty), "kalshi": F.coalesce("kalshi", empty)})


def league_events(markets: DataFrame, overrides: DataFrame, now_ms: int, horizon_ms: int, lead_ms: int, tail_ms: int) -> DataFrame:
    """Events of a league's catalog with their capture window: event, starts_ms, markets (sorted), open_ms, close_ms.

    markets: event, market, starts_ms (null where the catalog has none); overrides: event, starts_ms, which goes first. Events without a
    start or beyond the horizon are left out.
    """
    g = markets.groupBy("event").agg(F.min("starts_ms").alias("listed_ms"), F.array_sort(F.collect_set("market")).alias("markets"))
    x = g.join(overrides.select("event", F.col("starts_ms").alias("own_ms")), "event", "left").withColumn("starts_ms", F.coalesce("own_ms", "listed_ms"))
    x = x.where((F.col("starts_ms") <= now_ms + horizon_ms) & (F.col("starts_ms") >= now_ms - tail_ms))
    return x.select("event", "starts_ms", "markets", (F.col("starts_ms") - lead_ms).alias("open_ms"), (F.col("starts_ms") + tail_ms).alias("close_ms"))


def merged_captures(before: DataFrame, now: DataFrame, at_ms: int) -> DataFrame:
    """What is captured (event, markets, open_ms, close_ms) after a new look at the catalogs, without losing a capture that runs.

    Before a window opens the newest look counts; while it is open its markets only grow and its ends only widen; after it has closed it
    stays as it was. Events that only one side has stay.
    """
    old = before.select("event", F.col("markets").alias("m0"), F.col("open_ms").alias("o0"), F.col("close_ms").alias("c0"))
    new = now.select("event", F.col("markets").alias("m1"), F.col("open_ms").alias("o1"), F.col("close_ms").alias("c1"))
    x = old.join(new, "event", "full")
    waiting, over = F.col("o0") > at_ms, F.col("c0") <= at_ms
    pick = lambda a, b, both: F.when(F.col(a).isNull(), F.col(b)).when(F.col(b).isNull() | over, F.col(a)).when(waiting, F.col(b)).otherwise(both)
    return x.select("event", F.array_sort(pick("m0", "m1", F.array_union("m0", "m1"))).alias("markets"), pick("o0", "o1", F.least("o0", "o1")).alias("open_ms"), pick("c0", "c1", F.greatest("c0", "c1")).alias("close_ms"))


def with_overrides(manual: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Manual rows, and those found rows whose key no manual row has."""
    return manual.unionByName(found.join(manual.select(key), key, "left_anti"))


def capture_window(start_ms: Column, lead_ms: Column | int, tail_ms: Column | int, lead: Column | None = None, tail: Column | None = None) -> tuple[Column, Column]:
    """(open, close) around a start; a row's own lead or tail goes before the defaults."""
    value = lambda own, default: F.coalesce(own, F.lit(default)) if own is not None else F.lit(default)
    return start_ms - value(lead, lead_ms), start_ms + value(tail, tail_ms)


def home_outcomes(outcomes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each event's home outcome: the one whose abbreviation the official alias's JSON names as home. outcomes: outcome_id, event_id, abbreviation; aliases: event_id, provider, detail."""
    a = aliases.where("provider = 'mlb_statsapi'").select("event_id", F.get_json_object("detail", "$.home").alias("abbreviation"))
    return outcomes.join(a, ["event_id", "abbreviation"]).groupBy("event_id").agg(F.min("outcome_id").alias("outcome_id"))


def best_details(aliases: DataFrame) -> DataFrame:
    """Each event's official detail: a Final one before others, then the newest. aliases: alias_id, event_id, provider, detail."""
    final = F.coalesce(F.get_json_object("detail", "$.status") == "Final", F.lit(False))
    return aliases.where("provider = 'mlb_statsapi'").groupBy("event_id").agg(F.max_by("detail", F.struct(final, "alias_id")).alias("detail"))


def linked_instrument(mappings: DataFrame, instruments: DataFrame, outcomes: DataFrame, homes: DataFrame, venue: str) -> DataFrame:
    """The instrument whose data an event is judged by: event_id, link (the weakest status of its sides), instrument.

    For Kalshi side 0 must map directly to the home outcome; of several the best linked one, then the smallest.
    """
    rank = reduce(lambda e, kv: F.when(F.col("status") == kv[0], kv[1]).otherwise(e), LINK_RANK.items(), F.lit(0))
    m = mappings.join(instruments.where(F.col("venue") == venue).select("instrument"), "instrument").join(outcomes.select("outcome_id", "event_id"), "outcome_id").join(homes.select("event_id", F.col("outcome_id").alias("home")), "event_id", "left")
    usable = F.lit(True) if venue == "novig" else F.coalesce((F.col("side") == 0) & (F.col("polarity") == "direct") & (F.col("outcome_id") == F.col("home")), F.lit(False))
    i = m.withColumns({"rank": rank, "ok": usable}).groupBy("event_id", "instrument").agg(F.min(F.struct("rank", "side", "status")).alias("w"), F.max("ok").alias("ok")).where("ok")
    return i.groupBy("event_id").agg(F.max_by(F.struct("w.status", "instrument"), F.struct("w.rank", -F.col("instrument"))).alias("b")).select("event_id", F.col("b.status").alias("link"), F.col("b.instrument").alias("instrument"))


def _candle_ages(wanted: DataFrame, candles: DataFrame, max_age_ms: int) -> DataFrame:
    """wanted (event_id, offset_s, instrument, at_ms) with age_s: from the end of the last candle with bid and ask closes at or before at_ms, null beyond the limit."""
    whole = candles.where("bid_close_e4 is not null and ask_close_e4 is not null").select("instrument", "end_ms").distinct()
    x = series.asof_backward(wanted, whole, "instrument", "at_ms", "end_ms", [], ["end_ms"])
    age = F.col("at_ms") - F.col("end_ms")
    return x.select("event_id", "offset_s", F.when(age < max_age_ms, F.floor(age / 1000)).alias("age_s"))


def coverage(events: DataFrame, aliases: DataFrame, outcomes: DataFrame, instruments: DataFrame, mappings: DataFrame, claims: DataFrame, candles: DataFrame, sightings: DataFrame, executions: DataFrame, max_span_ms: int = facts.MAX_SPAN_MS) -> DataFrame:
    """A row for each game: what its official record says, its start, and for each venue the link, the data around the cutoff, and ok or the first reason.

    events: event_id, game; mappings: rows of identity.current_mappings; sightings: execution_id, instrument, role, venue_ts_ms,
    sighting_id; executions: execution_id, instrument, payout_cents. Kalshi needs a candle before the cutoff, Novig enough trades in the
    window before it. Kalshi's trades count by any sighting's time, Novig's by the execution's own.
    """
    starts = facts.resolve_start(claims, "event_id", max_span_ms).select("event_id", "earliest", F.coalesce("reason", F.lit("trusted")).alias("off"))
    homes = home_outcomes(outcomes, aliases)
    value = lambda k: F.get_json_object("detail", f"$.{k}").alias(k)
    x = events.join(best_details(aliases), "event_id", "left").join(starts, "event_id", "left")
    x = x.select("event_id", "game", value("official_date"), value("status"), value("double_header"), F.coalesce("off", F.lit("no_trusted_off")).alias("off"), F.col("earliest").alias("start_ms"))
    x = x.withColumn("cutoff_ms", F.when(F.col("off") == "trusted", F.col("start_ms") - 1000 * closes.BUFFER_S))
    for venue in ("kalshi", "novig"):
        own = linked_instrument(mappings, instruments, outcomes, homes, venue).select("event_id", F.col("link").alias(f"{venue}_link"), F.col("instrument").alias(f"{venue}_instrument"))
        x = x.join(own, "event_id", "left").withColumn(f"{venue}_link", F.coalesce(f"{venue}_link", F.lit("none")))

    window = 1000 * closes.VWAP_WINDOW_S
    cut = x.where("cutoff_ms is not null")
    at = cut.where("kalshi_instrument is not null").select("event_id", F.col("kalshi_instrument").alias("instrument"), "start_ms", "cutoff_ms")
    points = F.array(F.struct(F.lit(0).alias("offset_s"), F.col("cutoff_ms").alias("at_ms")), *(F.struct(F.lit(o).alias("offset_s"), (F.col("start_ms") - 1000 * o).alias("at_ms")) for o in OFFSETS_S))
    ages = _candle_ages(at.select("event_id", "instrument", F.explode(points).alias("p")).select("event_id", "instrument", "p.*"), candles, 1000 * closes.MAX_QUOTE_AGE_S)
    ages = ages.groupBy("event_id").pivot("offset_s", [0, *OFFSETS_S]).agg(F.first("age_s"))
    x = x.join(ages.select("event_id", F.col("0").alias("kalshi_candle_age_s"), *(F.col(str(o)).alias(f"kalshi_candle_age_s_at_{o}") for o in OFFSETS_S)), "event_id", "left")

    near = lambda t: (F.col(t) >= F.col("cutoff_ms") - window) & (F.col(t) < F.col("cutoff_ms"))
    seen = at.join(sightings.select("instrument", "execution_id", "venue_ts_ms"), "instrument").where(near("venue_ts_ms"))
    x = x.join(seen.groupBy("event_id").agg(F.count_distinct("execution_id").alias("_k")), "event_id", "left")
    times = execution_time(sightings).join(executions.select("execution_id", "instrument", "payout_cents"), "execution_id")
    own = cut.where("novig_instrument is not null").select("event_id", F.col("novig_instrument").alias("instrument"), "cutoff_ms").join(times, "instrument").where(near("time_ms"))
    x = x.join(own.groupBy("event_id").agg(F.count(F.lit(1)).alias("_n"), F.sum("payout_cents").alias("_cents")), "event_id", "left")
    has = lambda v: F.col("cutoff_ms").isNotNull() & F.col(f"{v}_instrument").isNotNull()
    x = x.withColumns({
        "kalshi_trades_in_window": F.when(has("kalshi"), F.coalesce("_k", F.lit(0))), "novig_executions_in_window": F.when(has("novig"), F.coalesce("_n", F.lit(0))),
        "novig_window_payout_cents": F.when(has("novig"), F.coalesce("_cents", F.lit(0)).cast("long")),
    })
    enough = (F.col("novig_executions_in_window") >= closes.VWAP_EXECUTIONS) & (F.col("novig_window_payout_cents") >= 100 * closes.VWAP_USD)

    def reason(venue: str, there: Column, missing: str) -> Column:
        link, one = F.col(f"{venue}_link"), F.col(f"{venue}_instrument")
        return F.when(F.col("off") != "trusted", F.col("off")).when((link == "none") | one.isNull(), "no_link").when(~link.isin(COHORT), "mapping_unverified").when(there, "ok").otherwise(missing)

    x = x.withColumns({"kalshi_reason": reason("kalshi", F.col("kalshi_candle_age_s").isNotNull(), "no_candle_before_cutoff"), "novig_reason": reason("novig", F.coalesce(enough, F.lit(False)), "vwap_insufficient")})
    return x.drop("_k", "_n", "_cents", "kalshi_instrument", "novig_instrument")


def coverage_waterfall(table: DataFrame, venue: str) -> DataFrame:
    """How many games drop out at each step of a venue, and how many are left."""
    last = "no_candle_before_cutoff" if venue == "kalshi" else "vwap_insufficient"
    return waterfall(table, ["no_trusted_off", "off_disagreement", "no_link", "mapping_unverified", last], F.col(f"{venue}_reason"))


def candle_conflicts(candles: DataFrame) -> DataFrame:
    """How many intervals of an instrument have records that differ in their closes: one row, conflicts."""
    pair = F.struct(F.coalesce("bid_close_e4", F.lit(-1)), F.coalesce("ask_close_e4", F.lit(-1)))
    return candles.groupBy("instrument", "end_ms").agg(F.count_distinct(pair).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("conflicts"))


def by_market_windows(events: DataFrame, key: str = "event") -> DataFrame:
    """The longest hole between the capture windows of each key: key, longest_ms (0 without holes)."""
    reach = F.max("close_ms").over(Window.partitionBy(key).orderBy("open_ms", "close_ms").rowsBetween(Window.unboundedPreceding, -1))
    return events.withColumn("_h", F.greatest(F.col("open_ms") - reach, F.lit(0))).groupBy(key).agg(F.coalesce(F.max("_h"), F.lit(0)).alias("longest_ms"))
