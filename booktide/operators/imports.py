"""Historical imports: which instruments are linked, candles and trades before the start, settlements in order of receipt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import eastern_day, fair_grade, price_e4, rational, whole_cents
from .trades import balance, greedy_match, match_candidates, occurrence

#: How results are named, how near a stream trade and a file's row must be, and the cents of a contract.
KALSHI_RESULT = {"yes": "win", "no": "lose", "scalar": "fair_value"}
NOVIG_RESULT = {"WIN": "win", "LOSS": "lose"}
MATCH_MS, MATCH_E4, CENTS_PER_CONTRACT = 120_000, 6, 1


def bounds(mappings: DataFrame, outcomes: DataFrame, claims: DataFrame, instruments: DataFrame) -> DataFrame:
    """The instruments whose data may be loaded, with their game's first pitch: instrument, venue, native_id, first_pitch_ms, why.

    why is null for those that may; two_games or no_first_pitch else. Rejected mappings link nothing.
    """
    m = mappings.where("status <> 'rejected'").join(outcomes.select("outcome_id", "event_id"), "outcome_id")
    g = m.groupBy("instrument").agg(F.count_distinct("event_id").alias("n"), F.min("event_id").alias("event_id"))
    pitch = claims.where("kind = 'first_pitch'").groupBy("event_id").agg(F.min("at_ms").alias("first_pitch_ms"))
    x = g.join(pitch, "event_id", "left").join(instruments, "instrument")
    why = F.when(F.col("n") > 1, "two_games").when(F.col("first_pitch_ms").isNull(), "no_first_pitch")
    return x.withColumn("why", why)


def before_pitch(rows: DataFrame, bound: DataFrame, native: str, at: str) -> DataFrame:
    """rows of linked instruments with instrument and the rest of bound, and late: whether they begin at or after the first pitch."""
    b = bound.where("why is null").drop("why", "n", "event_id").withColumnRenamed("native_id", native)
    return rows.join(b, native).withColumn("late", F.col(at) >= F.col("first_pitch_ms"))


def new_responses(rows: DataFrame, stored: DataFrame, key: tuple[str, ...] = ("relpath", "line")) -> DataFrame:
    """Rows whose response (by citation) no stored row cites."""
    return rows.join(stored.select(*key).distinct(), list(key), "left_anti")


def kalshi_candles(candles: DataFrame, bound: DataFrame) -> DataFrame:
    """Candles of linked markets with what becomes of each: verdict kept, after_first_pitch or crossed (bid close above ask close)."""
    x = before_pitch(candles, bound, "ticker", "interval_start_ms")
    crossed = F.coalesce(F.col("bid_close_e4") > F.col("ask_close_e4"), F.lit(False))
    return x.withColumn("verdict", F.when(F.col("late"), "after_first_pitch").when(crossed, "crossed").otherwise("kept")).drop("late")


def kalshi_trades(tape: DataFrame, bound: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(executions, sightings) of a tape: one execution for each trade id of an instrument, one sighting for each record of it.

    sightings has all rows with verdict: kept, after_first_pitch, or not_whole_cents (also for no payout). bound has payout_cents_per_contract.
    The execution takes the fields of its first record in order of receipt.
    """
    x = before_pitch(tape, bound, "ticker", "time_ms")
    x = x.withColumn("payout_cents", whole_cents(F.col("count"), F.col("payout_cents_per_contract")))
    whole = F.coalesce(F.col("payout_cents") > 0, F.lit(False))
    s = x.withColumn("verdict", F.when(F.col("late"), "after_first_pitch").when(~whole, "not_whole_cents").otherwise("kept")).drop("late")
    first = F.struct("recv_ts_ms", "relpath", "line", "pos")
    e = s.where("verdict = 'kept'").groupBy("instrument", F.col("trade_id").alias("execution_key")).agg(F.min_by(F.struct("price", "price_e4", "count", "payout_cents"), first).alias("r"), F.count(F.lit(1)).alias("sightings"))
    return e.select("instrument", "execution_key", F.lit(0).alias("side"), "r.*", "sightings"), s


def novig_daily(rows: DataFrame, bound: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(executions, sightings) of daily files: each MAKER row of a straight trade is an execution, TAKER rows only say whether their group balances.

    bound has side0_id and side1_id. A group (market and timestamp) that begins at or after the first pitch is dropped as a whole. Equal
    maker rows are told apart by their count in order, so a file published again only adds sightings. Price is cost / qty, exactly.
    sightings has all linked rows with verdict: combo, after_first_pitch, unknown_outcome, maker, or for takers balanced or ambiguous.
    """
    b = bound.where("why is null").select(F.col("native_id").alias("market"), "instrument", "first_pitch_ms", "side0_id", "side1_id")
    x = rows.join(b, "market").withColumn("straight", F.col("trade_type") == "STRAIGHT")
    group = ["request_id", "market", "timestamp"]
    first = F.min_by("ts_ms", F.when(F.col("straight"), F.col("item"))).over(Window.partitionBy(*group))
    side = F.when(F.col("outcome") == F.col("side0_id"), 0).when(F.col("outcome") == F.col("side1_id"), 1)
    x = x.withColumns({"late": first >= F.col("first_pitch_ms"), "side_no": side, "payout_cents": whole_cents(F.col("qty"), F.lit(100))})
    fair = balance(x.where("straight").select(*group, F.lower("side").alias("role"), F.col("qty").cast("decimal(38,9)").alias("qty"), "outcome"), group)
    x = x.join(fair, group, "left")
    verdict = F.when(~F.col("straight"), "combo").when(F.col("late"), "after_first_pitch").when(F.col("side_no").isNull(), "unknown_outcome").when(F.col("side") == "MAKER", "maker").otherwise(F.col("status"))
    x = x.withColumn("verdict", verdict)
    m = occurrence(x.where("verdict = 'maker'"), ["request_id", "outcome", "timestamp", "cost", "qty"], ["item"])
    key = F.concat_ws(":", F.lit("novig:maker"), "outcome", F.col("ts_ms").cast("string"), "cost", "qty", F.col("occurrence").cast("string"))
    e9 = lambda c: (F.col(c).cast("decimal(20,9)") * 1_000_000_000).cast("decimal(38,0)")
    m = m.withColumns({"execution_key": key, "p": rational(e9("cost"), e9("qty"))})
    pick = F.struct(F.col("side_no").alias("side"), F.col("p.num").alias("price_num"), F.col("p.den").alias("price_den"), "payout_cents", F.col("ts_ms").alias("time_ms"))
    e = m.groupBy("instrument", "execution_key").agg(F.min_by(pick, F.struct("recv_ts_ms", "relpath", "line", "item")).alias("r"), F.count(F.lit(1)).alias("sightings")).select("instrument", "execution_key", "r.*", "sightings")
    s = x.join(m.select("request_id", "item", "execution_key"), ["request_id", "item"], "left")
    return e, s.drop("late", "straight", "status", "first_pitch_ms", "side0_id", "side1_id")


def novig_stream(trades: DataFrame, bound: DataFrame, executions: DataFrame, days: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(executions, sightings) of streamed trades: matched to a maker row of their day's file, or on their own.

    trades: rows of venues.stream_trades; executions: those of novig_daily with price_e4; days: day (Eastern) of the files that are there.
    The first sighting of a trade counts. sightings has verdict: waiting (its day's file is not there), after_first_pitch, unknown_outcome,
    rule_matched or unmatched. A match has the same side and payout, lies within MATCH_MS and strictly less than MATCH_E4 apart, and no
    execution has two.
    """
    first = F.min_by(F.struct(*(c for c in trades.columns if c not in ("market", "trade_id"))), F.struct("recv_ts_ms", "relpath", "line", "item"))
    t = trades.groupBy("market", "trade_id").agg(first.alias("r")).select("market", "trade_id", "r.*")
    b = bound.where("why is null").select(F.col("native_id").alias("market"), "instrument", "first_pitch_ms", "side0_id", "side1_id")
    t = t.join(b, "market").withColumn("day", eastern_day(F.col("ts_ms")).cast("string"))
    t = t.join(days.select("day").distinct().withColumn("there", F.lit(True)), "day", "left")
    side = F.when(F.col("outcome") == F.col("side0_id"), 0).when(F.col("outcome") == F.col("side1_id"), 1)
    t = t.withColumns({"side": side, "payout_cents": whole_cents(F.col("qty"), F.lit(CENTS_PER_CONTRACT)), "price_e4": price_e4(F.col("price")), "stream_id": F.xxhash64("market", "trade_id")})
    early = F.when(F.col("there").isNull(), "waiting").when(F.col("ts_ms") >= F.col("first_pitch_ms"), "after_first_pitch").when(F.col("side").isNull(), "unknown_outcome")
    t = t.withColumn("verdict", early)
    open_ = t.where("verdict is null").select("instrument", "side", "payout_cents", "stream_id", F.col("ts_ms").alias("s_ms"), F.col("price_e4").alias("s_price"))
    e = executions.withColumn("execution_id", F.xxhash64("instrument", "execution_key"))
    near = match_candidates(open_, e.select("instrument", "side", "payout_cents", "execution_id", F.col("time_ms").alias("e_ms"), F.col("price_e4").alias("e_price")), ["instrument", "side", "payout_cents"], MATCH_MS, MATCH_E4)
    hit = greedy_match(near, ["instrument", "side", "payout_cents"], MATCH_MS)
    t = t.join(hit, "stream_id", "left").withColumn("verdict", F.coalesce("verdict", F.when(F.col("execution_id").isNotNull(), "rule_matched").otherwise("unmatched")))
    t = t.join(e.select("execution_id", F.col("execution_key").alias("_key")), "execution_id", "left")
    own = F.when(F.col("verdict") == "unmatched", F.concat(F.lit("novig:trade:"), "trade_id")).otherwise(F.col("_key"))
    t = t.withColumn("execution_key", own).drop("_key", "there", "first_pitch_ms", "side0_id", "side1_id", "stream_id", "execution_id")
    alone = t.where("verdict = 'unmatched'").select("instrument", "execution_key", "side", "price_e4", "payout_cents", F.col("ts_ms").alias("time_ms"))
    return alone, t


def schedule_settlements(games: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Results of Final games with exactly one winner, a row for each team: subject, event_id, outcome_id, result. outcomes: outcome_id, event_id, game_pk, team_id."""
    g = games.where("state = 'Final'")
    teams = F.array(*(F.struct(F.col(f"{s}_id").alias("team_id"), F.col(f"{s}_won").alias("won")) for s in ("away", "home")))
    g = g.where(F.coalesce(F.col("away_won") != F.col("home_won"), F.lit(False))).select("game_pk", "place", F.explode(teams).alias("t")).select("game_pk", "place", "t.*")
    x = g.join(outcomes, ["game_pk", "team_id"])
    return x.select(F.lit("mlb_statsapi").alias("source"), F.format_string("mlb:game:%s/team:%s", "game_pk", "team_id").alias("subject"), "event_id", "outcome_id", F.when(F.col("won"), "win").otherwise("lose").alias("result"), F.lit(None).cast("string").alias("value"), "place")


def _named(c: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(v) for kv in table.items() for v in kv)), c)


def kalshi_settlements(listings: DataFrame, instruments: DataFrame) -> DataFrame:
    """Results of settled listings for their yes side; verdict tells why a listing gives none: unsettled, not_stored or scalar_without_value."""
    result = _named(F.col("result"), KALSHI_RESULT)
    x = listings.join(instruments.select(F.col("native_id").alias("ticker"), "instrument"), "ticker", "left").withColumn("graded", result)
    settled = F.coalesce(F.col("status").isin("finalized", "settled"), F.lit(False)) & F.col("graded").isNotNull()
    value = F.when(F.col("graded") == "fair_value", F.nullif("settlement_value_dollars", F.lit("")))
    verdict = F.when(~settled, "unsettled").when(F.col("instrument").isNull(), "not_stored").when((F.col("graded") == "fair_value") & value.isNull(), "scalar_without_value").otherwise("kept")
    return x.select(F.lit("kalshi_hist").alias("source"), F.format_string("kalshi:market:%s/yes", "ticker").alias("subject"), "instrument", F.lit(0).alias("side"), F.col("graded").alias("result"), value.alias("value"), F.struct("place", "pos").alias("place"), verdict.alias("verdict"))


def novig_settlements(markets: DataFrame, instruments: DataFrame) -> DataFrame:
    """Results of settled markets for each outcome: won, lost, or a fair value between; verdict tells what gives none. instruments has side0_id and side1_id."""
    x = markets.select("market", "status", "place", F.posexplode("outcomes").alias("item", "o")).join(instruments.select(F.col("native_id").alias("market"), "instrument", "side0_id", "side1_id"), "market", "left")
    side = F.when(F.col("o.outcomeId") == F.col("side0_id"), 0).when(F.col("o.outcomeId") == F.col("side1_id"), 1)
    fair = fair_grade(F.col("o.status"))
    result = F.coalesce(_named(F.col("o.status"), NOVIG_RESULT), F.when(fair, "fair_value"))
    verdict = F.when(~F.coalesce(F.col("status") == "SETTLED", F.lit(False)), "unsettled").when(F.col("instrument").isNull(), "not_stored").when(side.isNull(), "not_a_side").when(result.isNull(), "unknown_grade").otherwise("kept")
    return x.select(F.lit("novig_hist").alias("source"), F.concat_ws("/", F.concat(F.lit("novig:market:"), "market"), F.col("o.outcomeId")).alias("subject"), "instrument", side.alias("side"), result.alias("result"), F.when(fair, F.col("o.status")).alias("value"), F.struct("place", "item").alias("place"), verdict.alias("verdict"))


def settle(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """incoming results with action: insert, repeat or considered; and supersedes, the place of the row that each insert replaces.

    incoming and stored: source, subject, result, value, place (receipt order, comparable). Results count in order of receipt. What is not
    after its subject's last stored row was considered when that row was stored. A result equal to the one before it is a repeat.
    """
    last = stored.groupBy("source", "subject").agg(F.max("place").alias("_last"), F.max_by(F.struct("result", "value"), "place").alias("_state"))
    x = incoming.join(last, ["source", "subject"], "left").withColumn("_old", F.coalesce(F.col("place") <= F.col("_last"), F.lit(False)))
    up = Window.partitionBy("source", "subject").orderBy("_old", "place")
    new = F.when(~F.col("_old"), F.struct("result", "value"))
    before = F.coalesce(F.lag(new).over(up), F.col("_state"))
    x = x.withColumn("_same", ~F.col("_old") & before.eqNullSafe(F.struct("result", "value")))
    kept = F.when(~F.col("_old") & ~F.col("_same"), F.col("place"))
    prev = F.coalesce(F.last(kept, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.col("_last"))
    action = F.when(F.col("_old"), "considered").when(F.col("_same"), "repeat").otherwise("insert")
    return x.select(*incoming.columns, action.alias("action"), F.when(action == "insert", prev).alias("supersedes"))


def out_of_order(stored: DataFrame) -> DataFrame:
    """Stored results that were received before one that had been stored earlier: such a history is refused. stored: source, subject, id, place."""
    before = F.max("place").over(Window.partitionBy("source", "subject").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    return stored.withColumn("_before", before).where(F.col("place") <= F.col("_before")).drop("_before")
