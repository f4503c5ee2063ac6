"""Closing prices: the live book as of a time, candles, trade windows, and what defines them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import SCALE, ladder, reduced
from ..functions.tables import held
from . import books, series, trades

#: The sources of a venue in order of preference, its status of an open market, gap reasons that are told as they are,
#: and the parameters of the definitions.
SOURCES = {"novig": ["stream", "poll"], "kalshi": ["poll"]}
OPEN_STATUS = {"novig": "OPEN", "kalshi": "active"}
QUARANTINE_REASONS = ["crossed_book"]
BUFFER_S, BUFFER_SWEEP_S, DEPTHS_USD, PRIMARY = 60, (0, 30, 60, 120, 600), (100, 500, 1000), "mid_depth_500"
MAX_QUOTE_AGE_S, STREAM_LIVE_S, POLL_LIVE_S, MAX_LAG_MS = 1800, 30, 30, 5000
VWAP_WINDOW_S, VWAP_EXECUTIONS, VWAP_USD = 600, 5, 250


@dataclass(frozen=True)
class LiveDef:
    """A close from a stored book."""

    name: str
    benchmark: str
    notional_usd: int | None = None
    buffer_s: int = BUFFER_S
    primary: bool = False
    max_quote_age_s: int = MAX_QUOTE_AGE_S
    stream_liveness_max_s: int = STREAM_LIVE_S
    poll_liveness_max_s: int = POLL_LIVE_S
    max_venue_lag_ms: int = MAX_LAG_MS
    family: str = "close_live"


@dataclass(frozen=True)
class HistDef:
    """A close from candles or from a window of trades."""

    name: str
    method: str
    buffer_s: int = BUFFER_S
    max_quote_age_s: int = MAX_QUOTE_AGE_S
    window_s: int | None = None
    min_executions: int | None = None
    min_usd: int | None = None
    family: str = "close_hist"


def live_definitions() -> list[LiveDef]:
    """The top of the book, and a midpoint for each depth."""
    depth = [LiveDef(f"close_live_mid_depth_{n}", "mid_depth", n, primary=PRIMARY == f"mid_depth_{n}") for n in DEPTHS_USD]
    return [LiveDef("close_live_mid_top", "mid_top", primary=PRIMARY == "mid_top"), *depth]


def historical_definitions(buffers: tuple[int, ...] = (BUFFER_S,)) -> list[HistDef]:
    """For each buffer the candle's close and the trade window's."""
    pair = lambda b: (HistDef("close_hist_candle_mid_top", "candle_mid_top", b), HistDef("close_hist_vwap", "trade_vwap", b, window_s=VWAP_WINDOW_S, min_executions=VWAP_EXECUTIONS, min_usd=VWAP_USD))
    return [d for b in buffers for d in pair(b)]


def canonical_json(value: object) -> str:
    """JSON with sorted keys and no spaces, whose hash identifies what it says."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def definition_rows(spark: SparkSession, defs: list[LiveDef | HistDef]) -> DataFrame:
    """name, family, params_json, params_sha256 of each definition."""
    texts = [(d.name, d.family, canonical_json(asdict(d))) for d in defs]
    return spark.createDataFrame([(*t, hashlib.sha256(t[2].encode()).hexdigest()) for t in texts], "name string, family string, params_json string, params_sha256 string")


def new_definitions(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The definitions that are not known yet: identity is the hash of the parameters."""
    return rows.dropDuplicates(["params_sha256"]).join(known.select("params_sha256"), "params_sha256", "left_anti").select(*rows.columns)


def _definitions(defs: list[LiveDef]) -> Column:
    """The definitions as an array of structs."""
    of = lambda d: F.struct(*(F.lit(v).cast(t).alias(k) for k, v, t in (
        ("def_name", d.name, "string"), ("benchmark", d.benchmark, "string"), ("cents", 100 * (d.notional_usd or 0), "long"), ("age", 1000 * d.max_quote_age_s, "long"),
        ("stream", 1000 * d.stream_liveness_max_s, "long"), ("poll", 1000 * d.poll_liveness_max_s, "long"), ("lag", d.max_venue_lag_ms, "long"),
    )))
    return F.array(*map(of, defs))


def book_state(requests: DataFrame, ticks: DataFrame, evidence: DataFrame) -> DataFrame:
    """The freshest source's book for each request (instrument, as_of_ms, sources), and what follows it.

    ticks: tick_id, instrument, source, observed_ms, venue_ms, status, truncated, complete, snapshot; evidence: instrument, source,
    observed_ms. Columns: source, tick (struct), last_ms (its latest sign of life), next_ms and next_snapshot (the first tick after the
    request), next_evidence_ms. The source with the latest sign of life wins, the first listed one on ties. A request without any tick
    has no row. Ticks and evidence go through one exchange together.
    """
    fields = ["tick_id", "observed_ms", "venue_ms", "status", "truncated", "complete", "snapshot"]
    asked = requests.select("instrument", "as_of_ms", "sources").distinct()
    wanted = asked.select("instrument").distinct()
    slots = asked.select("instrument", F.posexplode("sources").alias("rank", "source"), F.col("as_of_ms").alias("t"), F.lit(1).alias("kind"))
    marks = ticks.join(wanted, "instrument", "left_semi").select("instrument", "source", F.col("observed_ms").alias("t"), F.lit(0).alias("kind"), F.col("tick_id").alias("id"), F.struct(*fields).alias("tick"))
    signs = evidence.join(wanted, "instrument", "left_semi").select("instrument", "source", F.col("observed_ms").alias("t"), F.lit(0).alias("kind"), F.col("observed_ms").alias("sign"))
    rows = marks.unionByName(signs, allowMissingColumns=True).unionByName(slots, allowMissingColumns=True)
    by, order = ["instrument", "source"], ["kind", "id"]
    back = series.carried(rows, by, "t", order, {"at_tick": F.col("tick"), "at_sign": F.col("sign")})
    ahead = series.carried(back, by, "t", order, {"next_tick": F.when(F.col("tick").isNotNull(), F.struct("tick.observed_ms", "tick.snapshot")), "next_sign": F.col("sign")}, forward=True)
    found = ahead.where("kind = 1 and at_tick is not null").withColumn("last_ms", F.greatest("at_tick.observed_ms", "at_sign"))
    pick = F.struct("source", F.col("at_tick").alias("tick"), "last_ms", F.col("next_tick.observed_ms").alias("next_ms"), F.col("next_tick.snapshot").alias("next_snapshot"), F.col("next_sign").alias("next_evidence_ms"))
    best = found.groupBy("instrument", F.col("t").alias("as_of_ms")).agg(F.max_by(pick, F.struct("last_ms", -F.col("rank"))).alias("x"))
    return best.select("instrument", "as_of_ms", "x.*")


def bracket() -> Column:
    """When a later observation proves that the stored book was still the state, in book_state rows; else null.

    Evidence strictly before the next tick does; else the next tick if it rests on the same snapshot.
    """
    first = F.col("next_evidence_ms").isNotNull() & (F.col("next_ms").isNull() | (F.col("next_evidence_ms") < F.col("next_ms")))
    return F.when(first, F.col("next_evidence_ms")).when(F.col("next_snapshot") == F.col("tick.snapshot"), F.col("next_ms"))


def price_as_of(requests: DataFrame, ticks: DataFrame, evidence: DataFrame, gaps: DataFrame, levels: DataFrame, defs: list[LiveDef], open_status: dict[str, str] = OPEN_STATUS, gap_bucket_ms: int = series.BUCKET_MS) -> DataFrame:
    """The benchmark price of each request under each definition, or the first reason for which there is none.

    requests: request_id, venue, native_id, instrument, side, as_of_ms, sources; gaps: gap_id, scope, open_ms, close_ms, reason; levels:
    tick_id, side, rank, price_e4, payout_cents. See book_state for ticks and evidence. In order: no book at all, a gap between the book
    and the request (or what brackets it), a stalled feed, a halted market, a late venue, a stale book, and the benchmark's own reasons.
    p_num / p_den is exact. The spread is told even where there is no price.
    """
    requests = held(requests)
    state = held(book_state(requests, ticks, evidence))
    x = requests.join(state, ["instrument", "as_of_ms"], "left").withColumn("d", F.explode(_definitions(defs))).select("*", "d.*").drop("d")
    stream = F.col("source") == "stream"
    x = x.withColumns({"quote_age_ms": F.col("as_of_ms") - F.col("tick.observed_ms"), "liveness_age_ms": F.col("as_of_ms") - F.col("last_ms")})
    late = F.col("liveness_age_ms") > F.when(stream, F.col("stream")).otherwise(F.col("poll"))
    x = x.withColumn("bracket_ms", F.when(stream & late, bracket()))
    scope = F.concat("venue", F.lit(":market:"), "native_id", F.when(stream, "/book").otherwise(""))
    x = x.withColumns({"scope": scope, "from_ms": F.col("tick.observed_ms"), "to_ms": F.coalesce("bracket_ms", "as_of_ms")})
    spans = x.where("tick is not null").select("scope", "from_ms", "to_ms").distinct().withColumn("span_id", F.concat_ws("|", "scope", "from_ms", "to_ms"))
    hits = series.first_overlap(spans, gaps, gap_bucket_ms).where("gap_id is not null").select("scope", "from_ms", "to_ms", F.col("reason").alias("gap"))
    x = x.join(hits, ["scope", "from_ms", "to_ms"], "left")

    needed = x.where("tick is not null").select(F.col("tick.tick_id").alias("tick_id"), "cents").distinct()
    walks = books.depth_walk(levels.join(needed, "tick_id"), ["tick_id", "cents", "side"], F.col("cents"))
    x = x.withColumn("tick_id", F.col("tick.tick_id")).join(books.two_sided(walks, "tick_id", "cents"), ["tick_id", "cents"], "left")
    own = lambda c: F.when(F.col("side") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    other = lambda c: F.when(F.col("side") == 0, F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    top, empty = F.col("benchmark") == "mid_top", own("best_e4").isNull() | other("best_e4").isNull()
    short = ~top & ((own("taken") < F.col("cents")) | (other("taken") < F.col("cents")))
    num = F.when(top, own("best_e4") + SCALE - other("best_e4")).otherwise(own("paid_e4") + SCALE * F.col("cents") - other("paid_e4"))
    wanted = F.element_at(F.create_map(*(F.lit(v) for pair in open_status.items() for v in pair)), F.col("venue"))
    why = ladder([
        (F.col("tick").isNull(), "no_quotes"), (F.col("gap").isin(QUARANTINE_REASONS), "crossed_book"), (F.col("gap").isNotNull(), "collection_gap"),
        (late & F.col("bracket_ms").isNull(), "feed_stalled"), (~F.col("tick.status").eqNullSafe(wanted), "halted"),
        (F.col("tick.observed_ms") - F.col("tick.venue_ms") > F.col("lag"), "venue_lag"), (F.col("quote_age_ms") > F.col("age"), "stale_book"),
        (empty, "no_quotes"), (short & (F.col("tick.truncated") | ~F.col("tick.complete")), "truncated_ladder"), (short, "insufficient_depth"),
    ])
    x = x.withColumn("reason", why).withColumn("p", F.when(F.col("reason").isNull(), reduced(num, F.when(top, 2 * SCALE).otherwise(2 * SCALE * F.col("cents")))))
    spread = SCALE - other("best_e4") - own("best_e4")
    return x.select("request_id", "def_name", F.col("p.num").alias("p_num"), F.col("p.den").alias("p_den"), "reason", "tick_id", F.col("tick.observed_ms").alias("observed_ms"), "source", "quote_age_ms", "liveness_age_ms", "bracket_ms", spread.alias("spread_e4"))


def candle_close(requests: DataFrame, candles: DataFrame, max_age_ms: int) -> DataFrame:
    """The mid of the last candle that ends at or before each request, or why there is none.

    requests: request_id, instrument, side, as_of_ms; candles: candle_id, instrument, side, start_ms, end_ms, bid_close_e4, ask_close_e4.
    active says whether a candle strictly contains the request. Records of one end that differ make it ambiguous, before age counts. The
    other side's bid and ask are the complements of ask and bid. candle_id is the smallest of the end.
    """
    row = F.struct("side", "bid_close_e4", "ask_close_e4")
    ends = candles.groupBy("instrument", "end_ms").agg(F.count_distinct(row).alias("n"), F.min("candle_id").alias("candle_id"), F.min_by(row, "candle_id").alias("row"))
    x = series.asof_backward(requests, ends.select("instrument", "end_ms", "n", "candle_id", F.col("row.side").alias("candle_side"), F.col("row.bid_close_e4").alias("bid"), F.col("row.ask_close_e4").alias("ask")), "instrument", "as_of_ms", "end_ms", [], ["end_ms", "n", "candle_id", "candle_side", "bid", "ask"])

    # A candle that contains the request starts before it; the furthest end of all such candles decides.
    begun = candles.groupBy("instrument", "start_ms").agg(F.max("end_ms").alias("reach"))
    up = Window.partitionBy("instrument").orderBy("start_ms").rowsBetween(Window.unboundedPreceding, 0)
    reach = begun.withColumn("reach", F.max("reach").over(up))
    around = series.asof_backward(requests.select("request_id", "instrument", (F.col("as_of_ms") - 1).alias("before_ms")), reach, "instrument", "before_ms", "start_ms", [], ["reach"])
    x = x.join(around.select("request_id", "reach"), "request_id").withColumn("active", F.coalesce(F.col("reach") > F.col("as_of_ms"), F.lit(False)))
    age = F.col("as_of_ms") - F.col("end_ms")
    old = F.col("end_ms").isNull() | (age > max_age_ms)
    why = ladder([
        (F.col("n") > 1, "ambiguous_candle"), (old & F.col("active"), "ambiguous_candle"), (F.col("end_ms").isNull(), "no_quotes"), (old, "stale_book"),
        (F.col("bid").isNull() | F.col("ask").isNull(), "no_quotes"),
    ])
    flip = F.col("side") != F.col("candle_side")
    x = x.withColumns({"reason": why, "b": F.when(flip, SCALE - F.col("ask")).otherwise(F.col("bid")), "a": F.when(flip, SCALE - F.col("bid")).otherwise(F.col("ask"))})
    x = x.withColumn("p", F.when(F.col("reason").isNull(), reduced(F.col("a") + F.col("b"), F.lit(2 * SCALE))))
    spread = F.when(F.col("reason").isNull(), F.col("a") - F.col("b"))
    return x.select("request_id", F.col("p.num").alias("p_num"), F.col("p.den").alias("p_den"), "reason", "candle_id", "active", age.alias("quote_age_ms"), spread.alias("spread_e4"))


def vwap_close(requests: DataFrame, executions: DataFrame, d: HistDef) -> DataFrame:
    """The trade-weighted price of each request's window, or few_trades; counts are told either way.

    requests: request_id, instrument, side, as_of_ms; executions: instrument, side, time_ms, price_e4, payout_cents. Trades of the other
    side count at their complement.
    """
    got = trades.window_vwap(requests, executions, "instrument", 1000 * d.window_s)
    few = (F.col("n") < d.min_executions) | (F.col("payout") < 100 * d.min_usd)
    got = got.withColumn("p", F.when(~few, reduced(F.col("paid"), F.col("payout") * SCALE)))
    return got.select("request_id", F.col("p.num").alias("p_num"), F.col("p.den").alias("p_den"), F.when(few, "few_trades").alias("reason"), F.col("n").alias("executions"), F.col("payout").alias("payout_cents"), (F.col("as_of_ms") - F.col("last_ms")).alias("quote_age_ms"))
