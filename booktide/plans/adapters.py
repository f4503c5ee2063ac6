"""Views of the supplied tables as market data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import DAY_MS, epoch_ms


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ticks(spark: SparkSession, d: str) -> DataFrame:
    """events as ticks of an instrument for each user."""
    e = read(spark, d, "events")
    return e.select(F.col("user_id").alias("instrument"), F.col("event_id").alias("tick_id"), epoch_ms(F.col("ts")).alias("at_ms"), (F.floor(F.col("value") * 20) % 10001).cast("int").alias("price_e4"), F.col("event_type").alias("status"))


def evidence(spark: SparkSession, d: str) -> DataFrame:
    return ticks(spark, d).where("status = 'view'").select("instrument", F.col("tick_id").alias("evidence_id"), "at_ms")


def grid(spark: SparkSession, d: str) -> DataFrame:
    """A request for each instrument and day of 2024-01, at noon."""
    start = 1704067200000 + DAY_MS // 2
    users = read(spark, d, "events").select(F.col("user_id").alias("instrument")).distinct()
    return users.withColumn("as_of_ms", F.explode(F.expr(f"transform(sequence(0, 29), k -> {start}L + k * {DAY_MS}L)")))


def gap_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each error opens a gap; the user's next signup closes it."""
    t = ticks(spark, d)
    nxt = F.min(F.when(F.col("status") == "signup", F.struct("at_ms", "tick_id"))).over(Window.partitionBy("instrument").orderBy("at_ms", "tick_id").rowsBetween(1, Window.unboundedFollowing))
    e = t.withColumn("_c", nxt).where("status = 'error'")
    opens = e.select(F.col("tick_id").alias("gap_id"), F.col("instrument").alias("scope"), F.col("at_ms").alias("open_ms"), F.when(F.col("price_e4") % 5 == 0, "crossed_book").otherwise("sequence_gap").alias("reason"))
    closes = e.where("_c is not null").select(F.col("tick_id").alias("opens_gap_id"), F.col("_c.at_ms").alias("close_ms"))
    return opens, closes


def levels(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as book levels: book, side, price_e4, payout_cents; ranked by price, then the row's own values."""
    li = read(spark, d, "lineitem")
    x = li.select(F.col("l_orderkey").alias("book"), (F.col("l_linestatus") == "O").cast("int").alias("side"), (1000 + F.col("l_partkey") % 4000).cast("int").alias("price_e4"), (F.col("l_quantity") * 100).cast("long").alias("payout_cents"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    w = Window.partitionBy("book", "side").orderBy(F.col("price_e4").desc(), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return x.withColumn("rank", F.row_number().over(w) - 1)


def executions(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("instrument"), epoch_ms(F.col("l_shipdate")).alias("time_ms"), (1000 + F.round(F.col("l_discount") * 10000).cast("int")).alias("price_e4"), (F.col("l_quantity") * 100).cast("long").alias("payout_cents"))


def observations(spark: SparkSession, d: str) -> DataFrame:
    """orders as versions of a mapping for each customer; every seventh link is missing, which leaves branches."""
    o = read(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    link = F.when(F.col("o_orderkey") % 7 != 0, F.lag("o_orderkey").over(w))
    status = F.when(F.col("o_orderpriority").startswith("1"), "rejected").when(F.col("o_orderpriority").startswith("2"), "proposed").otherwise("exact")
    equal = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderkey") % 11 == 0, "not_equivalent").otherwise("equivalent")
    return o.select(F.col("o_custkey").alias("instrument"), F.col("o_orderkey").alias("id"), link.alias("supersedes"), status.alias("status"), equal.alias("equivalence"), F.col("o_orderstatus").alias("result"), epoch_ms(F.col("o_orderdate")).alias("at_ms"))


#: The same views in DuckDB SQL.
SQL = {
    "ticks": "SELECT user_id AS instrument, event_id AS tick_id, epoch_us(ts) // 1000 AS at_ms, CAST(CAST(floor(value * 20) AS BIGINT) % 10001 AS INTEGER) AS price_e4, event_type AS status FROM events",
    "evidence": "SELECT instrument, tick_id AS evidence_id, at_ms FROM ticks WHERE status = 'view'",
    "grid": "SELECT instrument, 1704067200000 + 43200000 + k * 86400000 AS as_of_ms FROM (SELECT DISTINCT user_id AS instrument FROM events), range(0, 30) t(k)",
    "gaps": """SELECT e.tick_id AS gap_id, e.instrument AS scope, e.at_ms AS open_ms,
        (SELECT min(s.at_ms) FROM ticks s WHERE s.instrument = e.instrument AND s.status = 'signup' AND (s.at_ms, s.tick_id) > (e.at_ms, e.tick_id)) AS close_ms,
        CASE WHEN e.price_e4 % 5 = 0 THEN 'crossed_book' ELSE 'sequence_gap' END AS reason FROM ticks e WHERE e.status = 'error'""",
    "levels": """SELECT l_orderkey AS book, CAST(l_linestatus = 'O' AS INTEGER) AS side, CAST(1000 + l_partkey % 4000 AS INTEGER) AS price_e4, CAST(l_quantity * 100 AS BIGINT) AS payout_cents,
        row_number() OVER (PARTITION BY l_orderkey, l_linestatus = 'O' ORDER BY 1000 + l_partkey % 4000 DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS rank FROM lineitem""",
    "executions": "SELECT l_suppkey AS instrument, epoch_us(l_shipdate) // 1000 AS time_ms, CAST(1000 + round(l_discount * 10000) AS INTEGER) AS price_e4, CAST(l_quantity * 100 AS BIGINT) AS payout_cents FROM lineitem",
    "observations": """SELECT o_custkey AS instrument, o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS supersedes,
        CASE WHEN o_orderpriority LIKE '1%' THEN 'rejected' WHEN o_orderpriority LIKE '2%' THEN 'proposed' ELSE 'exact' END AS status,
        CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderkey % 11 = 0 THEN 'not_equivalent' ELSE 'equivalent' END AS equivalence, o_orderstatus AS result, epoch_us(o_orderdate) // 1000 AS at_ms FROM orders""",
}


def sql(body: str, *views: str) -> str:
    """A query over some of the views, each of which may use those before it. A body that begins with a comma goes on with views of its own."""
    every = {*views}.union(*(_NEEDS.get(v, set()) for v in views))
    needed = [v for v in SQL if v in every]
    return "WITH " + ", ".join(f"{v} AS ({SQL[v]})" for v in needed) + (body if body.startswith(",") else f" {body}") if needed else body


def live_facts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """events as a live market: ticks of two sources, signs of life, gaps by scope, and three levels for each side of a tick."""
    t, n = ticks(spark, d), F.col("tick_id")
    source = F.when(n % 4 == 0, "poll").otherwise("stream")
    marks = t.select(
        "tick_id", "instrument", source.alias("source"), F.col("at_ms").alias("observed_ms"), F.when(n % 10 != 0, F.col("at_ms") - n % 6000).alias("venue_ms"),
        F.when(F.col("status") == "error", "SUSPENDED").otherwise("OPEN").alias("status"), (n % 5 == 0).alias("truncated"), (n % 7 != 0).alias("complete"),
        F.concat_ws("/", F.col("instrument").cast("string"), F.floor(n / 2000).cast("string")).alias("snapshot"),
    )
    signs = t.where("status = 'view'").select("instrument", source.alias("source"), (F.col("at_ms") + 3_600_000).alias("observed_ms"))
    opens, closed = gap_rows(spark, d)
    gaps = opens.join(closed, opens.gap_id == closed.opens_gap_id, "left").select("gap_id", F.concat(F.lit("novig:market:"), F.col("scope").cast("string"), F.when(F.col("gap_id") % 3 == 0, "").otherwise("/book")).alias("scope"), "open_ms", "close_ms", "reason")
    ladder = marks.select("tick_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("side")).withColumn("rank", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("not (side = 1 and tick_id % 11 = 0)")
    levels_ = ladder.select("tick_id", "side", "rank", (2000 + (n * 13 + F.col("side") * 700) % 2600 - F.col("rank") * 100).cast("int").alias("price_e4"), (3000 + (n * (F.col("rank") + 3) * 17) % 40000).cast("long").alias("payout_cents"))
    return {"ticks": marks, "evidence": signs, "gaps": gaps, "levels": levels_}


def claims(spark: SparkSession, d: str) -> DataFrame:
    """events as claims of an event's start: of the official source, of the venue, and of a kind that is none."""
    kinds = {"purchase": ("mlb_statsapi", "first_pitch"), "signup": ("mlb_statsapi", "status_in_progress"), "click": ("novig_stream", "venue_golive"), "view": ("mlb_statsapi", "warmup")}
    source = kind = F.lit(None).cast("string")
    for status, (s, k) in kinds.items():
        source, kind = F.when(F.col("status") == status, s).otherwise(source), F.when(F.col("status") == status, k).otherwise(kind)
    return ticks(spark, d).select((F.col("instrument") * 1000 + F.floor(F.col("at_ms") / (2 * DAY_MS)) % 1000).alias("event_id"), source.alias("source"), kind.alias("kind"), "at_ms")


def book_candles(spark: SparkSession, d: str) -> DataFrame:
    """Hourly candles of bid and ask from events; every ninth lacks its ask, and some ends have a second record that differs."""
    t = ticks(spark, d).withColumn("start_ms", F.floor(F.col("at_ms") / 3_600_000) * 3_600_000)
    c = t.groupBy("instrument", "start_ms").agg(F.min("tick_id").alias("candle_id"), F.max_by("price_e4", F.struct("at_ms", "tick_id")).alias("close"), F.max("tick_id").alias("last"))
    end, ask = F.col("start_ms") + 3_600_000, F.when(F.col("candle_id") % 9 != 0, F.col("close") + 200)
    one = c.select("candle_id", "instrument", (F.col("instrument") % 2).cast("int").alias("side"), "start_ms", end.alias("end_ms"), F.col("close").alias("bid_close_e4"), ask.cast("int").alias("ask_close_e4"))
    two = c.where("last <> candle_id").select((F.col("last") + 1_000_000_000).alias("candle_id"), "instrument", (F.col("instrument") % 2).cast("int").alias("side"), "start_ms", end.alias("end_ms"), (F.col("close") + F.col("last") % 2).cast("int").alias("bid_close_e4"), ask.cast("int").alias("ask_close_e4"))
    return one.union(two)


SQL |= {
    "lticks": """SELECT tick_id, instrument, CASE WHEN tick_id % 4 = 0 THEN 'poll' ELSE 'stream' END AS source, at_ms AS observed_ms, CASE WHEN tick_id % 10 <> 0 THEN at_ms - tick_id % 6000 END AS venue_ms,
        CASE WHEN status = 'error' THEN 'SUSPENDED' ELSE 'OPEN' END AS status, tick_id % 5 = 0 AS truncated, tick_id % 7 <> 0 AS complete, instrument || '/' || (tick_id // 2000) AS snapshot FROM ticks""",
    "lsigns": "SELECT instrument, CASE WHEN tick_id % 4 = 0 THEN 'poll' ELSE 'stream' END AS source, at_ms + 3600000 AS observed_ms FROM ticks WHERE status = 'view'",
    "lgaps": "SELECT gap_id, 'novig:market:' || scope || CASE WHEN gap_id % 3 = 0 THEN '' ELSE '/book' END AS scope, open_ms, close_ms, reason FROM gaps",
    "llevels": "SELECT tick_id, side, rank, 2000 + (tick_id * 13 + side * 700) % 2600 - rank * 100 AS price_e4, 3000 + (tick_id * (rank + 3) * 17) % 40000 AS payout_cents FROM ticks, range(0, 2) s(side), range(0, 3) r(rank) WHERE NOT (side = 1 AND tick_id % 11 = 0)",
    "claims": """SELECT instrument * 1000 + at_ms // 172800000 % 1000 AS event_id, CASE WHEN status IN ('purchase', 'signup', 'view') THEN 'mlb_statsapi' WHEN status = 'click' THEN 'novig_stream' END AS source,
        CASE status WHEN 'purchase' THEN 'first_pitch' WHEN 'signup' THEN 'status_in_progress' WHEN 'click' THEN 'venue_golive' WHEN 'view' THEN 'warmup' END AS kind, at_ms FROM ticks""",
    "hours": "SELECT instrument, at_ms // 3600000 * 3600000 AS start_ms, min(tick_id) AS candle_id, arg_max(price_e4, (at_ms, tick_id)) AS close, max(tick_id) AS last FROM ticks GROUP BY 1, 2",
    "bcandles": """SELECT candle_id, instrument, instrument % 2 AS side, start_ms, start_ms + 3600000 AS end_ms, close AS bid, CASE WHEN candle_id % 9 <> 0 THEN close + 200 END AS ask FROM hours
        UNION ALL SELECT last + 1000000000, instrument, instrument % 2, start_ms, start_ms + 3600000, close + last % 2, CASE WHEN candle_id % 9 <> 0 THEN close + 200 END FROM hours WHERE last <> candle_id""",
}
_NEEDS = {"lticks": {"ticks"}, "lsigns": {"ticks"}, "lgaps": {"ticks", "gaps"}, "llevels": {"ticks"}, "claims": {"ticks"}, "hours": {"ticks"}, "bcandles": {"ticks", "hours"}, "evidence": {"ticks"}, "gaps": {"ticks"}}
