"""Registered queries of the market operators, each with its twin in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import books, facts, series, stats, trades
from . import adapters as A
from .adapters import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DEPTH, DAY = 5_000, S.DAY_MS


def query(twin: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if twin:
            ORACLE[f.__name__] = twin
        return f

    return add


LATEST = "SELECT g.instrument, g.as_of_ms, t.tick_id, t.at_ms, t.price_e4, t.status FROM grid g LEFT JOIN LATERAL (SELECT * FROM ticks t WHERE t.instrument = g.instrument AND t.at_ms <= g.as_of_ms ORDER BY t.at_ms DESC, t.tick_id DESC LIMIT 1) t ON true"


@query(sql(LATEST, "ticks", "grid"))
def asof_tick_backward(spark, d):
    return series.asof_backward(A.grid(spark, d), A.ticks(spark, d), "instrument", "as_of_ms", "at_ms", ["tick_id"], ["tick_id", "at_ms", "price_e4", "status"])


@query(sql("SELECT g.instrument, g.as_of_ms, (SELECT max(e.at_ms) FROM evidence e WHERE e.instrument = g.instrument AND e.at_ms <= g.as_of_ms) AS last_ms FROM grid g", "evidence", "grid"))
def asof_evidence_max(spark, d):
    return series.asof_backward(A.grid(spark, d), A.evidence(spark, d), "instrument", "as_of_ms", "at_ms", ["evidence_id"], ["at_ms"]).withColumnRenamed("at_ms", "last_ms")


@query(sql("SELECT g.instrument, g.as_of_ms, t.tick_id, t.at_ms FROM grid g LEFT JOIN LATERAL (SELECT * FROM ticks t WHERE t.instrument = g.instrument AND t.at_ms > g.as_of_ms ORDER BY t.at_ms, t.tick_id LIMIT 1) t ON true", "ticks", "grid"))
def asof_forward_first(spark, d):
    return series.asof_forward(A.grid(spark, d), A.ticks(spark, d), "instrument", "as_of_ms", "at_ms", ["tick_id"], ["tick_id", "at_ms"])


@query(sql("SELECT gap_id, scope, open_ms, close_ms, reason FROM gaps", "gaps"))
def gap_pairing(spark, d):
    return series.pair_gaps(*A.gap_rows(spark, d))


def _spans(spark, d) -> DataFrame:
    last = asof_tick_backward(spark, d).where("tick_id is not null")
    return last.select(F.concat_ws("/", F.col("instrument").cast("string"), F.col("as_of_ms").cast("string")).alias("span_id"), F.col("instrument").alias("scope"), F.col("at_ms").alias("from_ms"), F.col("as_of_ms").alias("to_ms"))


OVERLAP = """SELECT l.instrument, l.as_of_ms, x.gap_id, x.reason FROM latest l LEFT JOIN LATERAL (SELECT g.gap_id, g.reason FROM gaps g WHERE g.scope = l.instrument AND g.open_ms < l.as_of_ms
    AND (g.close_ms IS NULL OR g.close_ms > l.at_ms) ORDER BY g.open_ms, g.gap_id LIMIT 1) x ON true WHERE l.tick_id IS NOT NULL"""


@query(sql(f", latest AS ({LATEST}) {OVERLAP}", "ticks", "gaps", "grid"))
def gap_overlap_reason(spark, d):
    return series.first_overlap(_spans(spark, d), gap_pairing(spark, d), 7 * DAY).select(F.col("scope").alias("instrument"), F.col("to_ms").alias("as_of_ms"), "gap_id", "reason")


WALK = f"""SELECT book, side, CAST(sum(take) AS BIGINT) AS taken, CAST(sum(price_e4 * take) AS BIGINT) AS paid_e4, CAST(arg_min(price_e4, rank) AS BIGINT) AS best_e4 FROM (SELECT *, greatest(0, least(payout_cents,
    {DEPTH} - coalesce(sum(payout_cents) OVER (PARTITION BY book, side ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM levels) GROUP BY book, side"""
TWO = f"""SELECT book, max(taken) FILTER (side = 0) AS t0, max(taken) FILTER (side = 1) AS t1, max(paid_e4) FILTER (side = 0) AS p0, max(paid_e4) FILTER (side = 1) AS p1, max(best_e4) FILTER (side = 0) AS b0, max(best_e4) FILTER (side = 1) AS b1 FROM ({WALK}) GROUP BY book"""


@query(sql(WALK, "levels"))
def depth_walk_vwap(spark, d):
    return books.depth_walk(A.levels(spark, d), ["book", "side"], DEPTH)


def _sides(spark, d) -> DataFrame:
    return books.two_sided(depth_walk_vwap(spark, d), "book")


@query(sql(f"SELECT book, round((b0 + 10000 - b1) / 20000.0, 8) AS mid, CASE WHEN b0 IS NULL OR b1 IS NULL THEN 'no_quotes' END AS reason FROM ({TWO})", "levels"))
def mid_top(spark, d):
    x = _sides(spark, d).withColumn("mid", F.round(books.mid_top(), 8))
    return x.select("book", "mid", F.when(F.col("mid").isNull(), "no_quotes").alias("reason"))


@query(sql(f"SELECT book, round(CASE WHEN t0 = {DEPTH} AND t1 = {DEPTH} THEN (p0 + 10000.0 * {DEPTH} - p1) / (20000.0 * {DEPTH}) END, 8) AS mid, CASE WHEN t0 IS NULL OR t1 IS NULL THEN 'no_quotes' WHEN (t0 < {DEPTH} OR t1 < {DEPTH}) AND book % 3 = 0 THEN 'truncated_ladder' WHEN t0 < {DEPTH} OR t1 < {DEPTH} THEN 'insufficient_depth' END AS reason FROM ({TWO})", "levels"))
def mid_depth_reasons(spark, d):
    return _sides(spark, d).select("book", F.round(books.mid_depth(DEPTH), 8).alias("mid"), books.depth_reason(DEPTH, F.col("book") % 3 == 0).alias("reason"))


AGG = "SELECT book, side, price_e4, CAST(sum(payout_cents) AS BIGINT) AS payout_cents, row_number() OVER (PARTITION BY book, side ORDER BY price_e4 DESC) - 1 AS rank FROM levels GROUP BY book, side, price_e4 HAVING sum(payout_cents) > 0"


@query(sql(f"SELECT book, side, price_e4, payout_cents, CAST(rank AS BIGINT) AS rank FROM ({AGG})", "levels"))
def ladder_aggregate(spark, d):
    return books.aggregate_levels(A.levels(spark, d), ["book", "side"]).select("book", "side", "price_e4", "payout_cents", F.col("rank").cast("long"))


@query(sql(f"SELECT book, CAST(1 - side AS INTEGER) AS side, CAST(10000 - price_e4 AS INTEGER) AS price_e4, payout_cents FROM ({AGG})", "levels"))
def ladder_complement(spark, d):
    x = books.complement_ladder(books.aggregate_levels(A.levels(spark, d), ["book", "side"]))
    return x.select("book", (1 - F.col("side")).cast("int").alias("side"), F.col("price_e4").cast("int"), "payout_cents")


@query(sql(f"SELECT book, side, CAST(rank AS BIGINT) AS rank, price_e4, CAST(n > 2 AS INTEGER) AS truncated FROM (SELECT *, count(*) OVER (PARTITION BY book, side) AS n FROM ({AGG})) WHERE rank < 2", "levels"))
def top_n_truncate(spark, d):
    x = books.top_n(books.aggregate_levels(A.levels(spark, d), ["book", "side"]), ["book", "side"], 2)
    return x.select("book", "side", F.col("rank").cast("long"), "price_e4", "truncated")


@query(sql("SELECT instrument, tick_id, CAST(coalesce(lag(status) OVER w <> status, true) AS INTEGER) AS changed FROM ticks WINDOW w AS (PARTITION BY instrument ORDER BY at_ms, tick_id)", "ticks"))
def tick_change_detect(spark, d):
    return series.changes(A.ticks(spark, d), "instrument", ["at_ms", "tick_id"], ["status"]).select("instrument", "tick_id", "changed")


QUIET = "SELECT instrument, at_ms AS from_ms, nxt AS to_ms, nxt - at_ms AS quiet_ms FROM (SELECT *, lead(at_ms) OVER (PARTITION BY instrument ORDER BY at_ms, tick_id) AS nxt FROM ticks) WHERE nxt > at_ms"


@query(sql(QUIET, "ticks"))
def quiet_intervals(spark, d):
    return series.quiet_intervals(A.ticks(spark, d), "instrument", "at_ms", ["tick_id"])


@query(sql(f"SELECT CASE WHEN quiet_ms < 3600000 THEN 'hour' WHEN quiet_ms < 86400000 THEN 'day' ELSE 'more' END AS bucket, count(*) AS n, CAST(max(quiet_ms) AS BIGINT) AS longest_ms FROM ({QUIET}) GROUP BY 1", "ticks"))
def quiet_by_bucket(spark, d):
    x = quiet_intervals(spark, d)
    bucket = S.ladder([(F.col("quiet_ms") < 3600000, "hour"), (F.col("quiet_ms") < DAY, "day")], "more")
    return x.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.max("quiet_ms").alias("longest_ms"))


@query(
    sql(
        """, p AS (SELECT instrument AS subject, at_ms, tick_id, tick_id % 3 AS session, CAST(status <> 'error' AS INTEGER) AS ok FROM ticks), r AS (SELECT *, sum(ok) OVER (PARTITION BY subject ORDER BY at_ms, tick_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM p),
        good AS (SELECT subject, at_ms, session, row_number() OVER (PARTITION BY subject ORDER BY at_ms, tick_id) AS k FROM p WHERE ok = 1),
        bad AS (SELECT subject, run, count(*) AS n FROM r WHERE ok = 0 AND run > 0 GROUP BY 1, 2)
        SELECT g.subject, g.at_ms AS open_ms, h.at_ms AS close_ms, CASE WHEN b.n IS NOT NULL THEN 'request_failed' ELSE 'recorder_restart' END AS reason FROM good g LEFT JOIN good h ON h.subject = g.subject AND h.k = g.k + 1 LEFT JOIN bad b ON b.subject = g.subject AND b.run = g.k
        WHERE b.n IS NOT NULL OR h.session <> g.session""",
        "ticks",
    )
)
def poll_gap_sessions(spark, d):
    t = A.ticks(spark, d).select(F.col("instrument").alias("subject"), F.col("at_ms").alias("start_ms"), F.col("tick_id").alias("poll_id"), (F.col("tick_id") % 3).alias("session"), (F.col("status") != "error").cast("int").alias("ok"), F.col("at_ms").alias("recv_ms"))
    return series.poll_gaps(t)


@query(sql("SELECT scope, reach AS open_ms, start_ms AS close_ms FROM (SELECT *, max(end_ms) OVER (PARTITION BY scope ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT instrument AS scope, at_ms AS start_ms, at_ms + price_e4 * 3000 AS end_ms FROM ticks)) WHERE start_ms > reach", "ticks"))
def span_reach_gaps(spark, d):
    return series.reach_gaps(A.ticks(spark, d).select(F.col("instrument").alias("scope"), F.col("at_ms").alias("start_ms"), (F.col("at_ms") + F.col("price_e4").cast("long") * 3000).alias("end_ms")))


@query(sql("SELECT instrument, CAST(sum(CASE WHEN price_e4 > top + 1 THEN 1 ELSE 0 END) AS BIGINT) AS gaps, count(*) AS rows FROM (SELECT *, max(price_e4) OVER (PARTITION BY instrument ORDER BY at_ms, tick_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM ticks) GROUP BY 1", "ticks"))
def seq_gap_count(spark, d):
    return series.sequence_gaps(A.ticks(spark, d), "instrument", ["at_ms", "tick_id"], "price_e4")


HEADS = "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY instrument) AS n_heads, row_number() OVER (PARTITION BY instrument ORDER BY id DESC) AS k FROM observations o WHERE NOT EXISTS (SELECT 1 FROM observations p WHERE p.supersedes = o.id)) WHERE k = 1"


@query(sql(f"SELECT instrument, id, n_heads FROM ({HEADS})", "observations"))
def supersession_heads(spark, d):
    return facts.heads(A.observations(spark, d), "instrument", "id", "supersedes").select("instrument", "id", "n_heads")


@query(sql(f"SELECT instrument, id, CASE WHEN n_heads > 1 THEN 'mapping_conflict' WHEN status = 'rejected' THEN 'mapping_rejected' WHEN status <> 'exact' THEN 'mapping_unverified' WHEN equivalence = 'not_equivalent' THEN 'rules_mismatch' WHEN equivalence = 'pending' THEN 'equivalence_pending' END AS reason FROM ({HEADS})", "observations"))
def eligibility_ladder(spark, d):
    h = facts.heads(A.observations(spark, d), "instrument", "id", "supersedes")
    return h.select("instrument", "id", facts.eligibility(F.col("status"), F.col("equivalence"), F.col("n_heads")).alias("reason"))


@query("SELECT p_brand AS brand, p_size AS size, CAST(count(DISTINCT i) AS BIGINT) AS n, CASE WHEN count(DISTINCT i) = 1 THEN min(i) END AS instrument, CASE WHEN count(DISTINCT i) = 0 THEN 'unmapped' WHEN count(DISTINCT i) > 1 THEN 'ambiguous_reference' END AS reason FROM (SELECT p_brand, p_size, CASE WHEN p_partkey % 2 = 0 AND p_type NOT LIKE 'S%' THEN p_partkey END AS i FROM part) GROUP BY 1, 2")
def reference_lookup_cardinality(spark, d):
    p = A.read(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_partkey").alias("instrument"), F.when(F.col("p_partkey") % 2 == 0, "direct").otherwise("inverse").alias("polarity"), F.when(F.col("p_type").startswith("S"), "rejected").otherwise("exact").alias("status"))
    return facts.reference(p, ["brand", "size"], "instrument")


CANDLES = "SELECT instrument, at_ms // 3600000 * 3600000 AS start_ms, arg_min(price_e4, (at_ms, tick_id)) AS open_e4, max(price_e4) AS high_e4, min(price_e4) AS low_e4, arg_max(price_e4, (at_ms, tick_id)) AS close_e4, count(*) AS n FROM ticks GROUP BY 1, 2"


@query(sql(CANDLES, "ticks"))
def candle_ohlc(spark, d):
    o = F.struct("at_ms", "tick_id")
    return A.ticks(spark, d).groupBy("instrument", (F.floor(F.col("at_ms") / 3600000) * 3600000).alias("start_ms")).agg(F.min_by("price_e4", o).alias("open_e4"), F.max("price_e4").alias("high_e4"), F.min("price_e4").alias("low_e4"), F.max_by("price_e4", o).alias("close_e4"), F.count(F.lit(1)).alias("n"))


def _months(spark, d) -> DataFrame:
    suppliers = A.read(spark, d, "supplier").select(F.col("s_suppkey").alias("instrument"))
    months = F.expr("transform(sequence(0, 71), k -> timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(add_months(DATE'1996-01-01', k) as timestamp_ntz)))")
    x = suppliers.withColumn("as_of_ms", F.explode(months))
    return x.withColumn("request_id", F.concat_ws("/", F.col("instrument").cast("string"), F.col("as_of_ms").cast("string")))


VWAP = """, r AS (SELECT s_suppkey AS instrument, epoch_ms(TIMESTAMP '1996-01-01' + to_months(CAST(k AS INTEGER))) AS as_of_ms FROM supplier, range(0, 72) t(k)),
    v AS (SELECT r.instrument, r.as_of_ms, count(e.time_ms) AS n, CAST(coalesce(sum(e.payout_cents), 0) AS BIGINT) AS payout, CAST(sum(e.price_e4 * e.payout_cents) AS BIGINT) AS paid, max(e.time_ms) AS last_ms FROM r LEFT JOIN executions e ON e.instrument = r.instrument AND e.time_ms >= r.as_of_ms - 2592000000 AND e.time_ms < r.as_of_ms GROUP BY 1, 2)"""


@query(sql(VWAP + " SELECT instrument, as_of_ms, n, payout, paid, last_ms FROM v", "executions"))
def vwap_window(spark, d):
    return trades.window_vwap(_months(spark, d), A.executions(spark, d), "instrument", 30 * DAY).select("instrument", "as_of_ms", "n", "payout", "paid", "last_ms")


@query(sql(VWAP + " SELECT instrument, as_of_ms, CASE WHEN n >= 5 AND payout >= 10000 THEN round(paid / (payout * 10000.0), 10) END AS price, CASE WHEN n < 5 OR payout < 10000 THEN 'few_trades' END AS reason FROM v", "executions"))
def vwap_few_trades(spark, d):
    price, reason = trades.vwap_price(5, 10_000)
    return vwap_window(spark, d).select("instrument", "as_of_ms", F.round(price, 10).alias("price"), reason.alias("reason"))


@query(sql("SELECT instrument AS execution_id, coalesce(min(at_ms) FILTER (status = 'view'), min(at_ms)) AS time_ms, arg_min(tick_id, (status <> 'view', at_ms, tick_id)) AS sighting_id FROM ticks GROUP BY 1", "ticks"))
def execution_time(spark, d):
    return trades.execution_time(A.ticks(spark, d).select(F.col("instrument").alias("execution_id"), F.col("at_ms").alias("venue_ts_ms"), F.col("tick_id").alias("sighting_id"), F.when(F.col("status") == "view", "stream").otherwise("file").alias("role")))


@query("SELECT l_orderkey AS book, CASE WHEN sum(l_quantity) FILTER (l_returnflag = 'N') = sum(l_quantity) FILTER (l_returnflag <> 'N') AND NOT list_has_any(list(DISTINCT l_partkey % 10) FILTER (l_returnflag = 'N'), list(DISTINCT l_partkey % 10) FILTER (l_returnflag <> 'N')) THEN 'balanced' ELSE 'ambiguous' END AS status FROM lineitem GROUP BY 1")
def maker_taker_balance(spark, d):
    x = A.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("book"), F.when(F.col("l_returnflag") == "N", "maker").otherwise("taker").alias("role"), F.col("l_quantity").alias("qty"), (F.col("l_partkey") % 10).alias("outcome"))
    return trades.balance(x, ["book"])


@query("SELECT l_orderkey AS book, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS occurrence FROM lineitem")
def occurrence_key(spark, d):
    x = trades.occurrence(A.read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])
    return x.select(F.col("l_orderkey").alias("book"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("occurrence").cast("long"))


def _candidates(spark, d) -> DataFrame:
    t = A.ticks(spark, d)
    s = t.where("status = 'view'").select("instrument", F.col("tick_id").alias("stream_id"), F.col("at_ms").alias("s_ms"), F.col("price_e4").alias("s_price"))
    e = t.where("status = 'click'").select("instrument", F.col("tick_id").alias("execution_id"), F.col("at_ms").alias("e_ms"), F.col("price_e4").alias("e_price"))
    return trades.match_candidates(s, e, ["instrument"], DAY, 600)


@query(sql("SELECT s.tick_id AS stream_id, count(*) AS n, arg_min(e.tick_id, (abs(s.at_ms - e.at_ms), e.tick_id)) AS nearest FROM ticks s JOIN ticks e ON e.instrument = s.instrument AND s.status = 'view' AND e.status = 'click' AND abs(s.at_ms - e.at_ms) <= 86400000 AND abs(s.price_e4 - e.price_e4) < 600 GROUP BY 1", "ticks"))
def nearest_match_candidates(spark, d):
    return _candidates(spark, d).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("execution_id", F.struct(F.abs(F.col("s_ms") - F.col("e_ms")), "execution_id")).alias("nearest"))


@query(
    sql(
        """, o AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY at_ms, sid) AS k FROM (SELECT s.instrument, s.at_ms, s.tick_id AS sid, list(e.tick_id ORDER BY abs(s.at_ms - e.at_ms), e.tick_id) AS near FROM ticks s JOIN ticks e ON e.instrument = s.instrument AND s.status = 'view' AND e.status = 'click' AND abs(s.at_ms - e.at_ms) <= 86400000 AND abs(s.price_e4 - e.price_e4) < 600 GROUP BY ALL)),
        g AS (SELECT DISTINCT instrument, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS sid, NULL::BIGINT AS eid FROM o UNION ALL SELECT instrument, k, CASE WHEN x IS NULL THEN taken ELSE list_append(taken, x) END, sid, x
            FROM (SELECT o.*, g.taken, list_filter(o.near, lambda z: NOT list_contains(g.taken, z))[1] AS x FROM g JOIN o ON o.instrument = g.instrument AND o.k = g.k + 1))
        SELECT sid AS stream_id, eid AS execution_id FROM g WHERE eid IS NOT NULL""",
        "ticks",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def greedy_trade_match(spark, d):
    return trades.greedy_match(_candidates(spark, d), ["instrument"], DAY)


@query(sql("SELECT c.c_custkey AS id, coalesce(x.n, 0) AS n, CASE WHEN x.n = 1 THEN x.o END AS other, CASE WHEN x.n = 1 THEN 'clean' WHEN x.n > 1 THEN 'edge' ELSE 'excluded' END AS status FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS o FROM orders WHERE o_totalprice > 200000 GROUP BY 1) x ON x.o_custkey = c.c_custkey"))
def link_exactly_one(spark, d):
    c = A.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("id"))
    o = A.read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("other"), "o_totalprice")
    return facts.exactly_one(c, o, ["k"], F.col("o_totalprice") > 200000, "id", "other")


@query(sql("SELECT instrument, id, result, lag(id) OVER (PARTITION BY instrument ORDER BY at_ms, id) AS supersedes FROM (SELECT *, lag(result) OVER (PARTITION BY instrument ORDER BY at_ms, id) AS before FROM observations) WHERE before IS NULL OR before <> result", "observations"))
def settlement_changes(spark, d):
    x = facts.settlement_changes(A.observations(spark, d).drop("supersedes"), "instrument", ["at_ms", "id"], ["result"], "id")
    return x.select("instrument", "id", "result", "supersedes")


@query("SELECT p_partkey AS id, CASE WHEN abs(a) >= 100 THEN CAST((CASE WHEN a > 0 THEN a + 100 ELSE abs(a) + 100 END) // gcd(CASE WHEN a > 0 THEN a + 100 ELSE abs(a) + 100 END, CASE WHEN a > 0 THEN 100 ELSE abs(a) END) AS BIGINT) END AS num, CASE WHEN abs(a) >= 100 THEN CAST((CASE WHEN a > 0 THEN 100 ELSE abs(a) END) // gcd(CASE WHEN a > 0 THEN a + 100 ELSE abs(a) + 100 END, CASE WHEN a > 0 THEN 100 ELSE abs(a) END) AS BIGINT) END AS den FROM (SELECT *, CAST(p_partkey % 801 - 400 AS BIGINT) AS a FROM part)")
def american_odds(spark, d):
    o = S.american_odds((F.col("p_partkey") % 801 - 400).cast("long"))
    return A.read(spark, d, "part").select(F.col("p_partkey").alias("id"), o.alias("o")).select("id", "o.num", "o.den")


@query("SELECT p_partkey AS id, round(o / (a + o), 10) AS share, round(1 / a + 1 / o - 1, 10) AS overround, round(0.55 * a - 1, 10) AS ev, CAST(abs(CAST(floor(o / (a + o) * 10000) AS BIGINT) - 5000) > 800 AS INTEGER) AS outlier FROM (SELECT p_partkey, 1 + p_retailprice / 1000 AS a, 1 + p_size / 20.0::DOUBLE AS o FROM part)")
def devig_two_way(spark, d):
    a, o = 1 + F.col("p_retailprice") / 1000, 1 + F.col("p_size") / F.lit(20.0)
    share = S.devig(a, o)
    return A.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(share, 10).alias("share"), F.round(S.overround(a, o), 10).alias("overround"), F.round(S.closing_ev(F.lit(0.55), a), 10).alias("ev"), S.agreement(F.floor(share * 10000), F.lit(5000)).alias("outlier"))


@query(sql(f", latest AS ({LATEST}) SELECT instrument, as_of_ms, array_to_string(list_filter(list_distinct_in_order, lambda x: x IS NOT NULL), ',') AS reasons FROM (SELECT instrument, as_of_ms, [CASE WHEN tick_id IS NULL THEN 'no_quotes' END, CASE WHEN status = 'error' THEN 'halted' END, CASE WHEN price_e4 > 1000 THEN 'unlicensed_book' END] AS list_distinct_in_order FROM latest)", "ticks", "grid"))
def exclusion_reasons(spark, d):
    x = asof_tick_backward(spark, d)
    why = F.array(F.when(F.col("tick_id").isNull(), "no_quotes"), F.when(F.col("status") == "error", "halted"), F.when(F.col("price_e4") > 1000, "unlicensed_book"))
    return x.select("instrument", "as_of_ms", F.array_join(F.array_distinct(F.array_compact(why)), ",").alias("reasons"))


STEPS = ["no_link", "mapping_unverified", "ok"]


@query(sql(", r AS (SELECT CASE WHEN status = 'rejected' THEN 'no_link' WHEN status <> 'exact' THEN 'mapping_unverified' ELSE 'ok' END AS step FROM observations), s(pos, step) AS (VALUES (0, 'no_link'), (1, 'mapping_unverified'), (2, 'ok')), c AS (SELECT s.pos, s.step, count(r.step) AS dropped FROM s LEFT JOIN r USING (step) GROUP BY 1, 2) SELECT CAST(pos AS INTEGER) AS pos, step, dropped, CAST((SELECT count(*) FROM r) - sum(dropped) OVER (ORDER BY pos) AS BIGINT) AS left FROM c", "observations").replace(" AS left FROM", ' AS "left" FROM'))
def coverage_waterfall(spark, d):
    why = S.ladder([(F.col("status") == "rejected", STEPS[0]), (F.col("status") != "exact", STEPS[1])], "ok")
    return facts.waterfall(A.observations(spark, d), STEPS, why)


@query(sql(f"SELECT CAST(least(coalesce(t0, 0), coalesce(t1, 0)) // 1000 AS BIGINT) AS bucket, count(*) AS books, count(*) FILTER (least(coalesce(t0, 0), coalesce(t1, 0)) >= {DEPTH}) AS deep FROM ({TWO}) GROUP BY 1", "levels"))
def depth_report(spark, d):
    low = F.least(F.coalesce("taken0", F.lit(0)), F.coalesce("taken1", F.lit(0)))
    return _sides(spark, d).groupBy(F.floor(low / 1000).alias("bucket")).agg(F.count(F.lit(1)).alias("books"), F.count_if(low >= DEPTH).alias("deep"))


@query("SELECT l_returnflag AS flag, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_clusters, round(any_value(m), 8) AS mean, round(sqrt(sum((s - n * m) ** 2) * count(*) / (count(*) - 1)) / sum(n), 8) AS se FROM (SELECT *, sum(s) OVER (PARTITION BY l_returnflag) / sum(n) OVER (PARTITION BY l_returnflag) AS m FROM (SELECT l_returnflag, l_orderkey, sum(l_discount) AS s, count(*) AS n FROM lineitem GROUP BY 1, 2)) GROUP BY 1")
def ols_cluster_k1(spark, d):
    x = stats.cluster_mean(A.read(spark, d, "lineitem"), "l_discount", "l_orderkey", ["l_returnflag"])
    return x.select(F.col("l_returnflag").alias("flag"), "n", "n_clusters", F.round("mean", 8).alias("mean"), F.round("se", 8).alias("se"))


@query(
    """WITH r AS (SELECT l_orderkey AS c, l_discount AS y, l_tax AS x FROM lineitem), s AS (SELECT count(*) AS n, count(DISTINCT c) AS g, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM r),
    b AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1, (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS b0, n * sxx - sx * sx AS det FROM s),
    u AS (SELECT c, sum(y - b0 - b1 * x) AS u0, sum((y - b0 - b1 * x) * x) AS u1 FROM r, b GROUP BY c), m AS (SELECT sum(u0 * u0) AS m00, sum(u0 * u1) AS m01, sum(u1 * u1) AS m11 FROM u)
    SELECT n, g AS n_clusters, round(b0, 8) AS b0, round(b1, 8) AS b1, round(sqrt((sxx * sxx * m00 - 2 * sxx * sx * m01 + sx * sx * m11) / (det * det) * g / (g - 1) * (n - 1) / (n - 2)), 8) AS se0,
    round(sqrt((sx * sx * m00 - 2 * n * sx * m01 + n * n * m11) / (det * det) * g / (g - 1) * (n - 1) / (n - 2)), 8) AS se1 FROM b, m"""
)
def ols_cluster_k2(spark, d):
    f = stats.ols_cluster(A.read(spark, d, "lineitem").select("l_orderkey", "l_discount", "l_tax"), "l_discount", ["l_tax"], "l_orderkey")
    row = (f.n, f.clusters, *(round(v, 8) for v in f.value), *(round(v, 8) for v in f.se))
    return spark.createDataFrame([row], "n long, n_clusters long, b0 double, b1 double, se0 double, se1 double")


@query("SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(l_tax - l_discount), 8) AS mean FROM (SELECT *, (rank() OVER (ORDER BY l_discount) - 1) * 5 // count(*) OVER () AS bin FROM lineitem) GROUP BY 1")
def binned_lack_of_fit(spark, d):
    x = stats.ranked_bins(A.read(spark, d, "lineitem"), "l_discount", 5)
    return x.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("l_tax") - F.col("l_discount")), 8).alias("mean"))


@query("SELECT l_linestatus AS buffer, count(*) AS n, round(avg(l_discount), 8) AS mean FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) = 2) GROUP BY 1")
def oracle_matched(spark, d):
    x = stats.matched(A.read(spark, d, "lineitem"), "l_orderkey", "l_linestatus", 2)
    return x.groupBy(F.col("l_linestatus").alias("buffer")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 8).alias("mean"))


@query("SELECT l_returnflag AS flag, round(stddev_samp(l_extendedprice), 6) AS sd, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q / 100}), 6) AS q{q:02d}" for q in (5, 25, 50, 75, 95)) + " FROM lineitem GROUP BY 1")
def dispersion_quantiles(spark, d):
    x = stats.dispersion(A.read(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return x.select(F.col("l_returnflag").alias("flag"), *(F.round(c, 6).alias(c) for c in x.columns[1:]))


@query("SELECT round(sum(abs(s) * m), 6) AS bound FROM (SELECT l_suppkey, sum((l_discount - 0.05) * l_tax) AS s, max(l_tax) AS m FROM lineitem GROUP BY 1)")
def drift_bound(spark, d):
    x = A.read(spark, d, "lineitem").select("l_suppkey", (F.col("l_discount") - 0.05).alias("w"), F.col("l_tax").alias("basis"))
    return stats.drift_bound(x.withColumn("margin", F.col("basis")), "l_suppkey", "w", "basis", "margin").select(F.round("bound", 6).alias("bound"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, sha256(props) AS digest FROM events")
def json_props_digest(spark, d):
    return A.read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.sha2("props", 256).alias("digest"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages")
def url_parse(spark, d):
    return A.read(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"))


@query("SELECT instrument, min(day) AS first_day, count(*) AS n FROM (SELECT user_id AS instrument, epoch_us(ts) // 86400000000 AS day FROM events WHERE event_id <= (SELECT max(event_id) FROM events) // 2) GROUP BY 1")
def snapshot_read(spark, d):
    t = A.ticks(spark, d)
    mark = t.agg(F.max("tick_id")).first()[0] or 0
    return facts.at_snapshot(t, "tick_id", mark // 2).groupBy("instrument").agg(F.min(F.floor(F.col("at_ms") / DAY)).alias("first_day"), F.count(F.lit(1)).alias("n"))


@query("SELECT 'events' AS name, max(event_id) AS mark FROM events UNION ALL SELECT 'orders', max(o_orderkey) FROM orders UNION ALL SELECT 'documents', max(doc_id) FROM documents")
def snapshot_high_water(spark, d):
    marks = [A.read(spark, d, t).agg(F.max(c).alias("mark")).select(F.lit(t).alias("name"), "mark") for t, c in (("events", "event_id"), ("orders", "o_orderkey"), ("documents", "doc_id"))]
    return marks[0].unionByName(marks[1]).unionByName(marks[2])


@query("SELECT rule, CAST(n AS BIGINT) AS n FROM (SELECT 'quantity' AS rule, count(*) FILTER (l_quantity < 10) AS n FROM lineitem UNION ALL SELECT 'discount', count(*) FILTER (l_discount >= 0.1) FROM lineitem UNION ALL SELECT 'price', count(*) FILTER (l_extendedprice <= 0) FROM lineitem)")
def constraint_violations(spark, d):
    return facts.violations(A.read(spark, d, "lineitem"), {"quantity": F.col("l_quantity") >= 10, "discount": F.col("l_discount") < 0.1, "price": F.col("l_extendedprice") > 0})


@query(sql("SELECT instrument, session, CAST(row_number() OVER (PARTITION BY instrument, session ORDER BY tick_id) = 1 AS INTEGER) AS first, tick_id FROM (SELECT *, at_ms // 604800000 AS session FROM ticks)", "ticks"))
def first_of_session(spark, d):
    return series.span_id_first(A.ticks(spark, d).withColumn("session", F.floor(F.col("at_ms") / (7 * DAY))), ["instrument", "session", "tick_id"]).select("instrument", "session", "first", "tick_id")
