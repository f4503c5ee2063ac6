"""Registered queries of closes, identity and scoring, with twins written from the rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import closes, facts
from . import adapters as A
from .adapters import sql
from .queries import DAY, query

#: Limits that suit ticks some hours apart.
DEFS = [
    closes.LiveDef(name, benchmark, usd, max_quote_age_s=86_400, stream_liveness_max_s=21_600, poll_liveness_max_s=43_200)
    for name, benchmark, usd in (("top", "mid_top", None), ("depth_100", "mid_depth", 100), ("depth_500", "mid_depth", 500))
]
LOWEST = "CAST({0} // gcd({0}, {1}) AS BIGINT)"


def reduced_sql(num: str, den: str, name: str = "p") -> str:
    return f"CAST(({num}) // gcd(({num})::HUGEINT, ({den})::HUGEINT) AS BIGINT) AS {name}_num, CAST(({den}) // gcd(({num})::HUGEINT, ({den})::HUGEINT) AS BIGINT) AS {name}_den"


#: The live price of rows of req (request_id, venue, native_id, instrument, side, as_of_ms) by the rules, one lookup after another.
LIVE = """, d(def_name, benchmark, cents) AS (VALUES ('top', 'mid_top', 0), ('depth_100', 'mid_depth', 10000), ('depth_500', 'mid_depth', 50000)), src(source, rank, live_ms) AS (VALUES ('stream', 0, 21600000), ('poll', 1, 43200000)),
    cand AS (SELECT r.*, s.source, s.rank, s.live_ms, t.tick_id, t.observed_ms, t.venue_ms, t.status, t.truncated OR NOT t.complete AS cut, t.snapshot, greatest(t.observed_ms, coalesce((SELECT max(e.observed_ms) FROM lsigns e WHERE e.instrument = r.instrument AND e.source = s.source AND e.observed_ms <= r.as_of_ms), 0)) AS last_ms
        FROM req r JOIN src s ON r.venue = 'novig' OR s.source = 'poll' JOIN LATERAL (SELECT * FROM lticks t WHERE t.instrument = r.instrument AND t.source = s.source AND t.observed_ms <= r.as_of_ms ORDER BY t.observed_ms DESC, t.tick_id DESC LIMIT 1) t ON true),
    best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY last_ms DESC, rank) = 1),
    ahead AS (SELECT b.*, (SELECT min(e.observed_ms) FROM lsigns e WHERE e.instrument = b.instrument AND e.source = b.source AND e.observed_ms > b.as_of_ms) AS sign, n.observed_ms AS nxt, n.snapshot AS nxt_snapshot
        FROM best b LEFT JOIN LATERAL (SELECT * FROM lticks t WHERE t.instrument = b.instrument AND t.source = b.source AND t.observed_ms > b.as_of_ms ORDER BY t.observed_ms, t.tick_id LIMIT 1) n ON true),
    held AS (SELECT *, CASE WHEN source = 'stream' AND as_of_ms - last_ms > live_ms THEN CASE WHEN sign IS NOT NULL AND (nxt IS NULL OR sign < nxt) THEN sign WHEN nxt_snapshot = snapshot THEN nxt END END AS bracket_ms FROM ahead),
    gapped AS (SELECT h.*, g.reason AS gap FROM held h LEFT JOIN LATERAL (SELECT g.reason FROM lgaps g WHERE g.scope = h.venue || ':market:' || h.native_id || CASE WHEN h.source = 'stream' THEN '/book' ELSE '' END AND g.open_ms < coalesce(h.bracket_ms, h.as_of_ms) AND (g.close_ms IS NULL OR g.close_ms > h.observed_ms) ORDER BY g.open_ms, g.gap_id LIMIT 1) g ON true),
    walk AS (SELECT tick_id, side, cents, sum(take) AS taken, sum(price_e4 * take) AS paid, arg_min(price_e4, rank) AS best FROM (SELECT l.*, d.cents, greatest(0, least(payout_cents, d.cents - coalesce(sum(payout_cents) OVER (PARTITION BY tick_id, side, d.cents ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM llevels l, d) GROUP BY ALL),
    priced AS (SELECT r.request_id, d.*, g.* EXCLUDE (request_id, venue, native_id, instrument, side, as_of_ms, rank), r.as_of_ms, o.taken AS ot, o.paid AS op, o.best AS ob, x.taken AS xt, x.paid AS xp, x.best AS xb, r.as_of_ms - g.observed_ms AS quote_age_ms, r.as_of_ms - g.last_ms AS liveness_age_ms
        FROM req r CROSS JOIN d LEFT JOIN gapped g ON g.request_id = r.request_id LEFT JOIN walk o ON o.tick_id = g.tick_id AND o.side = r.side AND o.cents = d.cents LEFT JOIN walk x ON x.tick_id = g.tick_id AND x.side = 1 - r.side AND x.cents = d.cents),
    told AS (SELECT *, CASE WHEN tick_id IS NULL THEN 'no_quotes' WHEN gap = 'crossed_book' THEN 'crossed_book' WHEN gap IS NOT NULL THEN 'collection_gap' WHEN liveness_age_ms > live_ms AND bracket_ms IS NULL THEN 'feed_stalled' WHEN status <> 'OPEN' THEN 'halted'
        WHEN observed_ms - venue_ms > 5000 THEN 'venue_lag' WHEN quote_age_ms > 86400000 THEN 'stale_book' WHEN ob IS NULL OR xb IS NULL THEN 'no_quotes' WHEN benchmark = 'mid_depth' AND (ot < cents OR xt < cents) THEN CASE WHEN cut THEN 'truncated_ladder' ELSE 'insufficient_depth' END END AS reason,
        CASE WHEN benchmark = 'mid_top' THEN ob + 10000 - xb ELSE op + 10000 * cents - xp END AS num, CASE WHEN benchmark = 'mid_top' THEN 20000 ELSE 20000 * cents END AS den FROM priced),
    live AS (SELECT request_id, def_name, CASE WHEN reason IS NULL THEN num // gcd(num::HUGEINT, den::HUGEINT) END::BIGINT AS p_num, CASE WHEN reason IS NULL THEN den // gcd(num::HUGEINT, den::HUGEINT) END::BIGINT AS p_den, reason, tick_id, observed_ms, source, quote_age_ms, liveness_age_ms, bracket_ms, CAST(10000 - xb - ob AS BIGINT) AS spread_e4 FROM told)"""
REQ = ", req AS (SELECT instrument || '/' || as_of_ms AS request_id, 'novig' AS venue, CAST(instrument AS VARCHAR) AS native_id, instrument, instrument % 2 AS side, as_of_ms FROM grid)"


@query(sql(f"{REQ} {LIVE} SELECT * FROM live", "grid", "lticks", "lsigns", "lgaps", "llevels"))
def price_as_of_reason_ladder(spark, d):
    f = A.live_facts(spark, d)
    r = A.grid(spark, d).select(F.concat_ws("/", F.col("instrument").cast("string"), F.col("as_of_ms").cast("string")).alias("request_id"), F.lit("novig").alias("venue"), F.col("instrument").cast("string").alias("native_id"), "instrument", (F.col("instrument") % 2).alias("side"), "as_of_ms", F.array(F.lit("stream"), F.lit("poll")).alias("sources"))
    out = closes.price_as_of(r, f["ticks"], f["evidence"], f["gaps"], f["levels"], DEFS)
    return out.withColumn("spread_e4", F.col("spread_e4").cast("long"))


@query(sql(f"{REQ} {LIVE} SELECT instrument, as_of_ms, source, tick_id, last_ms, CASE WHEN sign IS NOT NULL AND (nxt IS NULL OR sign < nxt) THEN sign WHEN nxt_snapshot = snapshot THEN nxt END AS bracket_ms FROM ahead", "grid", "lticks", "lsigns", "lgaps", "llevels"))
def liveness_bracket(spark, d):
    f = A.live_facts(spark, d)
    r = A.grid(spark, d).withColumn("sources", F.array(F.lit("stream"), F.lit("poll")))
    x = closes.book_state(r, f["ticks"], f["evidence"])
    return x.select("instrument", "as_of_ms", "source", F.col("tick.tick_id").alias("tick_id"), "last_ms", closes.bracket().alias("bracket_ms"))


@query(
    sql(
        """, c AS (SELECT * FROM claims WHERE (source, kind) IN (('mlb_statsapi', 'first_pitch'), ('mlb_statsapi', 'status_in_progress'), ('novig_stream', 'venue_golive'))),
        g AS (SELECT event_id, count(DISTINCT at_ms) AS n, min(at_ms) AS earliest, max(at_ms) AS furthest, min(at_ms) FILTER (source = 'mlb_statsapi') AS o0, max(at_ms) FILTER (source = 'mlb_statsapi') AS o1, min(at_ms) FILTER (kind = 'first_pitch') AS p0, max(at_ms) FILTER (kind = 'first_pitch') AS p1 FROM c GROUP BY 1)
        SELECT event_id, n, earliest, coalesce(p0, o0, earliest) AS selected, coalesce(p1, o1, furthest) AS latest, furthest - earliest AS span_ms, CASE WHEN o0 IS NULL THEN 'no_trusted_off' WHEN furthest - earliest > 43200000 THEN 'off_disagreement' END AS reason FROM g""",
        "claims",
    )
)
def off_resolve_bounds(spark, d):
    return facts.resolve_start(A.claims(spark, d), "event_id", DAY // 2)


@query(
    sql(
        """, r AS (SELECT instrument || '/' || as_of_ms AS request_id, instrument, CAST(as_of_ms // 86400000 % 2 AS INTEGER) AS side, as_of_ms FROM grid),
        x AS (SELECT r.*, (SELECT max(end_ms) FROM bcandles c WHERE c.instrument = r.instrument AND c.end_ms <= r.as_of_ms) AS e, EXISTS (SELECT 1 FROM bcandles c WHERE c.instrument = r.instrument AND c.start_ms < r.as_of_ms AND c.end_ms > r.as_of_ms) AS active FROM r),
        y AS (SELECT x.request_id, any_value(x.side) AS side, any_value(active) AS active, any_value(as_of_ms) - any_value(e) AS age, count(DISTINCT (c.side, c.bid, c.ask)) FILTER (c.candle_id IS NOT NULL) AS n, min(c.candle_id) AS candle_id, arg_min(c.side, c.candle_id) AS cs, arg_min({'v': c.bid}, c.candle_id).v AS bid, arg_min({'v': c.ask}, c.candle_id).v AS ask
            FROM x LEFT JOIN bcandles c ON c.instrument = x.instrument AND c.end_ms = x.e GROUP BY x.request_id),
        z AS (SELECT *, CASE WHEN side <> cs THEN 10000 - ask ELSE bid END AS b, CASE WHEN side <> cs THEN 10000 - bid ELSE ask END AS a,
            CASE WHEN n > 1 THEN 'ambiguous_candle' WHEN (age IS NULL OR age > 86400000) AND active THEN 'ambiguous_candle' WHEN age IS NULL THEN 'no_quotes' WHEN age > 86400000 THEN 'stale_book' WHEN bid IS NULL OR ask IS NULL THEN 'no_quotes' END AS reason FROM y)
        SELECT request_id, CASE WHEN reason IS NULL THEN (a + b) // gcd(a + b, 20000) END::BIGINT AS p_num, CASE WHEN reason IS NULL THEN 20000 // gcd(a + b, 20000) END::BIGINT AS p_den, reason, candle_id, active, age AS quote_age_ms, CASE WHEN reason IS NULL THEN a - b END::INTEGER AS spread_e4 FROM z""",
        "grid", "bcandles",
    )
)
def candle_close_as_of(spark, d):
    r = A.grid(spark, d).select(F.concat_ws("/", F.col("instrument").cast("string"), F.col("as_of_ms").cast("string")).alias("request_id"), "instrument", (F.floor(F.col("as_of_ms") / DAY) % 2).cast("int").alias("side"), "as_of_ms")
    return closes.candle_close(r, A.book_candles(spark, d), DAY)
