"""Registered queries of sources and reports on records made from the supplied tables, with twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import closes, links, reports, stats
from ..sources import archive, venues
from . import adapters as A
from .adapters import sql
from .closing import DEFS, LIVE, REQ
from .queries import query


@query("SELECT event_type AS status, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.9) AS p90 FROM events GROUP BY 1")
def nearest_rank(spark, d):
    x = A.read(spark, d, "events").select(F.col("event_type").alias("status"), "value")
    return stats.quantiles(x, "value", ["status"], {"median": 0.5, "p90": 0.9}, linear=False)


@query("SELECT o_orderstatus AS source, o_orderpriority AS day, count(*) AS segments, CAST(sum(o_orderkey) AS BIGINT) AS bytes, CAST(sum(o_custkey) AS BIGINT) AS frames, count(*) FILTER (o_orderkey % 13 = 0) AS unclean FROM orders GROUP BY 1, 2")
def storage_report(spark, d):
    s = A.read(spark, d, "orders").select(F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("day"), F.col("o_orderkey").alias("bytes"), F.col("o_custkey").alias("frame_count"), (F.col("o_orderkey") % 13 == 0).alias("unclean_close"))
    return reports.storage(s)


@query(sql(f"{REQ} {LIVE} SELECT def_name, coalesce(reason, CASE WHEN bracket_ms IS NOT NULL THEN 'live, bracketed' ELSE 'live, recent' END) AS verdict, count(*) AS n FROM live GROUP BY ALL", "grid", "lticks", "lsigns", "lgaps", "llevels"))
def verdict_histogram(spark, d):
    f = A.live_facts(spark, d)
    r = A.grid(spark, d).select(F.concat_ws("/", F.col("instrument").cast("string"), F.col("as_of_ms").cast("string")).alias("request_id"), F.lit("novig").alias("venue"), F.col("instrument").cast("string").alias("native_id"), "instrument", (F.col("instrument") % 2).alias("side"), "as_of_ms", F.array(F.lit("stream"), F.lit("poll")).alias("sources"))
    return reports.verdicts(closes.price_as_of(r, f["ticks"], f["evidence"], f["gaps"], f["levels"], DEFS), "def_name")


#: A game for each nation, at noon UTC and some hours, so that its Eastern day is the UTC day.
NOON, HOUR = 1767225600000 + 12 * 3_600_000, 3_600_000


@query(
    f"""WITH s AS (SELECT n_nationkey AS game, {NOON} + n_nationkey % 3 * 86400000 + n_nationkey % 5 * {HOUR} AS start_ms, n_nationkey % 3 AS day, list_sort(['r' || n_regionkey % 2, 'k' || n_nationkey % 4]) AS names FROM nation),
    m AS (SELECT 'm' || n_nationkey AS market, {NOON} + n_nationkey % 3 * 86400000 + n_nationkey % 9 * {HOUR} AS start_ms, list_sort(['k' || n_nationkey % 4, 'r' || n_regionkey % 2]) AS names FROM nation)
    SELECT s.game, s.start_ms, (SELECT array_to_string(list_sort(coalesce(list(m.market), [])), ',') FROM m WHERE m.names = s.names AND abs(m.start_ms - s.start_ms) <= 6 * {HOUR}) AS novig, (SELECT array_to_string(list_sort(coalesce(list('e' || e.game), [])), ',') FROM s e WHERE e.names = s.names AND e.day = s.day) AS kalshi FROM s"""
)
def discovery_match(spark, d):
    n, k = A.read(spark, d, "nation"), F.col("n_nationkey")
    away, home = F.concat(F.lit("r"), (F.col("n_regionkey") % 2).cast("string")), F.concat(F.lit("k"), (k % 4).cast("string"))
    start = lambda hours: F.lit(NOON) + (k % 3).cast("long") * 86_400_000 + (k % hours).cast("long") * HOUR
    schedule = n.select(k.alias("game"), start(5).alias("start_ms"), away.alias("away"), home.alias("home"), F.array(home, away).alias("codes"))
    markets = n.select(F.concat(F.lit("m"), k.cast("string")).alias("market"), start(9).alias("start_ms"), F.array(home, away).alias("names"))
    events = n.select(F.concat(F.lit("e"), k.cast("string")).alias("event"), F.date_add(F.to_date(F.lit("2026-01-01")), k % 3).alias("day"), F.array(away, home).alias("codes"))
    return links.discovery(schedule, markets, events).select("game", "start_ms", F.concat_ws(",", "novig").alias("novig"), F.concat_ws(",", "kalshi").alias("kalshi"))


@query("SELECT 'r' || o_orderkey AS request_id, '/x/' || o_custkey AS path, CASE WHEN o_orderkey % 7 <> 0 THEN CASE WHEN o_orderkey % 11 = 0 THEN 500 ELSE 200 END END AS status, coalesce(o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 5 <> 0, false) AS ok, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey * 10 + 1 END AS body_ms FROM orders")
def rest_sessions(spark, d):
    o, k = A.read(spark, d, "orders"), F.col("o_orderkey")
    rid = F.concat(F.lit("r"), k.cast("string"))
    request = F.format_string('{"type":"rest_request","request_id":"%s","path":"/x/%s"}', rid, "o_custkey")
    done = F.format_string('{"type":"rest_complete","request_id":"%s","status":%s,"failure":null}', rid, F.when(k % 11 == 0, 500).otherwise(200))
    one = lambda n, way, text: F.struct((k * 10 + n).alias("recv_ts_ms"), F.lit(way).alias("dir"), text.alias("frame"))
    rows = F.array_compact(F.array(one(0, "event", request), F.when(k % 5 != 0, one(1, "in", F.lit("{}"))), F.when(k % 7 != 0, one(2, "event", done))))
    framed = o.select(rid.alias("conn_id"), F.lit("f").alias("relpath"), F.lit("0").alias("seg_pos"), F.lit(0).alias("line"), F.explode(rows).alias("f")).select("conn_id", "relpath", "seg_pos", "line", "f.*")
    return archive.rest_exchanges(framed).select("request_id", "path", "status", "ok", F.col("body.recv_ts_ms").alias("body_ms"))


@query(
    """WITH e AS (SELECT conv_id, turn, role = 'assistant' AS pitch, turn % 2 = 0 AS change, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations), f AS (SELECT conv_id, min(pos) FILTER (pitch) AS first FROM e GROUP BY 1)
    SELECT 'c' || e.conv_id AS request_id, CAST(e.pos AS INTEGER) AS pos, CASE WHEN e.pos = f.first THEN 'first_pitch' ELSE 'status_change' END AS kind FROM e JOIN f USING (conv_id) WHERE e.pos = f.first OR (f.first IS NULL OR e.pos < f.first) AND e.change"""
)
def first_play_events(spark, d):
    t = F.struct(F.col("turn"), (F.col("role") == "assistant").alias("isPitch"), F.lit("action").alias("type"), F.lit("2026-01-01T00:00:00Z").alias("startTime"), F.struct(F.when(F.col("turn") % 2 == 0, "Status Change - x").otherwise("other").alias("description")).alias("details"))
    c = A.read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(t)).alias("playEvents"))
    body = F.to_json(F.struct(F.array(F.struct("playEvents")).alias("allPlays")))
    x = c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("request_id"), F.struct(body.alias("frame")).alias("body"))
    return venues.first_play(x).select("request_id", "pos", "kind")
