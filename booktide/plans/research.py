"""Registered queries of identity, closes, scores and calibration, with twins written from the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import held
from ..operators import calibration, identity, imports, scoring, stats
from . import adapters as A
from .adapters import sql
from .closing import DEFS, LIVE, reduced_sql
from .integrity import _with, ledger
from .queries import DAY, query

KALSHI, ODDS = 100_000_000, 200_000_000


def _users(spark, d) -> DataFrame:
    return A.ticks(spark, d).select(F.col("instrument").alias("u")).distinct()


def market_facts(spark, d) -> scoring.Facts:
    """events as a market: an outcome for each user, three instruments for each, entries and quotes from events."""
    u, t, live = _users(spark, d), A.ticks(spark, d), A.live_facts(spark, d)
    n, c = F.col("tick_id"), F.col("u")
    venue = lambda base, v, op: u.select((c + base).alias("instrument"), F.lit(v).alias("venue"), c.cast("string").alias("native_id"), op.alias("operator"))
    none = F.lit(None).cast("string")
    book = F.when(c % 3 == 0, "draftkings").when(c % 3 == 1, "fanduel").otherwise("other")
    mapped = lambda first, base, side, polarity, status, equal: u.select((c + first).alias("mapping_id"), (c + base).alias("instrument"), side.cast("int").alias("side"), c.alias("outcome_id"), polarity.alias("polarity"), status.alias("status"), equal.alias("equivalence"), F.lit(None).cast("long").alias("supersedes"))
    exact, equal, direct = F.lit("exact"), F.lit("equivalent"), F.lit("direct")
    mappings = (
        mapped(0, 0, c % 2, direct, F.when(c % 10 == 3, "rejected").when(c % 10 == 4, "fuzzy_candidate").otherwise("exact"), F.when(c % 7 == 5, "pending").otherwise("equivalent"))
        .union(mapped(10**9, 0, 1 - c % 2, F.when(c % 11 == 2, "direct").otherwise("complement"), exact, equal))
        .union(mapped(2 * 10**9, KALSHI, F.lit(0), direct, exact, equal).where("outcome_id % 4 <> 1"))
        .union(mapped(3 * 10**9, ODDS, F.lit(0), direct, exact, equal))
    )
    claims = A.claims(spark, d).select((F.floor(F.col("event_id") / 1000) - F.floor(F.col("event_id") / 1000) % 2).alias("event_id"), "source", "kind", (F.col("at_ms") + 20 * DAY).alias("at_ms"))
    entries = t.select(n.alias("entry_id"), (F.col("instrument") - F.col("instrument") % 2).alias("event_id"), F.col("instrument").alias("outcome_id"), (F.col("instrument") + ODDS).alias("instrument"), F.lit(0).alias("side"), (F.col("at_ms") + 1).alias("decision_ms"))
    return scoring.Facts(
        outcomes=u.select(c.alias("outcome_id"), (c - c % 2).alias("event_id")), instruments=venue(0, "novig", none).union(venue(KALSHI, "kalshi", none)).union(venue(ODDS, "odds_api", book)), mappings=mappings, claims=claims,
        ticks=live["ticks"], evidence=live["evidence"], gaps=live["gaps"], levels=live["levels"], entries=entries,
        quotes=t.select(n.alias("quote_id"), n.alias("entry_id"), F.lit("decision_quote").alias("concept"), (100 + n % 300).alias("d_num"), F.lit(100).cast("long").alias("d_den")),
        opposite=t.where("tick_id % 5 <> 0").select(n.alias("entry_id"), (100 + n * 7 % 250).alias("d_num"), F.lit(100).cast("long").alias("d_den")),
    )


#: The same in SQL, up to the references of each outcome.
FACTS = f""", users AS (SELECT DISTINCT instrument AS u FROM ticks), insts AS (SELECT u AS instrument, 'novig' AS venue, CAST(u AS VARCHAR) AS native_id, NULL AS operator FROM users UNION ALL SELECT u + {KALSHI}, 'kalshi', CAST(u AS VARCHAR), NULL FROM users
    UNION ALL SELECT u + {ODDS}, 'odds_api', CAST(u AS VARCHAR), CASE u % 3 WHEN 0 THEN 'draftkings' WHEN 1 THEN 'fanduel' ELSE 'other' END FROM users),
    maps AS (SELECT u AS mapping_id, u AS instrument, u % 2 AS side, u AS outcome_id, 'direct' AS polarity, CASE WHEN u % 10 = 3 THEN 'rejected' WHEN u % 10 = 4 THEN 'fuzzy_candidate' ELSE 'exact' END AS status, CASE WHEN u % 7 = 5 THEN 'pending' ELSE 'equivalent' END AS equivalence FROM users
    UNION ALL SELECT u + 1000000000, u, 1 - u % 2, u, CASE WHEN u % 11 = 2 THEN 'direct' ELSE 'complement' END, 'exact', 'equivalent' FROM users UNION ALL SELECT u + 2000000000, u + {KALSHI}, 0, u, 'direct', 'exact', 'equivalent' FROM users WHERE u % 4 <> 1
    UNION ALL SELECT u + 3000000000, u + {ODDS}, 0, u, 'direct', 'exact', 'equivalent' FROM users),
    heads AS (SELECT *, CASE WHEN status = 'rejected' THEN 'mapping_rejected' WHEN status NOT IN ('exact', 'manual_verified') THEN 'mapping_unverified' WHEN equivalence = 'pending' THEN 'equivalence_pending' END AS ineligible FROM maps),
    starts AS (SELECT event_id // 1000 - event_id // 1000 % 2 AS event_id, min(at_ms) + 1728000000 AS earliest, max(at_ms) - min(at_ms) AS span, count(*) FILTER (source = 'mlb_statsapi') AS o FROM claims WHERE (source, kind) IN (('mlb_statsapi', 'first_pitch'), ('mlb_statsapi', 'status_in_progress'), ('novig_stream', 'venue_golive')) GROUP BY 1),
    direct AS (SELECT i.venue, h.outcome_id, count(*) AS n, min(h.instrument) AS instrument, arg_min(h.side, (h.instrument, h.side)) AS side, arg_min(i.native_id, (h.instrument, h.side)) AS native_id, arg_min({{'v': h.ineligible}}, (h.instrument, h.side)).v AS ineligible FROM heads h JOIN insts i USING (instrument) WHERE h.polarity = 'direct' AND h.status <> 'rejected' GROUP BY ALL),
    refs AS (SELECT u.u AS outcome_id, v.venue, r.instrument, r.side, r.native_id, r.ineligible, CASE WHEN r.n IS NULL THEN 'unmapped' WHEN r.n > 1 THEN 'ambiguous_reference' WHEN EXISTS (SELECT 1 FROM heads o WHERE o.instrument = r.instrument AND o.side = 1 - r.side AND o.status <> 'rejected' AND (o.polarity = 'direct') = (o.outcome_id = u.u)) THEN 'mapping_inconsistent' END AS reason
        FROM users u CROSS JOIN (VALUES ('novig'), ('kalshi')) v(venue) LEFT JOIN direct r ON r.outcome_id = u.u AND r.venue = v.venue),
    cuts AS (SELECT r.*, s.earliest - 60000 AS cutoff_ms, CASE WHEN s.o IS NULL OR s.o = 0 THEN 'no_trusted_off' WHEN s.span > 2160000000 THEN 'off_disagreement' END AS off_reason FROM refs r LEFT JOIN starts s ON s.event_id = r.outcome_id - r.outcome_id % 2),
    req AS (SELECT 'c/' || outcome_id || '/' || venue AS request_id, venue, native_id, instrument, side, cutoff_ms AS as_of_ms FROM cuts WHERE off_reason IS NULL AND reason IS NULL
        UNION ALL SELECT 'e/' || t.tick_id || '/' || r.venue, r.venue, r.native_id, r.instrument, r.side, t.at_ms + 1 FROM ticks t JOIN refs r ON r.outcome_id = t.instrument WHERE r.reason IS NULL)"""
CLOSES = """, closes AS (SELECT c.outcome_id, c.venue, d.def_name, c.cutoff_ms, l.tick_id, l.p_num, l.p_den, l.quote_age_ms, l.liveness_age_ms, l.bracket_ms, l.spread_e4, coalesce(c.off_reason, c.reason, l.reason) AS reason
    FROM cuts c CROSS JOIN d LEFT JOIN live l ON l.request_id = 'c/' || c.outcome_id || '/' || c.venue AND l.def_name = d.def_name)"""
NEEDED = ("ticks", "gaps", "claims", "lticks", "lsigns", "lgaps", "llevels")
OPEN = {"novig": "OPEN", "kalshi": "OPEN"}


@query(sql(f"{FACTS} {LIVE} {CLOSES} SELECT * FROM closes", *NEEDED))
def close_prices(spark, d):
    x = scoring.close_prices(market_facts(spark, d), DEFS, 25 * DAY, OPEN)
    return x.select("outcome_id", "venue", "def_name", "cutoff_ms", "tick_id", "p_num", "p_den", "quote_age_ms", "liveness_age_ms", "bracket_ms", F.col("spread_e4").cast("long"), "reason")


VALUE = """SELECT t.tick_id AS entry_id, r.venue, c.def_name, (100 + t.tick_id % 300)::HUGEINT AS dn, 100::HUGEINT AS dd, c.p_num::HUGEINT AS cn, c.p_den::HUGEINT AS cd, l.p_num::HUGEINT AS rn, l.p_den::HUGEINT AS rd, l.tick_id AS ref_tick_id, coalesce(r.reason, l.reason) AS ref_entry_reason,
    CASE WHEN t.tick_id % 5 <> 0 THEN (100 + t.tick_id * 7 % 250)::HUGEINT END AS o, list_filter([CASE WHEN t.instrument % 3 = 2 THEN 'unlicensed_book' END, coalesce(r.reason, r.ineligible), CASE WHEN NOT coalesce(t.at_ms + 1 < c.cutoff_ms, false) THEN 'entry_after_cutoff' END, c.reason], lambda x: x IS NOT NULL) AS why
    FROM ticks t JOIN refs r ON r.outcome_id = t.instrument JOIN closes c ON c.outcome_id = t.instrument AND c.venue = r.venue LEFT JOIN live l ON l.request_id = 'e/' || t.tick_id || '/' || r.venue AND l.def_name = c.def_name"""


def _fraction(num: str, den: str, name: str) -> str:
    return reduced_sql(num, den, name)


@query(
    sql(
        f"""{FACTS} {LIVE} {CLOSES}, v AS ({VALUE}) SELECT entry_id, venue, def_name, ref_tick_id, ref_entry_reason, {_fraction('cn * dn - cd * dd', 'cd * dd', 'ev')}, {_fraction('rn * dn - rd * dd', 'rd * dd', 'null_ev')}, {_fraction('(cn * rd - rn * cd) * dn', 'cd * rd * dd', 'residual')},
        {_fraction('o * dd', 'dn * 100 + o * dd', 'q')}, CASE WHEN o IS NULL OR rn IS NULL THEN NULL ELSE CAST(abs(o * dd * rd - rn * (dn * 100 + o * dd)) * 100 > 8 * (dn * 100 + o * dd) * rd AS INTEGER) END AS outlier,
        CASE WHEN o IS NULL THEN 'no_opposite_quote' WHEN rn IS NULL THEN 'no_reference_at_entry' END AS agreement_reason, array_to_string([x FOR x, i IN why IF list_position(why, x) = i], ',') AS reasons FROM v""",
        *NEEDED,
    )
)
def entry_scores(spark, d):
    f = market_facts(spark, d)
    c = held(scoring.close_prices(f, DEFS, 25 * DAY, OPEN))
    x = scoring.scores(f, c, DEFS, OPEN)
    return x.select("entry_id", "venue", "def_name", "ref_tick_id", "ref_entry_reason", *(f"{k}_{s}" for k in ("ev", "null_ev", "residual", "q") for s in ("num", "den")), "outlier", "agreement_reason", F.concat_ws(",", "reasons").alias("reasons"))


def _ledger_sql(body: str) -> str:
    return f"{_with()} {body}"


HEADS = "heads AS (SELECT *, count(*) OVER (PARTITION BY instrument, side) AS n_heads, row_number() OVER (PARTITION BY instrument, side ORDER BY mapping_id DESC) AS k FROM mapping m WHERE NOT EXISTS (SELECT 1 FROM mapping s WHERE s.supersedes = m.mapping_id))"


@query(_ledger_sql(f", {HEADS} SELECT instrument, side, mapping_id, n_heads, CASE WHEN n_heads > 1 THEN 'mapping_conflict' WHEN status = 'rejected' THEN 'mapping_rejected' END AS ineligible FROM heads WHERE k = 1"))
def mapping_heads(spark, d):
    m = ledger(spark, d)["mapping"].withColumn("equivalence", F.lit("equivalent"))
    return identity.current_mappings(m).select("instrument", "side", "mapping_id", "n_heads", "ineligible")


def _pairs(spark, d) -> DataFrame:
    li = A.read(spark, d, "lineitem")
    return li.select((F.col("l_linenumber") % 2 * 900 + 900).cast("int").alias("offset_s"), F.col("l_orderkey").alias("event_id"), (F.col("l_discount") * 5 + 0.2).alias("p_entry"), (F.col("l_discount") * 5 + 0.2 + F.col("l_tax") / 4).alias("p_close"))


FIT = """WITH p AS (SELECT CAST(l_linenumber % 2 * 900 + 900 AS INTEGER) AS k, l_orderkey AS e, l_discount * 5 + 0.2 AS pe, l_discount * 5 + 0.2 + l_tax / 4 AS pc FROM lineitem),
    x0 AS (SELECT *, pc - pe AS y, pe - 0.5 AS x, power((pe - 0.5) / 0.2, 2) AS q FROM p), x AS (SELECT * REPLACE (x - avg(x) OVER (PARTITION BY k) AS x, q - avg(q) OVER (PARTITION BY k) AS q) FROM x0),
    s AS (SELECT k, count(*) AS n, count(DISTINCT e) AS g, avg(y) AS b0, sum(x * x) AS xx, sum(x * q) AS xq, sum(q * q) AS qq, sum(x * y) AS xy, sum(q * y) AS qy FROM x GROUP BY k),
    b AS (SELECT *, xx * qq - xq * xq AS det, (qq * xy - xq * qy) / (xx * qq - xq * xq) AS b1, (xx * qy - xq * xy) / (xx * qq - xq * xq) AS b2, g / (g - 1) * ((n - 1) / (n - 3)) AS c FROM s),
    r AS (SELECT x.*, y - b0 - b1 * x - b2 * q AS u FROM x JOIN b USING (k)), t AS (SELECT k, e, sum(u) AS u0, sum(u * x) AS u1, sum(u * q) AS u2 FROM r GROUP BY k, e)"""
MEAT = ", m AS (SELECT k, sum(u0 * u0) AS m00, sum(u1 * u1) AS m11, sum(u1 * u2) AS m12, sum(u2 * u2) AS m22 FROM t GROUP BY k), f AS (SELECT b.*, sqrt(c * m00) / n AS se0, sqrt(c * (qq * qq * m11 - 2 * qq * xq * m12 + xq * xq * m22)) / det AS se1, sqrt(c * (xq * xq * m11 - 2 * xq * xx * m12 + xx * xx * m22)) / det AS se2 FROM b JOIN m USING (k))"
Z = stats.Z90


@query(f"{FIT} {MEAT}, c AS (SELECT k, unnest(['intercept', 'slope', 'curvature']) AS component, unnest([b0, b1, b2]) AS v, unnest([se0, se1, se2]) AS se, unnest([0.005, 0.05, 0.016]) AS margin, g, n FROM f) SELECT k AS offset_s, component, g AS n_events, n AS n_rows, round(v, 7) AS estimate, round(se, 7) AS se, CASE WHEN v - {Z} * se >= -margin AND v + {Z} * se <= margin THEN 'passed' ELSE 'failed' END AS outcome FROM c")
def martingale_check(spark, d):
    rows, _, _ = calibration.martingale(_pairs(spark, d), (900, 1800))
    return calibration.results(spark, rows).select("offset_s", "component", "n_events", "n_rows", F.round("estimate", 7).alias("estimate"), F.round("se", 7).alias("se"), "outcome")


@query(
    f"""{FIT}, n AS (SELECT *, (rank() OVER (PARTITION BY k ORDER BY pe) - 1) * 5 // count(*) OVER (PARTITION BY k) AS bin FROM r), w AS (SELECT k, bin, count(*) AS nb, count(DISTINCT e) AS gb, avg(u) AS mean, avg(x) AS wx, avg(q) AS wq, min(pe) AS lo, max(pe) AS hi FROM n GROUP BY k, bin),
    v AS (SELECT w.*, b.c, 1.0 / b.n AS v0, (qq * wx - xq * wq) / det AS v1, (xx * wq - xq * wx) / det AS v2 FROM w JOIN b USING (k)), z AS (SELECT k, e, bin, sum(u) AS rb FROM n GROUP BY ALL),
    y AS (SELECT v.k, v.bin, sum(power(coalesce(z.rb, 0) / nb - (u0 * v0 + u1 * v1 + u2 * v2), 2)) AS ss FROM v JOIN t USING (k) LEFT JOIN z ON z.k = v.k AND z.bin = v.bin AND z.e = t.e GROUP BY v.k, v.bin)
    SELECT v.k AS offset_s, 'bin:' || v.bin AS component, gb AS n_events, nb AS n_rows, round(mean, 7) AS estimate, round(sqrt(c * ss), 7) AS se, CASE WHEN mean - {Z} * sqrt(c * ss) > 0.005 OR mean + {Z} * sqrt(c * ss) < -0.005 THEN 'flagged' ELSE 'not_flagged' END AS outcome FROM v JOIN y USING (k, bin)"""
)
def lack_of_fit(spark, d):
    _, fitted, fits = calibration.martingale(_pairs(spark, d), (900, 1800))
    return calibration.results(spark, calibration.lack_of_fit(fitted, fits)).select("offset_s", "component", "n_events", "n_rows", F.round("estimate", 7).alias("estimate"), F.round("se", 7).alias("se"), "outcome")


def _agree(spark, d) -> DataFrame:
    li = A.read(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("entry_id"), F.col("l_orderkey").alias("event_id"), (F.col("l_discount") * 5 + 0.2 + F.col("l_tax") - 0.04).alias("q_entry"), (F.col("l_discount") * 5 + 0.2).alias("p_entry"))


@query(
    """WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS c, l_tax - 0.04 AS y, 2 * (l_discount * 5 + 0.2) - 1 AS x FROM lineitem), s AS (SELECT count(*) AS n, count(DISTINCT c) AS g, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM r),
    b AS (SELECT *, n * sxx - sx * sx AS det, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b1, (sxx * sy - sx * sxy) / (n * sxx - sx * sx) AS b0 FROM s), u AS (SELECT c, sum(y - b0 - b1 * x) AS u0, sum((y - b0 - b1 * x) * x) AS u1 FROM r, b GROUP BY c), m AS (SELECT sum(u0 * u0) AS m00, sum(u0 * u1) AS m01, sum(u1 * u1) AS m11 FROM u)
    SELECT round(b1, 7) AS slope, round(sqrt((sx * sx * m00 - 2 * n * sx * m01 + n * n * m11) / (det * det) * g / (g - 1) * (n - 1) / (n - 2)), 7) AS se, n, (SELECT count(*) FROM r WHERE abs(y) > 0.08) AS n_unresolved FROM b, m"""
)
def agreement_gate(spark, d):
    x = _agree(spark, d)
    return calibration.agreement_gate(x, x.limit(0)).select(F.round("slope", 7).alias("slope"), F.round("se", 7).alias("se"), "n", "n_unresolved")


@query(
    """WITH e AS (SELECT l_orderkey AS e, l_linenumber % 3 AS b, l_linenumber % 2 AS k, avg(l_extendedprice / (l_extendedprice + l_quantity)) - 1 AS v FROM lineitem GROUP BY ALL), f AS (SELECT k, e FROM e GROUP BY ALL HAVING count(DISTINCT b) = 3),
    a AS (SELECT 'all' AS subset, * FROM e UNION ALL SELECT 'matched', e.* FROM e JOIN f USING (k, e)) SELECT CAST(k AS INTEGER) AS offset_s, CAST(b AS INTEGER) AS buffer_s, subset, count(*) AS n, round(avg(v), 7) AS mean, round(sqrt(sum(power(v - m, 2)) * count(*) / (count(*) - 1)) / count(*), 7) AS se FROM (SELECT *, avg(v) OVER (PARTITION BY k, b, subset) AS m FROM a) GROUP BY k, b, subset"""
)
def oracle_sweep(spark, d):
    li = A.read(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") % 3).alias("b"), (F.col("l_linenumber") % 2).alias("k")).agg(F.avg(F.col("l_extendedprice") / (F.col("l_extendedprice") + F.col("l_quantity"))).alias("v"))
    # A winner of its own for each (event, offset), so that offsets do not meet.
    own = F.col("l_orderkey") * 2 + F.col("k")
    entries = li.select(F.col("l_orderkey").alias("event_id"), own.alias("outcome_id"), F.lit(None).cast("string").alias("reason")).distinct()
    prices = li.select(F.col("l_orderkey").alias("event_id"), own.alias("outcome_id"), F.lit("buffer").alias("point"), F.col("b").cast("int").alias("seconds"), F.col("v").alias("p"))
    starts = li.select(F.col("l_orderkey").alias("event_id"), own.alias("outcome_id"), F.lit("offset").alias("point"), F.col("k").cast("int").alias("seconds"), F.lit(1.0).alias("p")).distinct()
    x = calibration.oracle_sweep(entries, prices.unionByName(starts), calibration.Spec(buffers_s=(0, 1, 2)))
    return x.select("offset_s", "buffer_s", "subset", "n", F.round("mean", 7).alias("mean"), F.round("se", 7).alias("se"))


@query(sql(", a AS (SELECT *, lag(result) OVER (PARTITION BY instrument ORDER BY id) AS before FROM observations), k AS (SELECT id, lag(id) OVER (PARTITION BY instrument ORDER BY id) AS supersedes FROM a WHERE before IS DISTINCT FROM result) SELECT a.instrument, id, a.result, CASE WHEN before IS DISTINCT FROM result THEN 'insert' ELSE 'repeat' END AS action, k.supersedes FROM a LEFT JOIN k USING (id)", "observations"))
def settlement_import(spark, d):
    o = A.observations(spark, d).select(F.lit("s").alias("source"), F.col("instrument").alias("subject"), "result", F.lit(None).cast("string").alias("value"), F.col("id").alias("place"))
    x = imports.settle(o, o.limit(0))
    return x.select(F.col("subject").alias("instrument"), F.col("place").alias("id"), "result", "action", "supersedes")

