"""Market operators against worked examples, and all registered queries against their SQL twins."""

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from booktide.functions import scalars as S
from booktide.operators import books, facts, series, stats, trades
from booktide.plans import queries as market

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    return f"{float(v):.7f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(market.ORACLE))
def test_twin(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = market.QUERIES[name](spark, DATA)
    want = con.execute(market.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = lambda rs: sorted(tuple(value(r[names.index(n)]) for n in sorted(names)) for r in rs)
    assert rows(want.fetchall()) == rows([tuple(r[n] for n in names) for r in got.collect()])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_scalars(spark):
    df = spark.createDataFrame([("0.485", -118), ("0.00015", 100), ("1.01", 50), ("1", 250), (None, None)], "p string, a long")
    rows = df.select(S.price_e4(F.col("p")).alias("e"), S.american_odds(F.col("a")).alias("o")).collect()
    assert [r.e for r in rows] == [4850, None, None, 10000, None]
    assert [r.o and tuple(r.o) for r in rows] == [(109, 59), (2, 1), None, (7, 2), None]
    url = spark.range(1).select(S.redacted(F.lit("https://x/y?apiKey=abc&z=1")).alias("u"), S.iso_ms(F.lit("2026-01-01T00:00:00Z")).alias("t")).first()
    assert url.u == "https://x/y?apiKey=REDACTED&z=1" and url.t == 1767225600000


def test_depth_walk(spark):
    rows = [(1, 0, 0, 4000, 30000), (1, 0, 1, 3500, 40000), (1, 1, 0, 4000, 20000), (1, 1, 1, 3500, 50000)]
    levels = spark.createDataFrame(rows, "book long, side int, rank int, price_e4 int, payout_cents long")
    for cents, mid, reason in ((50000, 0.505, None), (100000, None, "insufficient_depth")):
        x = books.two_sided(books.depth_walk(levels, ["book", "side"], cents), "book")
        r = x.select(books.mid_depth(cents).alias("m"), books.depth_reason(cents, F.lit(False)).alias("r")).first()
        assert (r.m is None if mid is None else abs(r.m - mid) < 1e-12) and r.r == reason


@pytest.mark.parametrize("polls,want", [
    ([(0, "a", 1), (10, "a", 0), (20, "a", 1)], [(5, 25, "request_failed")]), ([(0, "a", 1), (10, "b", 1)], [(5, 15, "recorder_restart")]),
    ([(0, "a", 1), (10, "a", 0)], [(5, None, "request_failed")]), ([(0, "a", 0), (10, "a", 1)], []),
])
def test_poll_gaps(spark, polls, want):
    df = spark.createDataFrame([("s", t, k, s, ok, t + 5) for k, (t, s, ok) in enumerate(polls)], "subject string, start_ms long, poll_id int, session string, ok int, recv_ms long")
    assert [(r.open_ms, r.close_ms, r.reason) for r in series.poll_gaps(df).collect()] == want


def test_starts(spark):
    pitch, venue = ("mlb_statsapi", "first_pitch"), ("novig_stream", "venue_golive")
    rows = [(1, *venue, 90), (1, *pitch, 100), (1, *pitch, 100), (2, *venue, 50), (3, *pitch, 0), (3, *pitch, 500), (4, "mlb_statsapi", "status_warmup", 1), (5, *pitch, 100), (5, *venue, 500), (6, "mlb_statsapi", "status_in_progress", 30)]
    got = {r.event: (r.n, r.earliest, r.selected, r.latest, r.reason) for r in facts.resolve_start(spark.createDataFrame(rows, "event long, source string, kind string, at_ms long"), "event", 120).collect()}
    assert got == {1: (2, 90, 100, 100, None), 2: (1, 50, 50, 50, "no_trusted_off"), 3: (2, 0, 0, 500, "off_disagreement"), 5: (2, 100, 100, 100, "off_disagreement"), 6: (1, 30, 30, 30, None)}


def test_greedy_match(spark):
    s = spark.createDataFrame([("k", 1, 100, 5000), ("k", 2, 110, 5000)], "k string, stream_id long, s_ms long, s_price int")
    e = spark.createDataFrame([("k", 7, 108, 5000), ("k", 8, 300, 5003), ("k", 9, 109, 5600)], "k string, execution_id long, e_ms long, e_price int")
    got = trades.greedy_match(trades.match_candidates(s, e, ["k"], 1000, 6), ["k"]).collect()
    assert {(r.stream_id, r.execution_id) for r in got} == {(1, 7), (2, 8)}


def test_regression_needs_clusters(spark):
    df = spark.createDataFrame([(k % 5, float(k), float(k * 2)) for k in range(50)], "c int, x double, y double")
    assert stats.ols_cluster(df, "y", ["x"], "c").reason == "insufficient_data"
    fit = stats.ols_cluster(df.withColumn("c", F.col("x").cast("int")), "y", ["x"], "c")
    assert abs(fit.value[1] - 2) < 1e-9 and fit.within(0, 1e-6)


def test_settlements_and_heads(spark):
    x = spark.createDataFrame([("s", 1, "win"), ("s", 2, "win"), ("s", 3, "lose"), ("s", 4, "win")], "k string, id long, result string")
    assert [(r.id, r.supersedes) for r in facts.settlement_changes(x, "k", ["id"], ["result"], "id").orderBy("id").collect()] == [(1, None), (3, 1), (4, 3)]
    o = spark.createDataFrame([("a", 1, None), ("a", 2, 1), ("b", 3, None), ("b", 4, None)], "k string, id long, old long")
    assert {(r.k, r.id, r.n_heads) for r in facts.heads(o, "k", "id", "old").collect()} == {("a", 2, 1), ("b", 4, 2)}
