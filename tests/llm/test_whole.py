"""Whole jobs: cases that samples, caps and filters have lost."""

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from booktide.llm import common, line_dedup, ngram_join, tokens, toxicity


def _kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.n_kept for r in line_dedup.dedup_lines(docs).collect()}


def _planted(n, words, boilerplate=""):
    """Pairs of lines that differ in one character of their own words, of Jaccard similarity 0.8 to 0.95."""
    r, out = random.Random(9), []
    while len(out) < 2 * n:
        a = boilerplate + " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 8))) for _ in range(words))
        k = r.randrange(len(boilerplate), len(a))
        b = a[:k] + "#" + a[k + 1 :]
        p, q = ({f" {x}"[i : i + 8] for i in range(len(x) - 6)} for x in (a, b))
        if 0.8 <= len(p & q) / len(p | q) < 0.95:
            out += [a, b]
    return out


def test_line_dedup_signs_all_shingles(spark):
    got = _kept(spark, _planted(300, 10))
    assert sum(got[k] == 0 for k in range(1, 600, 2)) >= 294 and all(got[k] == 1 for k in range(0, 600, 2))


def test_line_dedup_lengths(spark):
    assert _kept(spark, ["some text", " " * 60 + "some text", "-" * 20, "-" * 80, "again and " * 3, "again and " * 30]) == {0: 1, 1: 0, 2: 1, 3: 0, 4: 1, 5: 0}


def test_line_dedup_bands_without_window(spark, monkeypatch):
    docs, plans = spark.createDataFrame([(k, f"{'the same long line ' * 5}{k}") for k in range(50)], "doc_id long, text string"), []
    kept = line_dedup.kept
    monkeypatch.setattr(line_dedup, "kept", lambda df, release=False: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, release))[1])
    line_dedup.dedup_lines(docs).count()
    assert plans and not any("Window" in p for p in plans)


def test_line_dedup_all_pairs_of_a_band(spark):
    got = _kept(spark, _planted(150, 6, " ".join(f"common{k}" for k in range(20)) + " "))
    assert sum(got[k] == 0 for k in range(1, 300, 2)) >= 148


def test_line_dedup_open_pairs(spark):
    members = spark.createDataFrame([(h, 7, 5) for h in range(1, 6)] + [(h, 8, 3) for h in range(1, 4)], "h long, band long, n long")
    groups = spark.createDataFrame([(1, 1), (5, 1)], "id long, component long")
    got = {(r.a, r.b) for r in line_dedup._open_pairs(members, groups).collect()}
    assert got == {(a, b) for a in range(1, 6) for b in range(a + 1, 6)} - {(1, 5)}


def test_line_dedup_marks_rule_out_no_link(spark):
    r, lines = random.Random(3), []
    for _ in range(4):
        base = "".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=r.choice((40, 120, 400))))
        for _ in range(12):
            x = list(base)
            for _ in range(r.randint(0, 5)):
                x[r.randrange(len(x))] = "#"
            lines.append("".join(x))
    lines = sorted({" ".join(x.split()) for x in lines})
    sets = [{f" {x}"[i : i + 8] for i in range(max(1, len(x) - 6))} for x in lines]
    near = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(lines)) for b in range(a + 1, len(lines))}
    texts = common.kept(line_dedup._sized(spark.createDataFrame(list(enumerate(lines)), "id long, line string")))
    members = spark.createDataFrame([(k, 7, len(lines)) for k in range(len(lines))], "h long, band long, n long")
    none = common.kept(spark.createDataFrame([], "id long, component long"))
    got = {(x.a, x.b) for x in line_dedup._open_pairs(members, none, texts).collect()}
    assert {k for k, v in near.items() if v >= 0.8} <= got <= {k for k, v in near.items() if v >= 0.6} and len(got) < len(near) / 4


def test_line_dedup_marks_rule_out_pairs_just_under_a_link(spark):
    r, lines = random.Random(6), []
    base = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=700))
    for _ in range(60):
        x = list(base)
        for _ in range(8):
            x[r.randrange(len(x))] = "#"
        lines.append("".join(x))
    sets = [{f" {x}"[i : i + 8] for i in range(len(x) - 6)} for x in lines]
    near = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(60) for b in range(a + 1, 60)}
    texts = common.kept(line_dedup._sized(spark.createDataFrame(list(enumerate(lines)), "id long, line string")))
    members = spark.createDataFrame([(k, 7, 60) for k in range(60)], "h long, band long, n long")
    none = common.kept(spark.createDataFrame([], "id long, component long"))
    got = {(x.a, x.b) for x in line_dedup._open_pairs(members, none, texts).collect()}
    assert {k for k, v in near.items() if v >= 0.8} <= got <= {k for k, v in near.items() if v >= 0.72}
    assert sum(0.7 <= v < 0.8 for v in near.values()) > 1000 and sum(near[k] < 0.8 for k in got) < 500


def test_line_dedup_marks_of_repeated_shingles(spark):
    r, lines = random.Random(8), ["x" * 300, "x" * 301 + "y", "ab" * 100, "ab" * 100 + "a", "again and " * 3, "again and " * 30]
    lines += ["".join(r.choices("ab", k=k)) for k in (60, 200, 600, 2000)]
    texts = {x.id: x for x in line_dedup._sized(spark.createDataFrame(list(enumerate(lines)), "id long, line string")).collect()}
    for k, line in enumerate(lines):
        own = {f" {line.strip()}"[i : i + 8] for i in range(max(1, len(line.strip()) - 6))}
        marks = sum((texts[k][f"w{w}"] & (1 << 64) - 1).bit_count() for w in range(line_dedup.MARKS))
        assert texts[k].size == len(own) and marks <= len(own) and (marks - len(own)) % 2 == 0


def test_line_dedup_compares_few_pairs_of_a_large_group(spark, monkeypatch):
    r, base, seen, linked = random.Random(5), [f"w{k}x" for k in range(60)], [], line_dedup._linked
    texts = [" ".join(w if r.random() > 0.04 else f"v{r.randrange(9999)}" for w in base) for _ in range(200)]
    monkeypatch.setattr(line_dedup, "_linked", lambda pairs, texts: (seen.append(pairs.count()), linked(pairs, texts))[1])
    sets = [{f" {x}"[i : i + 8] for i in range(len(x) - 6)} for x in texts]
    alone = sum(all(k == j or len(s & t) < 0.8 * len(s | t) for j, t in enumerate(sets)) for k, s in enumerate(sets))
    got = _kept(spark, texts)
    assert sum(seen) < 200 * 199 / 2 / 4 and 1 <= sum(got.values()) <= alone + 8


def test_line_dedup_compares_a_line_once_with_its_group(spark, monkeypatch):
    r, seen, linked = random.Random(4), [], line_dedup._linked
    base = [" ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(8)) for _ in range(12)]
    texts = [x[:k].upper() + x[k:] for x in base for k in range(1, 9) if x[k - 1] != " "]
    monkeypatch.setattr(line_dedup, "_linked", lambda pairs, texts: (seen.append(pairs.count()), linked(pairs, texts))[1])
    assert sum(_kept(spark, texts).values()) == 12 and sum(seen) == len(set(texts)) - 12


def test_line_dedup_pairs_of_small_bands(spark):
    signed = spark.createDataFrame([(1, 10, 20), (5, 10, 21), (9, 11, 22), (12, 11, 22), (17, 11, 22), *((k, 12, 23 + k) for k in range(30, 35))], "id long, b0 long, b1 long")
    pairs, members = line_dedup._members(signed, range(2))
    got = Counter((x.a, x.b) for x in pairs.collect())
    assert set(got) == {(1, 5), (9, 12), (9, 17), (12, 17)} | {(a, b) for a in range(30, 35) for b in range(a + 1, 35) if a == 30 or b == 34}
    assert {tuple(x) for x in members.select("id", "band", "n").collect()} == {(k, 12, 5) for k in range(30, 35)}


def test_line_dedup_lets_go_of_its_tables(spark):
    had = {path for _, path in common._scratch}
    assert sum(n == 0 for n in _kept(spark, _planted(20, 10)).values()) >= 18
    left = [set(spark.read.parquet(path).columns) for _, path in common._scratch if path not in had]
    assert left and not any({"line", "h2", "bands"} & c and "keep" not in c and "g" not in c for c in left)


def test_line_dedup_links_are_exact(spark):
    lines = [*_planted(30, 8), "short", "Short", "", "x" * 300, "x" * 200 + "y" * 100]
    sets = [{f" {x.lower()}"[i : i + 8] for i in range(max(1, len(x) - 6))} for x in lines]
    pairs = [(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines))]
    texts = line_dedup._sized(spark.createDataFrame(list(enumerate(lines)), "id long, line string"))
    assert {r.id: r.size for r in texts.collect()} == {k: len(s) for k, s in enumerate(sets)}
    got = {(r.a, r.b) for r in line_dedup._linked(spark.createDataFrame(pairs, "a long, b long"), texts).collect()}
    assert got == {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def test_components_of_few_links_take_no_shuffle(spark, monkeypatch):
    r, plans, kept = random.Random(2), [], common.kept
    links = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2060)] + [(7, 7)]
    links = spark.createDataFrame(links, "a long, b long")
    monkeypatch.setattr(common, "kept", lambda df, release=False: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, release))[1])
    few = {(x.id, x.component) for x in common.components(links).collect()}
    assert len(plans) > 5 and not any("Exchange" in p for p in plans[1:])
    monkeypatch.setattr(common, "LINKS_IN_ONE", 0)
    del plans[:]
    assert few == {(x.id, x.component) for x in common.components(links).collect()} and any("Exchange" in p for p in plans[1:])
    assert {(k, 1000) for k in range(1000, 1041)} | {(k, 2000) for k in range(2000, 2060)} <= few


def test_near_copies_by_row(spark):
    text, other = " ".join(f"w{k}" for k in range(40)), " ".join(f"v{k}" for k in range(40))
    rows = [(1, text), (1, text), (None, text), (2, text), (2, other), (None, "alone in here it is"), (3, ""), (4, None)]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(1, text), (2, other), (None, "alone in here it is"), (3, ""), (4, None)])


def test_mix_by_row(spark, tmp_path):
    spark.createDataFrame([(9, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(None, "a b c", "s0"), (1, "a b", "s0"), (1, "a b c d e f", "s0"), (2, "x y z", "s1"), (3, "x y", "s1"), (None, "q", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect())
    mixed = corpus_pipeline.mixing.mix(corpus_pipeline.queries.quality(spark, str(tmp_path), docs), F.col("_weight"), carry=("text",)).collect()
    assert got == Counter({(r.doc_id, r.text): r.taken // r.size for r in mixed if r.taken}) and any(k is None for k, _ in got)


def _new_tables(had):
    return [path for _, path in common._scratch if path not in had]


def test_stages_leave_what_their_rows_come_from(spark, tmp_path):
    spark.createDataFrame([(k, k % 2) for k in range(9)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    texts = [" ".join(f"w{k % 30}x{j}" for j in range(40)) for k in range(60)]
    docs = spark.createDataFrame([(k, t, f"s{k % 2}") for k, t in enumerate(texts)], "doc_id long, text string, source string")
    had = {path for _, path in common._scratch}
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert len(_new_tables(had)) == 2 and sorted(r.doc_id for r in out.collect()) == list(range(30))
    had = {path for _, path in common._scratch}
    out = corpus_pipeline.mix_sources(spark, docs, str(tmp_path))
    assert len(_new_tables(had)) == 2 and 60 <= out.count() <= 180
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().toString()  # small tables take the way of large ones
    had = {path for _, path in common._scratch}
    out = ngram_join.jaccard_components(docs)
    assert len(_new_tables(had)) == 1 and {(r.doc_id, r.component_id) for r in out.collect()} == {(k, k % 30) for k in range(60)}


def test_scratch_tables_of_an_outer_scope_stay(spark):
    with common.scratch() as outer:
        a = common.kept(spark.range(3))
        with common.scratch() as inner:
            b, c = inner(common.kept(spark.range(4))), common.kept(spark.range(5))
        assert a.count() == 3 and b.count() == 4
        outer(b)
    paths = {path for _, path in common._scratch}
    assert b.count() == 4 and b._scratch_path in paths and not {a._scratch_path, c._scratch_path} & paths


def test_open_tiles_in_rounds(spark, monkeypatch):
    r, seen, kept = random.Random(4), [], ngram_join.kept
    rows = [(k, 9, k % 7, [{"give": 2, "parts": 3, "keys": [r.randrange(-40, 40) for _ in range(3)]} for _ in range(2)]) for k in range(60)]
    named = spark.createDataFrame(rows, "id long, size long, group long, tiles array<struct<give: int, parts: int, keys: array<long>>>")
    monkeypatch.setattr(ngram_join, "kept", lambda df, release=False: (seen.append(out := kept(df, release)), out)[1])
    got = Counter((x.tile, x.n, x.id, x.group, x.band) for x in ngram_join._open_tiles(named).collect())
    every = [(key, k, g, band) for k, _, g, tiles in rows for band, t in enumerate(tiles) for key in t["keys"]]
    size, groups = Counter(e[0] for e in every), {}
    for key, _, g, _ in every:
        groups.setdefault(key, set()).add(g)
    assert got == Counter((key, size[key], k, g, band) for key, k, g, band in every if len(groups[key]) > 1)
    assert max(x.count() for x in seen) < sum(got.values()) / 2  # no round holds most of the rows


def test_nothing_learnt_drops_nothing(spark):
    docs = spark.createDataFrame([(1, "a clean text"), (2, ""), (3, None)], "doc_id long, text string")
    weights = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.clean(docs, weights).count() == 3


def test_tokens_remembered_once_and_kept_while_asked_for(monkeypatch):
    path = corpus_pipeline.queries.tokenizer()
    monkeypatch.setattr(tokens, "REMEMBERED", 40_000)
    cache, seen = tokens._Cache(path), []
    part = cache.part
    monkeypatch.setattr(cache, "part", lambda text, *more: (seen.append(text), part(text, *more))[1], raising=False)
    texts = [f"often word{k} {'abcdefghij'[k % 10]}{chr(97 + k // 10 % 26)}{chr(97 + k // 260)}z, don't OFTEN caf\xe9 中" for k in range(500)]
    for text in texts:
        want = cache.whole.encode(text, add_special_tokens=False).ids
        assert b"".join(map(cache.__getitem__, text.split(" "))) == b"".join(i.to_bytes(4, "little") for i in want)
    assert seen.count("often") == 2 and cache.held <= 40_000 and not hasattr(cache, "parts")
