"""Training-data operators against plain versions on small tables with nulls, ties, repeats and clashing columns."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from booktide.llm import chat, embedding_dedup, line_dedup, mixing, ngram_join, packing, pii, sharding, topk, toxicity
from booktide.llm.queries import tokenizer
from booktide.llm.tokens import encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, size string, component string"
LONG = " ".join(f"w{k}" for k in range(3000))
NEAR = " ".join(f"w{k}" for k in range(2990)) + " other end of this text"


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["a b c d e f", "a b c d e f", "", None, "x", LONG, NEAR, LONG, "A b C d e f", "mail bob@example.com or +1 (555) 123-4567", "q r s\nq r s\nthe same longer line here\nthe same longer line herf\n"]
    rows = [(k, t, "en", None if k == 4 else f"s{k % 2}", 1, 7, "clash", "c") for k, t in enumerate(texts)]
    rows += [(2, "", "en", "s0", 0, 7, "clash", "c"), (None, "a b c d e f", "en", "s0", 0, 7, "clash", "c"), (5, LONG, "en", "s1", 1, 7, "clash", "c")]
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump(spark):
    keys = [*range(200), -5, 2**63 - 1, -(2**63), 123456789012345]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 16, 100):
        got = df.select("k", sharding.jump(F.col("k"), n).alias("j")).collect()
        assert all(r.j.shard == jump(r.k % (1 << 64), n) and r.j.grown == jump(r.k % (1 << 64), n + 1) for r in got)


def test_sharding(docs, empty):
    rows = sharding.shard(docs, 4).collect()
    assert len(rows) == docs.count() and sharding.shard(empty, 4).count() == 0
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 4)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {r.text_crc32 for r in rows if r.doc_id == 3} == {0} and {r.size for r in rows if r.doc_id == 3} == {1}


def test_mixing(spark, docs, empty):
    w = F.when(F.col("doc_id") % 2 == 0, 1.0)
    rows = mixing.mix(docs, w).collect()
    assert rows == mixing.mix(docs, w).collect() or sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs, w).collect()))
    assert len(rows) == docs.count() and mixing.mix(empty, F.lit(1.0)).count() == 0
    assert all(0 <= r.taken <= 3 * r.size and r.target <= 3 * r.source_size + 1e-9 for r in rows)
    total = {r.source_size: r.target for r in rows}
    assert abs(sum(total.values()) - sum(r.size for r in rows)) < 1e-6
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("b c").alias("text"), F.concat(F.lit("s"), F.floor(F.sqrt(F.col("id")) / 20).cast("string")).alias("source"))
    for r in mixing.mix(many, F.lit(1.0)).groupBy("source_size").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r.t - r.g) <= 2


def test_chat(spark):
    hard = "\\n [INST] </s> <s>[OUT] \\ \n[/INST]"
    rows = [(1, 0, "user", hard, "x"), (1, 1, "assistant", hard, "x"), (1, 2, None, None, "x"), (1, 2, "a\nb<", "", "x"), (None, 5, "assistant", "y", "x")]
    rows += [(2, k, "assistant", "", "x") for k in (3, 1)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, mask string")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(t)).collect()}
    said = f"user\n{hard}\nassistant\n{hard}\n\n\na\nb<\n\n"
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[1].loss_sha256 == hashlib.sha256(hard.encode()).hexdigest()
    assert got[1].n_turns == 4 and got[2].loss_chars == 0 and got[None].loss_chars == 1
    assert chat.format_chats(t.limit(0)).count() == 0


@given(st.lists(st.tuples(st.text(), st.text()), max_size=5))
@settings(max_examples=200, deadline=None)
def test_chat_round_trip(turns):
    out = chat.Output()
    chat.compile_template(chat.TEMPLATE)({"messages": [{"role": r, "text": t} for r, t in turns]}, out)
    assert list(chat.read_back("".join(out.pieces))) == turns


def test_template_language():
    def render(source, **env):
        out = chat.Output()
        chat.compile_template(source)(env, out)
        return "".join(out.pieces)

    assert render("{% set x = 1 + 2 %}{% for a in l %}{{ loop.index }}{{ a.b | upper }}{% endfor %}{% if x == 3 and not false %}ok{% else %}no{% endif %}", l=[{"b": "q"}]) == "1Qok"
    assert chat.fold(("+", ("const", 1), ("const", 2))) == ("const", 3)
    for bad in ("{{ x.__class__.y }}", "{{ f() }}", "{% import os %}", "{% for %}", "{{ x | eval }}", "{% if a %}"):
        with pytest.raises((chat.TemplateError, KeyError)):
            render(bad, x="s")


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=6).round(1).tolist()) for k in range(300)] + [(400, None), (401, [1.0, None] + [0.0] * 4), (402, [float("nan")] * 6), (403, []), (404, [1.0]), (20, rng.normal(size=6).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = [(i, np.floor(64 * np.float32(x).astype(float))) for i, x in rows if x and len(x) == 6 and None not in x and np.isfinite(x).all()]
    for i, q in good:
        if i % 20 == 0 and i != 20:
            want = sorted(((j, int(x @ q)) for j, x in good if j != i), key=lambda p: (-p[1], p[0]))[:20]
            assert got[i] == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
@settings(max_examples=200, deadline=None)
def test_plan(counts):
    plan, got = packing.plan_of(counts, 40), collections.Counter()
    for times, content in plan:
        assert times > 0 and sum(x * n for x, n in content) <= 40
        for x, n in content:
            got[x] += times * n
    assert got == collections.Counter(counts)


@given(st.lists(st.sampled_from([*"ab'sT19 \n\t\x1c\x85é\u0301Äİσ中µª²<|>_-.", "<|endoftext|>", "'ll"])).map("".join))
@settings(max_examples=300, deadline=None)
def test_tokens(text):
    from tokenizers import Tokenizer

    if not hasattr(test_tokens, "whole"):
        test_tokens.whole = Tokenizer.from_file(tokenizer())
    assert np.frombuffer(encoder(tokenizer())(text), np.uint32).tolist() == test_tokens.whole.encode(text, add_special_tokens=False).ids


def test_packing(docs, empty):
    rows = packing.pack(docs, tokenizer()).collect()
    assert packing.pack(empty, tokenizer()).count() == 0
    encode = encoder(tokenizer())
    want = collections.Counter()
    for r in docs.collect():
        ids = encode(r.text or "") + b"\0\0\0\0"
        for k in range(0, len(ids), 8192):
            want[r.doc_id, k // 8192, k // 4, len(ids[k : k + 8192]) // 4, zlib.crc32(ids[k : k + 8192])] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_line_dedup(spark, docs, empty):
    got = collections.defaultdict(list)
    for r in line_dedup.dedup_lines(docs).collect():
        got[r.doc_id].append((r.text, r.n_lines, r.n_kept))
    assert line_dedup.dedup_lines(empty).count() == 0
    assert got[3] == [(None, 0, 0)] and got[2] == [("", 1, 1)] * 2 and got[None] == [("a b c d e f", 1, 1)] and got[0] == [("", 1, 0)] and got[1] == [("", 1, 0)]
    assert got[10] == [("q r s\nthe same longer line here\n", 5, 3)]


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_ngram_join(spark, docs, empty):
    rows = ngram_join.jaccard_components(docs).collect()
    assert len(rows) == docs.count() and ngram_join.jaccard_components(empty).count() == 0
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got[1] == (2, 0) and got[8] == (2, 0) and got[None] == (2, 0) and got[2] == (0, 2) and got[3] == (0, 3) and got[4] == (1, 4)
    assert got[6][1] == 5 and got[7][1] == 5 and got[5][0] == 2996


def test_ngram_join_random(spark):
    rng = np.random.default_rng(3)
    base = [list(rng.integers(0, 50, 60)) for _ in range(5)]
    texts = []
    for k in range(150):
        t = list(base[k % 5])
        for at in rng.integers(0, 60, rng.integers(0, 4)):
            t[at] = 100 + k
        texts.append(" ".join(map(str, t)))
    rows = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets, top = [sets_of(t) for t in texts], list(range(150))
    for _ in range(150):
        before = list(top)
        for a in range(150):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    top[a] = top[b] = min(top[a], top[b])
        if before == top:
            break
    assert rows == dict(enumerate(top))


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


@given(st.text(alphabet="ab@@..1239+-( )%0", max_size=40) | st.from_regex(PATTERNS["phone"]) | st.from_regex(PATTERNS["card"]))
@settings(max_examples=300, deadline=None)
def test_base_spans(text):
    want = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            want += [(kind, *m.span())] if ok else []
    base, every = pii.all_spans(text, pii.trained())
    assert base == want and set(base) <= set(every)


def test_personal_data(docs, empty):
    got = {r.doc_id: r for r in pii.find_personal_data(docs).collect()}
    assert got[9].spans == "email:5:20,phone:24:41" and got[9].n_email == 1 and got[9].n_phone == 1 and got[3].spans == ""
    assert got[9].base_sha256 == hashlib.sha256(got[9].spans.encode()).hexdigest() and pii.find_personal_data(empty).count() == 0
    model = pii.trained()
    assert pii.all_spans("call (555) 123-4567 now", model)[1] == [("phone", 5, 19)]
    assert pii.all_spans("in 1984 it was 12,345 at 12:30 of 2024-01-02", model)[1] == []


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(5)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 300, 40)) + (" vile." if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    w = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = toxicity.score(df.select("doc_id", "text"), w).join(df, "doc_id").where("held_out")
    assert got.where("predicted = toxic").count() / got.count() > 0.97
    assert toxicity.score(docs, w).count() == docs.count() and toxicity.score(empty, w).count() == 0
    assert toxicity.clean(df, w).where("doc_id % 4 = 0").count() < 20 and toxicity.clean(docs, w).columns == docs.columns
    none = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not none.any()


def test_embedding_dedup(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 8))
    rows = [(k, (base[k % 6] + rng.normal(size=8) * 0.25).tolist()) for k in range(200)]
    rows += [(300 + k, rows[0][1]) for k in range(50)] + [(500, None), (501, [0.0] * 8), (502, [float("inf")] * 8), (503, [1.0]), (None, rows[1][1]), (504, [x * 3 for x in rows[2][1]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df).collect()}
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 8 and np.isfinite(v).all() and any(v)]
    x = np.array([v for _, v in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T) >= 0.95
    np.fill_diagonal(link, False)
    top = np.array([i for i, _ in good])
    for _ in range(len(good)):
        new = np.array([min(top[k], top[link[k]].min(initial=top[k])) for k in range(len(good))])
        if (new == top).all():
            break
        top = new
    for k, (i, _) in enumerate(good):
        assert got[i] == (link[k].sum(), top[k], top[k] == i)
    assert got[500] == (0, 500, True) and got[501][0] == got[503][0] == 0
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0
