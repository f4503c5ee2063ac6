"""Operators that SQL cannot express against plain versions that try everything, and long texts."""

import itertools
import random
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from booktide.llm import embedding_dedup, line_dedup, ngram_join, packing, pii, toxicity


def fewest(items, capacity):
    """The least number of sequences, by trying all places of each piece."""
    items, best = sorted(items, reverse=True), [len(items)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for r in {room: i for i, room in enumerate(rooms) if room >= items[k]}.values():
            place(k + 1, [*rooms[:r], rooms[r] - items[k], *rooms[r + 1 :]])
        place(k + 1, [*rooms, capacity - items[k]])

    place(0, [])
    return best[0]


@given(st.lists(st.integers(1, 20), max_size=9))
@settings(max_examples=300, deadline=None)
def test_dominance_reduction_loses_nothing(items):
    left = Counter(items)
    fixed = packing.reduce(left, 20)
    rest = list(left.elements())
    assert sum(n for n, _ in fixed) + fewest(rest, 20) == fewest(items, 20)
    assert sum(n for n, _ in packing.plan_of(Counter(items), 20)) <= fewest(items, 20) + 1


def test_ftrl_against_a_plain_loop():
    rng, rows = np.random.default_rng(4), []
    for _ in range(120):
        at = np.unique(rng.integers(0, 40, 6)).astype(np.int32)
        rows.append((at, int(3 in at or rng.random() < 0.1)))
    z, n = {}, {}
    alpha, beta, l1, l2, bias = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2, toxicity.BUCKETS

    def weight(i):
        strength = 0.0 if i == bias else l1
        if abs(z.get(i, 0.0)) <= strength:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * strength) / ((beta + n.get(i, 0.0) ** 0.5) / alpha + l2)

    for _ in range(toxicity.EPOCHS):
        for at, label in rows:
            w = {i: weight(i) for i in [*at.tolist(), bias]}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            for i in w:
                step = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
                z[i], n[i] = z.get(i, 0.0) + g - step * w[i], n.get(i, 0.0) + g * g
    got = toxicity.fit(rows)
    assert np.allclose([got[i] for i in [*range(40), bias]], [weight(i) for i in [*range(40), bias]], atol=1e-9) and got[3] > 0


def test_segmentation_against_all_segmentations():
    model, draw = pii.trained(), random.Random(3)
    pieces = ["call", "(555)", "123-4567", "4111", "1111", "1111", "1111", "bob@x", "12", "10.0.0.1", "2024-01-02"]
    for _ in range(60):
        text = " ".join(draw.choice(pieces) for _ in range(6))
        for tokens in pii.clusters(text, []):
            score = model.scores(text, tokens)
            options = [(0.0, ())]
            for cuts in itertools.product([0, 1], repeat=len(tokens) - 1):
                edges = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(tokens)]
                total, spans = 0.0, []
                for i, j in itertools.pairwise(edges):
                    kind, s = max(((k, v) for k, v, _ in score[i, j - 1]), key=lambda x: x[1]) if j - i <= pii.MOST_TOKENS else (None, -1e9)
                    if s > pii.MARGIN:
                        total += s - pii.MARGIN
                        spans.append((kind, i, j))
                options.append((total, tuple(spans)))
            got = model.best(text, tokens)
            told = sum(max(v for _, v, _ in score[i, j]) - pii.MARGIN for i, j in _places(text, tokens, got))
            assert abs(told - max(o[0] for o in options)) < 1e-9


def _places(text, tokens, spans):
    for _, s, e in spans:
        inside = [k for k, (a, b) in enumerate(tokens) if a < e and b > s]
        yield inside[0], inside[-1]


@pytest.mark.parametrize("text", ["1 " + "中" * 1_000_000, "a" * 1_000_000, "x" * 500_000 + "1" + "y" * 500_000, ")" * 500_000 + "1" + ")" * 500_000, "a@" * 300_000, "(at)" * 200_000])
def test_personal_data_of_a_million_characters(text):
    model, start = pii.trained(), time.time()
    pii.all_spans(text, model)
    assert time.time() - start < 20


def test_seeds():
    assert [("a b1 c d@e"[s:e]) for s, e in pii.seeds("a b1 c d@e")] == ["b1", "d@e"]
    t = "mail bob.9 (at) host (dot) com 7"
    assert [t[s:e] for s, e in pii.seeds(t)] == ["bob.9 (at) host (dot) com", "7"]


def test_cover_trees_against_all_pairs():
    rng = np.random.default_rng(7)
    for n, spread in ((700, 0.05), (300, 0.3), (900, 0.01)):
        x = embedding_dedup.unit(rng.normal(size=(7, 16))[rng.integers(0, 7, n)] + spread * rng.normal(size=(n, 16)))
        ids, counts = rng.permutation(n) * 3, rng.integers(1, 4, n).astype(float)
        link = x @ x.T >= 0.95
        np.fill_diagonal(link, False)
        for parts in ((np.arange(n), None), (np.arange(0, n, 2), np.arange(1, n, 2))):
            own = link if parts[1] is None else link & (np.add.outer(np.arange(n), np.arange(n)) % 2 == 1)
            sides = [(ids[p], counts[p], x[p]) if p is not None else None for p in parts]
            got = {i: (c, up) for i, c, up in embedding_dedup._settled(sides[0], sides[1], 0.95)}
            want = {int(ids[k]): int((own[k] * counts).sum()) for k in range(n) if own[k].any()}
            assert {i: c for i, (c, _) in got.items()} == want
            top = ids.copy()
            while True:
                new = np.array([min(top[k], top[own[k]].min(initial=top[k])) for k in range(n)])
                if (new == top).all():
                    break
                top = new
            assert all(got[int(ids[k])][1] == top[k] for k in range(n) if own[k].any())


def test_near_copies_in_one_cluster_are_not_enumerated():
    rng = np.random.default_rng(1)
    x = embedding_dedup.unit(rng.normal(size=64) + 0.01 * rng.normal(size=(4000, 64)))
    got = embedding_dedup._settled((np.arange(4000), np.ones(4000), x), None, 0.95)
    assert len(got) == 4000 and all(r[1] == 3999 and r[2] == 0 for r in got)


def sets_of(words):
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


@given(st.integers(1, 60), st.data())
@settings(max_examples=200, deadline=None)
def test_linked_sets_share_a_tile_whatever_is_left_out(n, data):
    rng = np.random.default_rng(data.draw(st.integers(0, 10**6)))
    n *= rng.integers(1, 20)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    apart = rng.integers(0, max(1, n // 4))
    b = np.concatenate((a[rng.integers(0, apart + 1) :], rng.integers(0, 1 << 63, rng.integers(0, apart + 1), dtype=np.uint64)))
    a, b = np.unique(a), np.unique(b)
    if len(b) and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
        keys = [{k for _, _, own in ngram_join.tile_keys(x) for k in own.tolist()} for x in (a, b)]
        assert keys[0] & keys[1]
        hot = set(rng.permutation(sorted(keys[0] & keys[1]))[: rng.integers(0, 3)].tolist())
        enough = [any(len([k for k in own.tolist() if k not in hot]) >= give and parts - len([k for k in own.tolist() if k in hot]) >= give for give, parts, own in ngram_join.tile_keys(x)) for x in (a, b)]
        assert (keys[0] & keys[1]) - hot or not any(enough)


def test_crowded_tiles_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    rng, texts = np.random.default_rng(3), []
    base = [list(rng.integers(0, 500, 80)) for _ in range(3)]
    for k in range(90):
        t = list(base[k % 3])
        for at in rng.integers(0, 80, rng.integers(0, 6)):
            t[at] = 1000 + k
        texts.append(" ".join(map(str, t)))
    rows = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets, top = [sets_of(t.split()) for t in texts], list(range(90))
    link = [[100 * len(a & b) >= 80 * len(a | b) for b in sets] for a in sets]
    for _ in range(90):
        new = [min([top[k], *(top[j] for j in range(90) if link[k][j])]) for k in range(90)]
        if new == top:
            break
        top = new
    assert rows == dict(enumerate(top)) and 3 < len(set(top)) < 80


def test_line_recall_by_class(spark):
    r, lines, pairs = random.Random(11), [], {}
    word = lambda a, b: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(a, b)))
    make = {"short": lambda: " ".join(word(1, 4) for _ in range(14)), "middle": lambda: " ".join(word(6, 12) for _ in range(8)), "long": lambda: " ".join(word(11, 15) for _ in range(30)), "unspaced": lambda: word(70, 90), "boilerplate": lambda: "all rights reserved by the owners of this site and of its parts; " * 2 + " ".join(word(3, 8) for _ in range(12))}
    shingles = lambda x: {f" {x}"[i : i + 8] for i in range(max(1, len(x) - 6))}
    for name, f in make.items():
        pairs[name] = []
        while len(pairs[name]) < 60:
            a, b = f(), None
            b = list(a)
            for _ in range(r.randint(1, 3)):
                b[r.randrange(len(b) // 2, len(b))] = "#"
            b = "".join(b)
            p, q = shingles(a), shingles(b)
            if 0.8 <= len(p & q) / len(p | q) < 0.97:
                pairs[name].append((len(lines), len(lines) + 1))
                lines += [a, b]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    kept = {x.doc_id: x.n_kept for x in line_dedup.dedup_lines(docs).collect()}
    for name, own in pairs.items():
        assert sum(kept[b] == 0 for _, b in own) >= 0.95 * len(own), name
        assert all(kept[a] == 1 for a, _ in own) or name == "boilerplate"
