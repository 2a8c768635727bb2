from __future__ import annotations

import random
from collections import defaultdict

import numpy as np

from codequarry.llm import ngram_join as nj


def grams(text):
    words = (text or "").split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    links, up = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                links[i] += 1
                links[j] += 1
                up[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    return {(r[0], links[i], min(least[find(i)])) for i, r in enumerate(rows)}


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(40):
        words = rng.choices(vocab, k=rng.choice([3, 30, 120, 400]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((n, " ".join(copy)))
            n += 1
    return rows


def result(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, set string")
    return {(r.doc_id, r.n_links, r.class_id) for r in nj.ngram_join(df).collect()}


def test_equals_brute_force(spark):
    rows = corpus()
    assert result(spark, rows) == brute(rows)


def test_large_group_of_near_copies_in_tiles(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"v{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(60):
        words = list(base)
        words[i * 2] = f"x{i}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(nj, "TILE", 16)
    monkeypatch.setattr(nj, "WIDE_TILE", 13)
    monkeypatch.setattr(nj, "SMALL", 8)
    want = brute(rows)
    assert result(spark, rows) == want
    # bytes make tiles too, and large buckets at the last level are compared in tiles
    monkeypatch.setattr(nj, "TILE", 1000)
    monkeypatch.setattr(nj, "TILE_BYTES", 20_000)
    monkeypatch.setattr(nj, "MAX_DEPTH", 2)
    assert result(spark, rows) == want


def test_edge_cases(spark):
    rows = [(0, None), (1, ""), (2, "  \n"), (3, "a b"), (4, "a b"), (5, "a b c"), (None, "a b c"), (7, "x " * 5000), (7, "x " * 5000)]
    got = result(spark, rows)
    assert got == {(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (5, 1, 5), (None, 1, 5), (7, 1, 7)}
    assert result(spark, []) == set()


def test_components(spark):
    edges = spark.createDataFrame([(9, 8), (8, 7), (7, 6), (6, 5), (1, 2), (3, 2), (30, 20)], "a long, b long")
    got = {r.node: r.root for r in nj.components(edges).collect()}
    assert got == {5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 1: 1, 2: 1, 3: 1, 20: 20, 30: 20}


def test_stars():
    near = np.array([[True, True, False], [False, False, True]])
    least, member = nj.stars(near, np.array([5, 6]), np.array([7, 4, 9]))
    assert sorted(zip(least.tolist(), member.tolist(), strict=True)) == [(4, 5), (4, 7), (6, 9)]


def planted(rng, base_words, edits, n):
    base = [f"b{rng.randrange(10**6)}" for _ in range(base_words)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(edits):
            words[rng.randrange(base_words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_recall_with_pivots_on_planted_groups(spark, monkeypatch):
    """Groups of near copies around the threshold, larger than a bucket may be: measured recall of sets against the exact join."""
    rng = random.Random(21)
    texts = [t for edits, n in ((1, 150), (2, 150), (3, 100), (4, 80)) for t in planted(rng, 150, edits, n)]
    rows = list(enumerate(texts))
    monkeypatch.setattr(nj, "SMALL", 10)
    monkeypatch.setattr(nj, "TILE", 64)
    want, got = brute(rows), result(spark, rows)
    found = len(want & got) / len(want)
    linked = {w for w in want if w[1]}
    assert len(linked) > 300 and found == 1.0, found


def test_a_recall_out_of_reach_is_said(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(nj, "MAX_ROUNDS", 2)
    monkeypatch.setattr(nj, "_round_recall", lambda one, other: 0.5)
    with pytest.warns(UserWarning, match="estimated recall 0.75"):
        result(spark, [(1, "a b c d e f"), (2, "a b c d e f")])


def test_sets_that_agree_in_one_hash_are_told_apart(spark):
    key = lambda i: (i, i)
    rows = [(key(1), 1, 77, 5, b"a"), (key(2), 2, 77, 6, b"b"), (key(3), 3, 77, 5, b"a"), (key(4), None, 9, 9, b"c")]
    df = spark.createDataFrame(rows, "row struct<id:long,hash:long>, doc_id long, set long, check long, sketch binary")
    got = {(r.set, r.check, r.copies, r.least.doc_id) for r in nj.distinct_sets(df).collect()}
    assert got == {(5, 5, 2, 1), (6, 6, 1, 2), (9, 9, 1, None)}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, "a b c d e f g", 1, "r", 2.0) for i in range(3)], "doc_id long, text string, row int, rep string, sketch double")
    assert {(r.doc_id, r.class_id, r.n_links) for r in nj.ngram_join(df).collect()} == {(i, 0, 2) for i in range(3)}
