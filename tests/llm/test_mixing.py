from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from codequarry.llm import mixing as mx


def corpus(seed, n=3000):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "B", "é", "c", None])
        out.append((i, " ".join(["w"] * rng.choice([0, 1, 20, 20, 300])), source, "en"))
    return out


def mixed(docs):
    return mx.mix(docs).collect()


def test_targets():
    t = mx.source_targets({"b": 100, "a": 100, None: 100})
    assert t == pytest.approx({"a": 200, "b": 83.333333, None: 166.666667})
    assert mx.source_targets({"a": 10, "b": 1000}) == pytest.approx({"a": 20, "b": 1495})
    assert mx.source_targets({}) == {} and mx.source_targets({"a": 0}) == {"a": 0}


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    p, size = rng.random(500), rng.integers(1, 1000, 500).astype(float)
    for copies in (np.ones(500), 2.0 ** rng.integers(0, 12, 500)):
        out = mx.flight(p, copies, size, np.random.default_rng(1))
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert out @ copies == pytest.approx(p @ copies) and out @ (copies * size) == pytest.approx(p @ (copies * size))


def test_flight_is_unbiased():
    p, size = np.array([0.2, 0.5, 0.7, 0.6]), np.array([3.0, 1.0, 4.0, 2.0])
    mean = np.mean([mx.flight(p, np.ones(4), size, np.random.default_rng(k)) for k in range(6000)], axis=0)
    assert mean == pytest.approx(p, abs=0.02)


@pytest.mark.parametrize("block", [10**6, 100])
def test_mix_meets_targets(make_docs, monkeypatch, block):
    monkeypatch.setattr(mx, "BLOCK_ROWS", block)
    monkeypatch.setattr(mx, "FAN_IN", 3)
    rows = corpus(5)
    got = mixed(make_docs(rows))
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, *_ in rows}
    by = defaultdict(int)
    for i, _, s, _ in rows:
        by[s] += size[i]
    target, taken = mx.source_targets(dict(by)), defaultdict(int)
    docs_taken, n_docs = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == by[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        if r.size:
            n_docs[r.source] += 1
            docs_taken[r.source] += r.copies
    for s in by:
        assert abs(taken[s] - target[s]) <= 300
        assert abs(docs_taken[s] - n_docs[s] * target[s] / by[s]) <= 3
    assert sorted((r.doc_id, r.taken) for r in mixed(make_docs(rows).repartition(7))) == sorted((r.doc_id, r.taken) for r in got)


def test_repeated_rows_keep_words_and_documents(make_docs):
    """Repeated rows are documents of their own: totals of words and documents hold to within one document."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        rows += [(i, " ".join(["w"] * rng.choice([5, 30, 200])), rng.choice("ab"), "en")] * rng.choice([1, 1, 7, 120, 333])
    got = mixed(make_docs(rows))
    assert len(got) == len(rows)
    for s in "ab":
        own = [r for r in got if r.source == s]
        want = sum(r.size for r in own) and own[0].target
        assert abs(sum(r.taken for r in own) - want) <= 100
        # the landing puts words first: a document of 200 words weighs as much as 40 of 5
        assert abs(sum(r.copies for r in own) - len(own) * want / own[0].source_size) <= 40
        assert all(r.taken in (0, r.size, 2 * r.size) for r in own)
    again = mixed(make_docs(rows).repartition(5))
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    out = defaultdict(int)
    for r in mx.mixed_documents(make_docs([(*r, 0, 1) for r in rows], ", copies int, size int")).collect():
        out[r.doc_id] += 1
    want = defaultdict(int)
    for r in got:
        want[r.doc_id] += r.copies
    assert out == {k: v for k, v in want.items() if v}


def test_landing_takes_what_comes_nearest():
    rng = random.Random(1)
    for _ in range(200):
        n = [rng.choice([1, 1, 2, 8]) for _ in range(2)]
        size = np.array([rng.randrange(1, 50) for _ in range(2)], dtype=float)
        p = np.array([rng.random() for _ in range(2)])
        goal = float(p @ (size * n))
        got = mx.landing(p, np.array(n), size, goal)
        assert all(0 <= m <= k for m, k in zip(got, n, strict=True))
        # never worse than rounding each unit as a whole
        assert abs(got @ size - goal) <= min(abs(a * n[0] * size[0] + b * n[1] * size[1] - goal) for a in (0, 1) for b in (0, 1)) + 1e-9


def test_mixed_documents_repeat(make_docs):
    rows = corpus(7, 300)
    taken = {r.doc_id: r.copies for r in mixed(make_docs(rows))}
    out = defaultdict(int)
    df = mx.mixed_documents(make_docs(rows))
    assert df.columns == ["doc_id", "text", "source", "lang"]
    for r in df.collect():
        out[r.doc_id] += 1
    assert out == {k: v for k, v in taken.items() if v}


def test_edge_cases(make_docs):
    rows = [(0, None, None, None), (1, "", "a", "en"), (2, "x y", "a", "en"), (2, "x y", "a", "en"), (None, "z " * 100_000, "b", "en")]
    got = mixed(make_docs(rows))
    assert len(got) == 5 and {r.taken for r in got if r.doc_id in (0, 1)} == {0}
    assert mixed(make_docs([])) == [] and mx.mixed_documents(make_docs([])).collect() == []
