from __future__ import annotations

import random

import numpy as np

from codequarry.llm import decontamination as dc


def brute_align(a, b):
    """Smith-Waterman by the plain recurrence."""
    h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = dc.MATCH if a[i - 1] == b[j - 1] else dc.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + dc.GAP, h[i, j - 1] + dc.GAP)
    return h.max()


def test_alignment_equals_recurrence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 20)), rng.integers(0, 5, rng.integers(1, 30))
        score, lo, hi = dc.smith_waterman(a, b)
        assert score == brute_align(a, b)
        if score:
            assert 0 <= lo <= hi < len(b) and brute_align(a, b[lo : hi + 1]) == score
    assert dc.smith_waterman(np.array([1]), np.empty(0, dtype=int)) == (0, 0, -1)


def setup(make_docs, spark, seed=2):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    items = [" ".join(rng.choices(vocab, k=rng.choice([15, 35, 60]))) for _ in range(20)]
    words = lambda n: " ".join(rng.choices(vocab, k=n))

    def edited(text, share):
        w = text.split()
        for k in rng.sample(range(len(w)), int(share * len(w))):
            w[k] = rng.choice(vocab)
        del w[len(w) // 2]
        w.insert(3, "inserted")
        return " ".join(w)

    rows, want = [], set()
    for i in range(120):
        k = i % 20
        if i < 20:
            text = f"{words(80)} {items[k].upper()}. {words(80)}"
        elif i < 40:
            text = f"{words(50)}\n{edited(items[k], 0.15)}\n{words(10)}"
        else:
            text = words(200)
        if i < 40:
            want.add((i, k))
        rows.append((i, text, "s", "en"))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return rows, benchmark, want


def test_exact_and_edited_copies_are_found(spark, make_docs):
    rows, benchmark, want = setup(make_docs, spark)
    got = dc.match_benchmark(make_docs(rows), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.score == 1.0 for r in got if r.doc_id < 20) and all(0.5 <= r.score < 1 for r in got if r.doc_id >= 20)
    r = next(r for r in got if r.doc_id == 0)
    assert (r.first_word, r.last_word - r.first_word + 1) == (80, len(benchmark.where("item_id = 0").first().text.split()))
    kept = {r.doc_id for r in dc.clean_documents(make_docs(rows), benchmark).collect()}
    assert kept == set(range(40, 120))


def test_copies_at_the_first_word_without_their_head_are_found(spark, make_docs):
    rng = random.Random(7)
    words = lambda c, n: [f"{c}{rng.randrange(9999)}" for _ in range(n)]
    item = words("i", 30)
    edited = [*item[:1], *item[2:9], *item[10:]]
    heads = [item[k:] for k in (1, 2, 10, 14)] + [edited]
    rows = [(i, " ".join(h + words("d", 80)), "s", "en") for i, h in enumerate(heads)] + [(9, " ".join(words("d", 80)), "s", "en")]
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r for r in dc.match_benchmark(make_docs(rows), benchmark).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and all(r.first_word == 0 for r in got.values())
    assert [got[i].score for i in range(4)] == [(30 - k) / 30 for k in (1, 2, 10, 14)]
    assert [got[i].last_word for i in range(4)] == [29 - k for k in (1, 2, 10, 14)]
    assert [r.doc_id for r in dc.clean_documents(make_docs(rows), benchmark).collect()] == [9]


def test_an_item_that_many_documents_hold_keeps_its_seeds(spark, make_docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    rows = [(i, f"x{i} {item} y{i}", "s", "en") for i in range(200)]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert dc.match_benchmark(make_docs(rows), benchmark).count() == 200


def test_edge_cases(spark, make_docs):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (4, "one"), (5, "a b c d e f g h"), (6, "a b c d e f g h")], "item_id long, text string")
    rows = [(0, None, None, None), (1, "", "s", "en"), (None, "x A, b c d e f g h", "s", "en"), (3, "has two words", "s", "en"), (4, "word " * 100_000 + "a b c d e f g h", "s", "en"), (4, "", "s", "en")]
    got = {(r.doc_id, r.item_id, r.score) for r in dc.match_benchmark(make_docs(rows), benchmark).collect()}
    assert got == {(None, 5, 1.0), (None, 6, 1.0), (4, 5, 1.0), (4, 6, 1.0)}
    none = benchmark.limit(0)
    assert dc.match_benchmark(make_docs(rows), none).collect() == [] and dc.match_benchmark(make_docs([]), benchmark).collect() == []


def test_short_items_match_whole_texts_only(spark, make_docs):
    benchmark = spark.createDataFrame([(1, "yes"), (2, "two Words"), (3, "a b c d"), (4, "!?"), (5, "k l m n o")], "item_id long, text string")
    texts = ["yes", "Yes!", "yes it is", "two words", "x two words", "a b c d", "a b c d x y z", "say k l m n o now", ""]
    got = {(r.doc_id, r.item_id, r.score) for r in dc.match_benchmark(make_docs([(i, t, "s", "en") for i, t in enumerate(texts)]), benchmark).collect()}
    assert got == {(0, 1, 1.0), (1, 1, 1.0), (3, 2, 1.0), (5, 3, 1.0), (7, 5, 1.0)}


def test_blocks_of_items_give_the_same_rows(spark, make_docs, monkeypatch):
    rows, benchmark, want = setup(make_docs, spark, 4)
    docs = make_docs(rows)
    whole = sorted(map(tuple, dc.match_benchmark(docs, benchmark).drop("key").collect()))
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 6)
    assert sorted(map(tuple, dc.match_benchmark(docs, benchmark.unionByName(benchmark)).drop("key").collect())) == whole
    monkeypatch.setattr(dc, "BLOCK_ITEMS", 10**6)
    monkeypatch.setattr(dc, "BLOCK_BYTES", 2000)
    assert sorted(map(tuple, dc.match_benchmark(docs, benchmark).drop("key").collect())) == whole
    assert {(r[0], r[1]) for r in whole} == want


def test_search_equals_aligning_every_item_with_every_text(spark, make_docs):
    """Without seeds: each item aligned with the whole of each text."""
    rows, benchmark, _ = setup(make_docs, spark, 9)
    rows = rows[::4]
    items = [(r.item_id, r.text.lower().split()) for r in benchmark.collect()]
    number: dict[str, int] = {}
    code = lambda ws: np.array([number.setdefault(w, len(number) + 1) for w in ws])
    want = set()
    for doc_id, text, *_ in rows:
        words = text.lower().replace(".", " ").split()
        for item_id, item in items:
            score = dc.smith_waterman(code(item), code(words))[0] / (dc.MATCH * len(item))
            if score >= dc.THRESHOLD:
                want.add((doc_id, item_id, round(score, 9)))
    got = {(r.doc_id, r.item_id, round(r.score, 9)) for r in dc.match_benchmark(make_docs([(*r, "c", 1) for r in rows], ", item_id string, score int"), benchmark).collect()}
    assert got == want and len(want) >= 8
