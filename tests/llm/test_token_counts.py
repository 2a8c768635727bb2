from __future__ import annotations

import os

import pytest

from codequarry.llm import token_counts as tc

pytestmark = pytest.mark.skipif(not os.path.isdir(tc.TOKENIZER_DIR), reason="no vocabulary files")


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    return tiktoken.Encoding("t", pat_str=tc.BYTE_PATTERN, mergeable_ranks=tc.load_ranks(f"{tc.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"), special_tokens={})


def totals(rollup):
    return {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def count(encoding, rows):
    out = {}
    for _, text, source, lang in rows:
        n, t = out.get((source, lang), (0, 0))
        out[source, lang] = (n + 1, t + len(encoding.encode_ordinary(text or "")))
    return out


def test_deltas_equal_a_recount(spark, make_docs, tmp_path, encoding):
    a = [(1, "the quick brown fox", "s", "en"), (2, "über alles", "s", "de"), (3, None, None, None), (4, "gone soon", "t", "en"), (4, "gone soon", "t", "en")]
    rollup = tc.TokenRollup(spark, f"file://{tmp_path}/rollup")
    assert totals(rollup) == {}
    first = tc.count_tokens(make_docs(a))
    assert rollup.commit("b1", tc.inserts(first)) and not rollup.commit("b1", tc.inserts(first))
    assert totals(rollup) == count(encoding, a)
    old, new = [a[0]], [(1, "the quick brown fox jumps <|endoftext|>", "s", "en")]
    assert rollup.commit("b2", tc.revisions(tc.count_tokens(make_docs(old)), tc.count_tokens(make_docs(new))))
    assert rollup.commit("b3", tc.deletes(tc.count_tokens(make_docs(a[3:]))))
    assert totals(rollup) == count(encoding, [*new, *a[1:3]])
    assert rollup.commit("b4", tc.inserts(tc.count_tokens(make_docs([]))))
    # another handle on the same folder knows what is committed
    again = tc.TokenRollup(spark, f"file://{tmp_path}/rollup")
    assert not again.commit("b2", tc.deletes(first)) and totals(again) == totals(rollup)


def test_an_attempt_that_died_does_not_count(spark, make_docs, tmp_path, encoding):
    rollup = tc.TokenRollup(spark, f"file://{tmp_path}/rollup")
    rows = [(1, "a b c", "s", "en")]
    changes = tc.inserts(tc.count_tokens(make_docs(rows)))
    tc.delta(changes).write.parquet(f"file://{tmp_path}/rollup/deltas/b1-dead")
    (tmp_path / "rollup/temp/b1-dead").write_text("b1-dead")  # it died before its rename
    assert totals(rollup) == {} and rollup.commit("b1", changes) and totals(rollup) == count(encoding, rows)


def test_of_two_writers_of_a_batch_one_commits(spark, make_docs, tmp_path, encoding):
    rows = [(1, "a b c", "s", "en")]
    one, other = (tc.TokenRollup(spark, f"file://{tmp_path}/rollup") for _ in range(2))
    changes = tc.inserts(tc.count_tokens(make_docs(rows)))
    for attempt in ("b1-x", "b1-y"):
        tc.delta(changes).write.parquet(f"file://{tmp_path}/rollup/deltas/{attempt}")
    # both have found the batch open, then both rename
    assert [one._create("b1", "b1-x"), other._create("b1", "b1-y")] == [True, False]
    assert totals(one) == totals(other) == count(encoding, rows) and list((tmp_path / "rollup/temp").glob("b1*")) == []


def test_folding_keeps_totals_and_ids(spark, make_docs, tmp_path, encoding):
    rollup = tc.TokenRollup(spark, f"file://{tmp_path}/rollup", fold=3)
    rows = [(i, f"text {i}", f"s{i % 2}", "en") for i in range(7)]
    for r in rows:
        changes = tc.inserts(tc.count_tokens(make_docs([r])))
        assert rollup.commit(f"b{r[0]}", changes) and not rollup.commit(f"b{r[0]}", changes)
    last, batches = rollup._open()
    assert last == 2 and batches == ["b6"] and totals(rollup) == count(encoding, rows)


def test_long_white_space_has_the_same_tokens(encoding, monkeypatch):
    rng = __import__("random").Random(3)
    monkeypatch.setattr(tc, "LONG_RUN", 4)
    monkeypatch.setattr(tc, "_LONG_SPACE", __import__("re").compile(tc._LONG_SPACE.pattern.replace("{10000,}", "{4,}")))
    parts = [" " * 5, "\n" * 6, "\r\n\t \x0b", "\u3000\u2028", "\x1c\x1d", "a", "Zoë", "12", "don't", "--", " ", "\n"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 9)))
        assert tc.token_count(encoding, text) == len(encoding.encode_ordinary(text)), text


def test_millions_of_line_ends_and_extra_columns(spark, make_docs):
    texts = ["\n" * 1_000_000, "x" + " " * 2_000_000 + "y", "word " * 300_000]
    docs = make_docs([(i, t, "s", "en", 1, "c") for i, t in enumerate(texts)], ", n_tokens int, tokenizer string")
    got = {r.doc_id: r.n_tokens for r in tc.count_tokens(docs).collect()}
    assert got == {0: 500_000, 1: 2_000_001, 2: 300_001}


def test_new_tokenizer_version_is_a_revision(spark, make_docs, tmp_path):
    rows = make_docs([(1, "naïve café", "s", "fr")])
    rollup = tc.TokenRollup(spark, f"file://{tmp_path}/rollup")
    old, new = tc.count_tokens(rows), tc.count_tokens(rows, "byte_bpe_multi_50k")
    rollup.commit("old", tc.inserts(old))
    rollup.commit("new", tc.revisions(old, new))
    assert [(r.tokenizer, r.n_docs) for r in rollup.totals().collect()] == [("byte_bpe_multi_50k", 1)]


def test_batch_ids(spark, make_docs, tmp_path):
    rollup = tc.TokenRollup(spark, f"file://{tmp_path}/rollup")
    for bad in ("", "a/b", "_x", ".x", "a b"):
        with pytest.raises(ValueError):
            rollup.commit(bad, tc.inserts(tc.count_tokens(make_docs([]))))


def test_query(spark, make_docs, tmp_path, encoding):
    rows = [(i, f"text number {i} " * (i % 9), f"s{i % 3}", "en") for i in range(50)]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in tc.op1_token_counts(spark, str(tmp_path)).collect()}
    assert got == count(encoding, rows)
