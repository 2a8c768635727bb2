"""Search against the standard library's full-text engine and on its own grammar."""

from __future__ import annotations

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from codequarry.functions import text as fn
from codequarry.operators import search


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    vocab = ["alpha", "beta", "gamma", "delta", "run_fast", "getUser", "alphabet", "x1", "of", "the"]
    return [(i, " ".join(rng.choices(vocab, k=rng.randrange(1, 4))), " ".join(rng.choices(vocab, k=rng.randrange(30)))) for i in range(1, 200)]


@pytest.fixture(scope="module")
def fts(corpus):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(title, body)")
    db.executemany("INSERT INTO t(rowid, title, body) VALUES (?, ?, ?)", corpus)
    return db


@pytest.mark.parametrize("query", ["alpha", "alpha beta", '"run_fast"', '"of the"', "alph*", "alpha OR x1", "alpha NOT beta", "title:alpha", "(alpha OR beta) AND gamma", "^alpha", "of + the"])
def test_bm25_equals_fts5(spark, corpus, fts, query):
    want = {i: r for i, r in fts.execute("SELECT rowid, bm25(t, 5.0, 1.0) FROM t WHERE t MATCH ?", (query,))}
    df = spark.createDataFrame(corpus, "id long, title string, body string")
    columns = {"title": 5.0, "body": 1.0}
    got = search.bm25(search.postings(df, list(columns)), search.lengths(df, list(columns)), search.parse_query(query, list(columns)), columns)
    got = {r.id: r["rank"] for r in got.collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


@pytest.mark.parametrize("query", ["db.Open(path)", "retry-logic", 'what calls "Stop"?', "foo AND", "(a OR b) c", "it's", "a:b", "", '"open', "("])
def test_invalid_queries_are_sanitised(query):
    with pytest.raises(search.QuerySyntaxError):
        search.parse_query(query, ["name"])
    search.understood(query, ["name"])


@pytest.mark.parametrize("query", ["foo NEAR bar", "foo*", "^foo", "x+y", "name:foo"])
def test_valid_queries(query):
    assert search.parse_query(query, ["name"])


def test_expansion():
    assert search.expanded("plain words") is None
    q = search.expanded("fetchUserProfile")
    assert {p.words[0] for p in search.phrases(q)} == {"fetchuserprofile", "fetch", "user", "profile"}


@pytest.mark.parametrize(("name", "words"), [("getUserByID", ["get", "user", "by", "id"]), ("snake_case_name", ["snake", "case", "name"]), ("HTTPServer", ["http", "server"]), ("parseHTML5Doc", ["parse", "html5", "doc"]), ("ID", ["id"]), ("aB", [])])
def test_query_words(name, words):
    assert fn.query_words(name) == words


IDENTIFIERS = {
    "ResolverCache": "Resolver Cache", "HTTPServer": "HTTP Server", "snake_case_name": "snake case name", "v2Handler": "v 2 Handler", "v2x": "v 2x", "plain": None, "": None,
    "_lead": None, "parseHTML": "parse HTML", "kebab-case": "kebab case", "a.b": "a b", "ID": None, "getX": "get X",
}


def test_split_identifier(spark):
    df = spark.createDataFrame([(n,) for n in IDENTIFIERS], "n string")
    assert {r.n: r.s for r in df.select("n", fn.split_identifier(F.col("n")).alias("s")).collect()} == IDENTIFIERS


def test_snippet():
    text = " ".join(f"w{i}" for i in range(100))
    s = search.snippet(text, ["w50"])
    assert "»w50«" in s and s.startswith("...") and len(s) <= 161
    assert search.snippet(None, ["x"]) is None and search.snippet("--", ["x"]) == "--"


def test_scalars(spark):
    cases = [("Where is Foo defined?", "definition"), ("callers of X", "impact"), ("what breaks if I drop it", "impact"), ("add a flag", "edit_target"), ("resolver", "search")]
    df = spark.createDataFrame(cases, "q string, want string")
    assert all(r.want == r.got for r in df.select("want", fn.intent(F.col("q")).alias("got")).collect())
    kinds = [("type/class", "class", 0), ("type/constant", "type", 0), ("function", "function", 1), ("method", "method", 2), ("property", "property", 2)]
    df = spark.createDataFrame(kinds, "k string, l string, p int")
    assert all((r.l, r.p) == (r.gl, r.gp) for r in df.select("l", "p", fn.label(F.col("k")).alias("gl"), fn.priority(F.col("k")).alias("gp")).collect())
    paths = [("a_test.go", True), ("web/x.spec.tsx", True), ("test_a.py", True), ("x/test_b.rb", True), ("contest.py", False), ("a.go", False)]
    df = spark.createDataFrame(paths, "p string, want boolean")
    assert all(r.want == r.got for r in df.select("want", fn.is_test_file(F.col("p")).alias("got")).collect())
