"""Full-text search: postings, phrases and prefixes, column-weighted BM25, snippets, suggestions.

A corpus is a table with an ``id``.  Its postings are (id, col, pos, term).  A query is a small tree of phrases held on
the driver.  One filter takes the postings of all its words at once; each posting votes for the starts of the phrases that it
can stand in, and scores and matches both come from the places that all words of a phrase vote for.  The store keeps postings
and lengths as tables, sorted by term, so the filter reaches the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.functions.text import alphanumeric, query_words, tokens

K1, B = 1.2, 0.75
MIN_IDF = 1e-6

# Column weights of the three corpora.
FUNCTION_COLUMNS = {"name": 10.0, "name_parts": 8.0, "file_path": 1.5, "code": 1.0, "docstring": 2.0}
TYPE_COLUMNS = {"name": 10.0, "name_parts": 8.0, "file_path": 1.5, "definition": 1.0}
DOCUMENT_COLUMNS = {"title": 5.0, "file_path": 1.5, "content": 1.0}


def postings(corpus: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    """(id, col, pos, term), one row per token."""
    parts = [
        corpus.select(F.col(id_col).alias("id"), F.lit(c).alias("col"), F.posexplode(tokens(F.col(c))).alias("pos", "term")) for c in columns
    ]
    return reduce(DataFrame.unionByName, parts)


def vocabulary(post: DataFrame) -> DataFrame:
    """term, occurrences, documents; a term's rows are counted by document first, so a frequent one arrives as partial counts."""
    per_doc = post.groupBy("term", "id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents"))


def is_exact(name: Column, query: str) -> Column:
    """Whether a name is one of the query's terms, or all of them written together, letter case aside."""
    terms = [t.lower() for t in re.findall(r"[A-Za-z0-9]+", query)]
    if not terms:
        return F.lit(False)
    joined = F.lower(alphanumeric(name)) == "".join(terms)
    return F.coalesce(F.lower(name).isin(terms) | (joined if len(terms) > 1 else F.lit(False)), F.lit(False))


def lengths(corpus: DataFrame, columns: list[str], id_col: str = "id") -> DataFrame:
    """(id, d): tokens of each row over all columns."""
    total = sum((F.coalesce(F.size(tokens(F.col(c))), F.lit(0)) for c in columns), F.lit(0))
    return corpus.select(F.col(id_col).alias("id"), total.cast("long").alias("d"))


CORPORA = {"functions": FUNCTION_COLUMNS, "types": TYPE_COLUMNS, "documents": DOCUMENT_COLUMNS}


def stored(tables: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
    """The tables ``postings`` and ``lengths`` of all corpora, each row with its file."""

    def each(make: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
        parts = []
        for corpus, weights in CORPORA.items():
            rows = tables(corpus)
            # the file rides along under another name, as it is a searched column too
            keyed = rows.withColumn("_key", F.struct("id", F.col("file_path").alias("file")))
            made = make(keyed, list(weights)).withColumn("file_path", F.col("id.file")).withColumn("id", F.col("id.id"))
            parts.append(made.withColumn("corpus", F.lit(corpus)))
        return reduce(DataFrame.unionByName, parts)

    return {"postings": each(lambda rows, columns: postings(rows, columns, "_key")), "lengths": each(lambda rows, columns: lengths(rows, columns, "_key"))}


# ---------------------------------------------------------------------------------------------------- query trees


class QuerySyntaxError(ValueError):
    """The raw query is no valid expression."""


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    column: str | None = None
    initial: bool = False


@dataclass(frozen=True)
class Op:
    kind: str  # and, or, not
    parts: tuple


Query = Phrase | Op
_LEX = re.compile(r'\s*(?:("(?:[^"]|"")*")|([()+*^:{}-])|([^\s"()+*^:{}.,;!?\'/\\<>=@#$%&|~`\[\]-]+))')


def parse_query(text: str, columns: list[str] | None = None) -> Query:
    """Recursive descent over: OR < AND < NOT < implicit AND; quotes, prefix ``*``, ``^`` initial, ``col:``, ``+`` joins phrases."""
    lexed, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise QuerySyntaxError(f"unexpected {text[at:].strip()[:1]!r}")
        lexed.append(("str", m[1][1:-1].replace('""', '"')) if m[1] is not None else ("op", m[2]) if m[2] else ("word", m[3]))
        at = m.end()
    k = 0

    def peek(kind: str, value: str | None = None) -> bool:
        return k < len(lexed) and lexed[k][0] == kind and (value is None or lexed[k][1] == value)

    def take() -> str:
        nonlocal k
        if k >= len(lexed):
            raise QuerySyntaxError("unexpected end")
        k += 1
        return lexed[k - 1][1]

    def phrase(column: str | None) -> Query:
        initial = peek("op", "^") and bool(take())
        words: list[str] = []
        while True:
            if not (peek("str") or peek("word")):
                raise QuerySyntaxError("a term is missing")
            words += _words(take())
            if not peek("op", "+"):
                break
            take()
        prefix = peek("op", "*") and bool(take())
        return Phrase(tuple(words), prefix, column, initial)

    def atom() -> Query:
        if peek("op", "("):
            take()
            inner = level(0)
            if not peek("op", ")"):
                raise QuerySyntaxError("a parenthesis is open")
            take()
            return inner
        column = None
        if peek("word") and k + 1 < len(lexed) and lexed[k + 1] == ("op", ":"):
            column = take()
            take()
            if columns is not None and column not in columns:
                raise QuerySyntaxError(f"no such column: {column}")
            if peek("op", "("):
                raise QuerySyntaxError("a column filter takes one phrase")
        return phrase(column)

    def implicit() -> Query:
        # phrases side by side are joined by AND; a group in parentheses needs its operators written
        group = peek("op", "(")
        parts = [atom()]
        while not group and k < len(lexed) and not peek("op", ")") and not (lexed[k][0] == "word" and lexed[k][1] in ("AND", "OR", "NOT")):
            if peek("op", "("):
                raise QuerySyntaxError("an operator is missing")
            parts.append(atom())
        return parts[0] if len(parts) == 1 else Op("and", tuple(parts))

    def level(n: int) -> Query:
        word = ("OR", "AND", "NOT")[n]
        below = (lambda: level(n + 1)) if n < 2 else implicit
        parts = [below()]
        while peek("word", word):
            take()
            parts.append(below())
        return parts[0] if len(parts) == 1 else Op(word.lower(), tuple(parts))

    if not lexed:
        raise QuerySyntaxError("empty query")
    tree = level(0)
    if k < len(lexed):
        raise QuerySyntaxError(f"unexpected {lexed[k][1]!r}")
    return tree


def _words(text: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[^\W_]+", text)]


def sanitised(text: str) -> Query | None:
    """Every token of the text as a prefix, all required; None if there is none."""
    parts = tuple(Phrase(tuple(_words(t)), prefix=True) for t in re.findall(r"[A-Za-z0-9_]+", text) if _words(t))
    return None if not parts else parts[0] if len(parts) == 1 else Op("and", parts)


def understood(text: str, columns: list[str] | None = None) -> Query | None:
    """The query as it stands if it is valid, else sanitised."""
    try:
        return parse_query(text, columns)
    except QuerySyntaxError:
        return sanitised(text)


def expanded(text: str) -> Query | None:
    """Compound identifiers of the query or else their words; None if nothing changes."""
    parts, changed = [], False
    for t in re.findall(r"[A-Za-z0-9_]+", text):
        own = Phrase(tuple(_words(t)), prefix=True)
        words = query_words(t)
        if len(words) >= 2:
            changed = True
            parts.append(Op("or", (own, Op("and", tuple(Phrase((w,), prefix=True) for w in words)))))
        elif own.words:
            parts.append(own)
    if not changed:
        return None
    return parts[0] if len(parts) == 1 else Op("and", tuple(parts))


def phrases(q: Query) -> list[Phrase]:
    if isinstance(q, Phrase):
        return [q]
    return [p for part in (q.parts[:1] if q.kind == "not" else q.parts) for p in phrases(part)]


# ------------------------------------------------------------------------------------------------------ matching


def _found(post: DataFrame, wanted: list[Phrase]) -> DataFrame:
    """(id, q, col, pos) of each place where the words of phrase ``q`` stand in a row; the last word may be a prefix."""
    votes, any_word = [], F.lit(False)
    for q, p in enumerate(wanted):
        own = F.col("col") == p.column if p.column else F.lit(True)
        for i, w in enumerate(p.words):
            word = F.col("term").startswith(w) if p.prefix and i == len(p.words) - 1 else F.col("term") == w
            votes.append(F.when(own & word, F.struct(F.lit(q).alias("q"), F.lit(i).alias("i"), (F.col("pos") - i).alias("start"))))
            any_word = any_word | word
    if not votes:
        return post.limit(0).select("id", F.lit(0).alias("q"), "col", "pos")
    cast = post.where(any_word).select("id", "col", F.explode(F.array_compact(F.array(*votes))).alias("v")).select("id", "col", "v.*")
    # a start is hit when every word votes for it; of one word each vote is a hit
    sizes = F.element_at(F.array(*(F.lit(len(p.words)) for p in wanted)), F.col("q") + 1)
    rows = cast.groupBy("id", "q", "col", F.col("start").alias("pos")).agg(F.count_distinct("i").alias("n")) if any(len(p.words) > 1 for p in wanted) else None
    hits = cast.select("id", "q", "col", F.col("start").alias("pos")) if rows is None else rows.where(F.col("n") == sizes).drop("n")
    initial = [q for q, p in enumerate(wanted) if p.initial]
    return hits.where(~F.col("q").isin(initial) | (F.col("pos") == 0)) if initial else hits


def phrase_hits(post: DataFrame, p: Phrase) -> DataFrame:
    """(id, col, pos) of each place where the phrase's words stand in a row."""
    return _found(post, [p]).select("id", "col", "pos")


def _leaves(q: Query) -> list[Phrase]:
    """All phrases of the tree, those under ``not`` too."""
    return [q] if isinstance(q, Phrase) else [p for part in q.parts for p in _leaves(part)]


def _holds(q: Query, index: dict[Phrase, int], held: Column) -> Column:
    """Whether a row that holds the phrases of these numbers satisfies the query."""
    if isinstance(q, Phrase):
        return F.array_contains(held, index[q])
    parts = [_holds(part, index, held) for part in q.parts]
    if q.kind == "or":
        return reduce(lambda a, b: a | b, parts)
    return reduce(lambda a, b: a & b, parts if q.kind == "and" else [parts[0], *(~x for x in parts[1:])])


def _per_row(post: DataFrame, q: Query, weights: dict[str, float] | None) -> tuple[DataFrame, dict[Phrase, int]]:
    """(id, q, f): the weighted count of each phrase in each row that holds it, and the phrases' numbers."""
    leaves = list(dict.fromkeys(_leaves(q)))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("col")) if weights else F.lit(1.0)
    return _found(post, leaves).groupBy("id", "q").agg(F.sum(weight).alias("f")), {p: i for i, p in enumerate(leaves)}


def matching(post: DataFrame, q: Query) -> DataFrame:
    """Distinct ids that satisfy the query."""
    f, index = _per_row(post, q, None)
    return f.groupBy("id").agg(F.collect_list("q").alias("held")).where(_holds(q, index, F.col("held"))).select("id")


def bm25(post: DataFrame, length: DataFrame, q: Query, weights: dict[str, float]) -> DataFrame:
    """(id, rank) of the matching rows; smaller is better.

    rank = -sum over phrases of idf * f * (k1 + 1) / (f + k1 * (1 - b + b * d / mean d)), f the weighted count of the
    phrase in the row, idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6.
    """
    f, index = _per_row(post, q, weights)
    scored = F.col("q").isin(sorted({index[p] for p in phrases(q)}))
    n = f.where(scored).groupBy("q").agg(F.count("*").cast("double").alias("n"))  # one row per phrase
    corpus = length.agg(F.count("*").cast("double").alias("corpus_rows"), F.avg("d").alias("mean"))
    idf = F.log((F.col("corpus_rows") - F.col("n") + F.lit(0.5)) / (F.col("n") + F.lit(0.5)))
    scale = n.crossJoin(F.broadcast(corpus)).select("q", "mean", F.when(idf <= 0, F.lit(MIN_IDF)).otherwise(idf).alias("idf"))
    # a row has at most as many entries as the query has phrases
    rows = f.groupBy("id").agg(F.collect_list(F.struct("q", "f")).alias("held")).where(_holds(q, index, F.col("held.q")))
    kept = rows.select("id", F.explode("held").alias("h")).select("id", "h.*").where(scored).join(F.broadcast(scale), "q").join(length, "id")
    part = F.col("idf") * F.col("f") * F.lit(K1 + 1) / (F.col("f") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("d") / F.col("mean")))
    return kept.groupBy("id").agg((-F.sum(part)).alias("rank"))


def best(scored: DataFrame, limit: int) -> DataFrame:
    return scored.orderBy("rank", "id").limit(limit)


def overfetch(limit: int) -> int:
    return max(30, 8 * limit)


# ------------------------------------------------------------------------------------------------------ snippets

SNIPPET_TOKENS, SNIPPET_CHARS = 30, 160


def snippet(text: str | None, terms: list[str], prefixes: bool = True) -> str | None:
    """Up to 30 tokens around where most query terms stand, marked, cut to 160 characters."""
    if text is None:
        return None
    spans = [m.span() for m in re.finditer(r"[^\W_]+", text)]
    words = [text[a:b].lower() for a, b in spans]
    hit = [any(w.startswith(t) if prefixes else w == t for t in terms) for w in words]
    first, most = 0, -1
    for i in range(max(1, len(words) - SNIPPET_TOKENS + 1)):
        if (n := sum(hit[i : i + SNIPPET_TOKENS])) > most:
            first, most = i, n
    last = min(len(words), first + SNIPPET_TOKENS)
    if not words:
        return text[:SNIPPET_CHARS]
    out, at = ["..."] if first else [], spans[first][0] if first else 0
    for i in range(first, last):
        a, b = spans[i]
        out += [text[at:a], f"»{text[a:b]}«" if hit[i] else text[a:b]]
        at = b
    out.append("..." if last < len(words) else text[at:])
    s = "".join(out)
    return s if len(s) <= SNIPPET_CHARS else s[:SNIPPET_CHARS] + "…"


def with_snippets(rows: DataFrame, column: str, q: Query) -> DataFrame:
    """Adds snippet; meant for the few rows that are left after the limit."""
    terms = sorted({w for p in phrases(q) for w in p.words})

    @F.pandas_udf(T.StringType())
    def make(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: snippet(t, terms), na_action="ignore")

    return rows.withColumn("snippet", make(F.col(column)))


# --------------------------------------------------------------------------------------------------- suggestions


def suggestions(functions: DataFrame, types: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Names near a query that found nothing: the longest prefixes of its terms (3 characters at least), functions before types."""
    terms = [t for t in re.findall(r"[A-Za-z0-9]+", query) if len(t) >= 3]
    rows = [(i, len(t) - n, t[:n].lower()) for i, t in enumerate(terms) for n in range(len(t), 2, -1)]
    names = functions.select("name", F.lit(0).alias("src")).unionByName(types.select("name", F.lit(1).alias("src"))).distinct()
    if not rows:
        return names.limit(0).select("name")
    # at most the characters of one query: an array literal, tried per name without a join
    tries = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("cut"), F.lit(p).alias("p")) for i, n, p in rows])
    hit = F.filter(tries, lambda t: F.contains(F.lower("name"), t["p"]))
    found = names.select("name", "src", hit.alias("h")).where(F.size("h") > 0)
    first = found.groupBy("name").agg(F.min(F.struct(F.col("h")[0]["i"].alias("i"), F.col("h")[0]["cut"].alias("cut"), "src")).alias("o"))
    return first.orderBy("o.i", "o.cut", "o.src", "name").limit(limit).select("name")
