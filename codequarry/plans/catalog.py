"""Every registered query of the engine with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codequarry.functions import text as fn
from codequarry.operators import aggregates, edges, evaluate, graph, search
from codequarry.plans import extraction, resolution
from codequarry.plans.views import EDGE, SYM, symbols, table
from codequarry.plans.views import edges as calls
from codequarry.schema import EXTENSIONS
from codequarry.session import scratch
from codequarry.sources import files
from codequarry.streaming.changes import debounce, latest_changes, relevant
from codequarry.streaming.maintain import debounce_to_table, listing_changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = resolution.QUERIES | extraction.QUERIES
SQL: dict[str, str] = resolution.SQL | extraction.SQL


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


SEED = "red widget"
_TERMS = ["the", "mentend"]
_RANKED = "resolution IN ('same-file', 'same-package', 'receiver-typed')"

# ------------------------------------------------------------------------------------------ definitions and edges

_LABEL = "CASE WHEN kind = 'method' THEN 'method' WHEN kind LIKE 'type/%' THEN substr(kind, 6) ELSE 'function' END"
_PRIORITY = "CASE WHEN kind = 'method' THEN 2 WHEN kind LIKE 'type/%' THEN 0 ELSE 1 END"


@_query("definition_lookup", f"WITH {SYM} SELECT name, kind, {_LABEL} AS label, {_PRIORITY} AS priority, file_path, start_line, id FROM sym WHERE lower(name) = lower('RED Widget')")
def _definition_lookup(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d).where(fn.equal_fold(F.col("name"), F.lit("RED Widget")))
    return s.select("name", "kind", fn.label(F.col("kind")).alias("label"), fn.priority(F.col("kind")).alias("priority"), "file_path", "start_line", "id")


@_query("exact_name_canonical", f"""WITH {SYM}, r AS (SELECT *, {_PRIORITY} AS priority FROM sym),
k AS (SELECT *, rank() OVER (PARTITION BY package, name ORDER BY priority) AS r FROM r)
SELECT package, name, min(id) AS id, min(priority) AS priority FROM k WHERE r = 1 GROUP BY package, name HAVING count(*) = 1""")
def _exact_name_canonical(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d).withColumn("priority", fn.priority(F.col("kind")))
    return aggregates.unique_best(s, ["package", "name"], "priority").select("package", "name", "id", "priority")


@_query("direct_callers", f"WITH {SYM}, {EDGE} SELECT s.name AS caller_name, s.file_path AS caller_file, e.line, e.resolution FROM edge e JOIN sym s ON s.id = e.caller_id WHERE e.callee_name = 'part_7'")
def _direct_callers(spark: SparkSession, d: str) -> DataFrame:
    return edges.direct_callers(calls(spark, d), symbols(spark, d), "part_7")


@_query("direct_callees", f"""WITH {SYM}, {EDGE} SELECT coalesce(t.name, e.callee_name) AS callee, t.file_path AS callee_file, e.line, e.resolution
FROM edge e JOIN sym s ON s.id = e.caller_id AND s.name = '{SEED}' LEFT JOIN sym t ON t.id = e.callee_id""")
def _direct_callees(spark: SparkSession, d: str) -> DataFrame:
    return edges.direct_callees(calls(spark, d), symbols(spark, d), SEED)


def _walk_sql(direction: str, cond: str, depth: int = 2) -> str:
    if direction == "callers":
        step = f"SELECT DISTINCT e.caller_id, w.depth + 1, e.resolution, NULL FROM w JOIN edge e ON e.callee_id = w.id WHERE w.depth < {depth} AND {cond}"
        tail = ""
    else:
        step = f"SELECT DISTINCT coalesce(e.callee_id, 0), w.depth + 1, e.resolution, CASE WHEN e.callee_id IS NULL THEN e.callee_name END FROM w JOIN edge e ON e.caller_id = w.id WHERE w.depth < {depth} AND {cond}"
        tail = "UNION SELECT w.name, '(external)', NULL, w.depth, w.resolution FROM w WHERE w.depth > 0 AND w.id = 0"
    return f"""WITH RECURSIVE {SYM}, {EDGE}, w(id, depth, resolution, name) AS (
  SELECT id, 0, '', CAST(NULL AS VARCHAR) FROM sym WHERE name = '{SEED}' UNION {step})
SELECT DISTINCT s.name, s.file_path, s.start_line, w.depth, w.resolution FROM w JOIN sym s ON s.id = w.id WHERE w.depth > 0 {tail}"""


for _direction in ("callers", "callees"):
    _query(f"call_chain_{_direction}", _walk_sql(_direction, "e.resolution != 'interface-dispatch'"))(
        lambda spark, d, x=_direction: graph.call_chain(symbols(spark, d), calls(spark, d), SEED, 2, x)
    )


@_query("min_confidence_filter", _walk_sql("callers", "e." + _RANKED))
def _min_confidence(spark: SparkSession, d: str) -> DataFrame:
    return graph.call_chain(symbols(spark, d), calls(spark, d), SEED, 2, "callers", "receiver-typed")


@_query("call_chain_capped", f"""WITH r AS ({_walk_sql("callers", "e.resolution != 'interface-dispatch'")})
SELECT *, (SELECT count(*) FROM r) AS total, (SELECT count(*) FROM r) > 50 AS truncated FROM r ORDER BY depth, name, file_path, start_line, resolution LIMIT 50""")
def _call_chain_capped(spark: SparkSession, d: str) -> DataFrame:
    return graph.capped(graph.call_chain(symbols(spark, d), calls(spark, d), SEED))


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return symbols(spark, d).where("file_path = 'Brand#7/PROMO'").select("id")


_IMPACT = f"""WITH {SYM}, {EDGE},
e AS (SELECT callee_id AS src, caller_id AS id, resolution AS r FROM edge WHERE resolution != 'interface-dispatch' AND callee_id IS NOT NULL AND callee_id != caller_id),
s AS (SELECT id, id AS via FROM sym WHERE file_path = 'Brand#7/PROMO'),
a AS (SELECT e.id, min((s.via, e.r)) AS v FROM e JOIN s ON s.id = e.src GROUP BY e.id),
b AS (SELECT e.id, min((a.v[1], e.r)) AS v FROM e JOIN a ON a.id = e.src GROUP BY e.id),
m AS (SELECT id, 1 AS depth, v[1] AS via_id, v[2] AS via_resolution FROM a UNION ALL SELECT id, 2, v[1], v[2] FROM b WHERE id NOT IN (SELECT id FROM a)),
impact AS (SELECT m.id, t.file_path AS file, t.name AS symbol, t.start_line AS line, m.depth, o.name AS via, t.kind, m.via_resolution
  FROM m JOIN sym t ON t.id = m.id JOIN sym o ON o.id = m.via_id)"""


def _impact(spark: SparkSession, d: str) -> DataFrame:
    return graph.impact(symbols(spark, d), calls(spark, d), _seeds(spark, d))


_query("impact_radius", f"{_IMPACT} SELECT * FROM impact")(_impact)


@_query("impact_breakdown", f"{_IMPACT} SELECT via_resolution, count(*) AS n, max(depth) AS max_depth FROM impact GROUP BY 1")
def _impact_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return _impact(spark, d).groupBy("via_resolution").agg(F.count("*").alias("n"), F.max("depth").alias("max_depth"))


_RANK_STEPS = 5
_PAGERANK = f"""WITH RECURSIVE {SYM}, {EDGE},
e AS (SELECT caller_id AS src, callee_id AS dst, count(*) AS w FROM edge WHERE callee_id IS NOT NULL AND callee_id != caller_id AND resolution != 'interface-dispatch' GROUP BY 1, 2),
g AS (SELECT src, sum(w) AS degree FROM e GROUP BY 1), sh AS (SELECT e.src, e.dst, e.w / g.degree AS share FROM e JOIN g USING (src)),
n AS (SELECT count(*)::DOUBLE AS n FROM sym)""" + "".join(
    f""", p{i} AS (SELECT s.id, {'1.0 / n.n' if i == 0 else f'0.15 / n.n + 0.85 * (coalesce(got, 0) + (SELECT coalesce(sum(score), 0) FROM p{i - 1} WHERE id NOT IN (SELECT src FROM g)) / n.n)'} AS score
  FROM sym s CROSS JOIN n {'' if i == 0 else f'LEFT JOIN (SELECT sh.dst, sum(p.score * sh.share) AS got FROM sh JOIN p{i - 1} p ON p.id = sh.src GROUP BY 1) q ON q.dst = s.id'})"""
    for i in range(_RANK_STEPS + 1)
)


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(symbols(spark, d), calls(spark, d), _RANK_STEPS, epsilon=None)


@_query("pagerank", f"{_PAGERANK} SELECT id, round(score, 9) AS score FROM p{_RANK_STEPS}")
def _pagerank(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(spark, d).select("id", F.round("score", 9).alias("score"))


@_query("file_scores", f"{_PAGERANK} SELECT file_path, round(sum(score), 9) AS score FROM p{_RANK_STEPS} JOIN sym USING (id) GROUP BY 1")
def _file_scores(spark: SparkSession, d: str) -> DataFrame:
    return graph.file_scores(symbols(spark, d), _ranks(spark, d)).select("file_path", F.round("score", 9).alias("score"))


@_query("dir_scores", f"{_PAGERANK} SELECT split_part(file_path, '/', 1) AS dir, round(sum(score), 9) AS score FROM p{_RANK_STEPS} JOIN sym USING (id) GROUP BY 1")
def _dir_scores(spark: SparkSession, d: str) -> DataFrame:
    files = graph.file_scores(symbols(spark, d), _ranks(spark, d))
    return files.groupBy(fn.top_level_dir(F.col("file_path")).alias("dir")).agg(F.round(F.sum("score"), 9).alias("score"))


@_query("resolution_histogram", f"WITH {EDGE} SELECT resolution, count(*) AS n FROM edge GROUP BY 1")
def _resolution_histogram(spark: SparkSession, d: str) -> DataFrame:
    return edges.resolution_histogram(calls(spark, d))


@_query("language_histogram", f"WITH {SYM}, {EDGE} SELECT language, resolution, count(*) AS n FROM edge JOIN sym ON sym.id = caller_id GROUP BY 1, 2")
def _language_histogram(spark: SparkSession, d: str) -> DataFrame:
    return edges.edge_languages(calls(spark, d), symbols(spark, d))


@_query("language_counts", f"WITH {SYM} SELECT language, count(*) AS n, count(DISTINCT file_path) AS files FROM sym GROUP BY 1")
def _language_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.language_counts(symbols(spark, d))


@_query("directory_map", f"WITH {SYM} SELECT split_part(file_path, '/', 1) AS dir, count(*) AS functions, count(DISTINCT file_path) AS files FROM sym GROUP BY 1")
def _directory_map(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.directory_map(symbols(spark, d))


@_query("file_symbols", f"WITH {SYM} SELECT id, name, start_line FROM sym WHERE file_path = 'Brand#7/PROMO'")
def _file_symbols(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.symbols_in_file(symbols(spark, d), "Brand#7/PROMO").select("id", "name", "start_line")


@_query("golden_edges", f"""WITH {SYM}, {EDGE} SELECT s.name AS caller_name, e.callee_name, e.file_path AS call_file, t.kind AS want_receiver, t.package AS want_package, t.file_path AS want_file, e.resolution AS want_marker
FROM edge e JOIN sym s ON s.id = e.caller_id LEFT JOIN sym t ON t.id = e.callee_id""")
def _golden_edges(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d).withColumn("receiver_type", F.col("kind"))
    return edges.golden_edges(calls(spark, d), s)


# --------------------------------------------------------------------------------------------------------- search

_TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_POST = f"post AS (SELECT doc_id AS id, unnest({_TOK}) AS term, generate_subscripts({_TOK}, 1) - 1 AS pos FROM documents)"
_LEN = f"len AS (SELECT doc_id AS id, len({_TOK}) AS d FROM documents)"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


def _post(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(_documents(spark, d), ["text"], "doc_id")


def _bm25_sql(groups: list[str], match: str, weight: str = "1.0", post: str = _POST, length: str = _LEN) -> str:
    parts = " UNION ALL ".join(f"SELECT id, {i} AS q, sum(w) AS f FROM (SELECT *, {weight} AS w FROM post) WHERE {g} GROUP BY id" for i, g in enumerate(groups))
    return f"""WITH {post}, {length}, f AS ({parts}), n AS (SELECT q, count(*)::DOUBLE AS n FROM f GROUP BY q),
c AS (SELECT count(*)::DOUBLE AS nn, avg(d) AS mean FROM len),
i AS (SELECT q, CASE WHEN ln((nn - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((nn - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) END AS idf FROM n, c)
SELECT id, round(-sum(idf * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d / mean))), 9) AS rank
FROM f JOIN i USING (q) JOIN len USING (id), c WHERE {match} GROUP BY id"""


def _ranked(post: DataFrame, length: DataFrame, q: str, weights: dict[str, float]) -> DataFrame:
    return search.bm25(post, length, search.understood(q), weights).select("id", F.round("rank", 9).alias("rank"))


@_query("bm25_documents", _bm25_sql(["term = 'the'", "term = 'ther'"], "id IN (SELECT id FROM post WHERE term = 'the') AND id IN (SELECT id FROM post WHERE term = 'ther')"))
def _bm25_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    return _ranked(_post(spark, d), search.lengths(docs, ["text"], "doc_id"), "the ther", {"text": 1.0})


_POST2 = " UNION ALL ".join(
    f"SELECT doc_id AS id, '{c}' AS col, unnest(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')) AS term FROM documents" for c in ("source", "lang", "text")
)
_LEN2 = "len AS (SELECT doc_id AS id, " + " + ".join(f"len(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'))" for c in ("source", "lang", "text")) + " AS d FROM documents)"


@_query("bm25_weighted_columns", _bm25_sql(
    ["term = 'src3'", "term LIKE 'en%'"], "id IN (SELECT id FROM post WHERE term = 'src3') AND id IN (SELECT id FROM post WHERE term LIKE 'en%')",
    "CASE col WHEN 'source' THEN 5.0::DOUBLE WHEN 'lang' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END", f"post AS ({_POST2})", _LEN2))
def _bm25_weighted(spark: SparkSession, d: str) -> DataFrame:
    docs, columns = _documents(spark, d), ["source", "lang", "text"]
    post = search.postings(docs, columns, "doc_id")
    return _ranked(post, search.lengths(docs, columns, "doc_id"), "src3 en*", {"source": 5.0, "lang": 1.5, "text": 1.0})


@_query("bm25_top_k", "SELECT * FROM (" + _bm25_sql(["term = 'the'", "term = 'ther'"], "true") + ") ORDER BY rank, id LIMIT 30")
def _bm25_top(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    ranked = _ranked(_post(spark, d), search.lengths(docs, ["text"], "doc_id"), "the OR ther", {"text": 1.0})
    return search.best(ranked, search.overfetch(3))


@_query("phrase_match", f"WITH {_POST} SELECT a.id, count(*) AS hits FROM post a JOIN post b ON b.id = a.id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY a.id")
def _phrase_match(spark: SparkSession, d: str) -> DataFrame:
    return search.phrase_hits(_post(spark, d), search.Phrase(("of", "the"))).groupBy("id").agg(F.count("*").alias("hits"))


@_query("prefix_match", f"WITH {_POST} SELECT id, count(*) AS hits FROM post WHERE term LIKE 'ment%' GROUP BY id")
def _prefix_match(spark: SparkSession, d: str) -> DataFrame:
    return search.phrase_hits(_post(spark, d), search.Phrase(("ment",), prefix=True)).groupBy("id").agg(F.count("*").alias("hits"))


@_query("or_expansion", f"WITH {_POST} SELECT DISTINCT id FROM post WHERE term LIKE 'fetchuser%' OR id IN (SELECT id FROM post WHERE term LIKE 'ment%' INTERSECT SELECT id FROM post WHERE term LIKE 'eau%')")
def _or_expansion(spark: SparkSession, d: str) -> DataFrame:
    q = search.Op("or", (search.Phrase(("fetchuser",), True), search.Op("and", (search.Phrase(("ment",), True), search.Phrase(("eau",), True)))))
    return search.matching(_post(spark, d), q)


@_query("boolean_not", f"WITH {_POST} SELECT DISTINCT id FROM post WHERE term = 'the' AND id NOT IN (SELECT id FROM post WHERE term = 'license')")
def _boolean_not(spark: SparkSession, d: str) -> DataFrame:
    return search.matching(_post(spark, d), search.parse_query("the NOT license"))


@_query("postings", f"WITH {_POST} SELECT term, count(*) AS occurrences, count(DISTINCT id) AS documents FROM post GROUP BY term")
def _postings(spark: SparkSession, d: str) -> DataFrame:
    return search.vocabulary(_post(spark, d))


@_query("suggestions", f"""WITH {SYM}, names AS (SELECT DISTINCT name, CASE WHEN kind LIKE 'type/%' THEN 1 ELSE 0 END AS src FROM sym),
t AS (SELECT 0 AS i, 'widgte' AS t UNION ALL SELECT 1, 'rinng'), p AS (SELECT i, n, lower(left(t, length(t) - n)) AS p FROM t, range(0, 9) r(n) WHERE length(t) - n >= 3),
h AS (SELECT name, min((i, n, src)) AS o FROM names, p WHERE contains(lower(name), p) GROUP BY name)
SELECT name FROM h ORDER BY o, name LIMIT 5""")
def _suggestions(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d)
    is_type = F.col("kind").startswith("type/")
    return search.suggestions(s.where(~is_type), s.where(is_type), "widgte rinng")


@_query("exact_match_terms", f"WITH {SYM} SELECT id, name FROM sym WHERE lower(name) IN ('small', 'ring') OR lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) = 'smallring'")
def _exact_match(spark: SparkSession, d: str) -> DataFrame:
    return symbols(spark, d).where(search.is_exact(F.col("name"), "Small ring?")).select("id", "name")


@_query("split_identifier", r"""WITH n AS (SELECT c_custkey AS id, replace(c_name, '#', 'HTTPServer') AS name FROM customer UNION ALL SELECT s_suppkey + 1000000, 'get' || s_name || 'v2x_id' FROM supplier),
w AS (SELECT id, name, regexp_extract_all(regexp_replace(regexp_replace(name, '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[0-9]+[a-z]*|[A-Z]+[a-z]*|[a-z]+') AS ws FROM n)
SELECT id, name, CASE WHEN len(ws) >= 2 THEN array_to_string(ws, ' ') END AS parts FROM w""")
def _split_identifier(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.replace("c_name", F.lit("#"), F.lit("HTTPServer")).alias("name"))
    s = table(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("id"), F.concat(F.lit("get"), "s_name", F.lit("v2x_id")).alias("name"))
    return c.unionByName(s).withColumn("parts", fn.split_identifier(F.col("name")))


# ------------------------------------------------------------------------------------------- resolver's aggregates


@_query("innermost_span", """WITH e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line FROM events),
s AS (SELECT event_id AS id, user_id, line AS a, line + event_id % 5 AS b FROM e)
SELECT point_id, id AS span_id, span FROM (
  SELECT e.event_id AS point_id, s.id, s.b - s.a AS span, row_number() OVER (PARTITION BY e.event_id ORDER BY s.b - s.a, s.id) AS r
  FROM e JOIN s ON s.user_id = e.user_id AND s.a <= e.line AND s.b >= e.line) WHERE r = 1""")
def _innermost_span(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("file_path"), F.row_number().over(w).cast("long").alias("line"))
    spans = e.select(F.col("event_id").alias("id"), "file_path", F.col("line").alias("start_line"), (F.col("line") + F.col("event_id") % 5).alias("end_line"))
    return aggregates.innermost(e.select(F.col("event_id").alias("point_id"), "file_path", "line"), spans)


@_query("sole_distinct_type", "SELECT p_name, p_brand, min(p_type) AS p_type FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_type) = 1")
def _sole_distinct(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.sole_value(table(spark, d, "part"), ["p_name", "p_brand"], "p_type")


@_query("first_nonempty", "SELECT p_name, arg_min(p_type, p_partkey) AS p_type FROM part WHERE p_type NOT LIKE 'S%' GROUP BY p_name")
def _first_nonempty(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("p_type", F.when(F.col("p_type").startswith("S"), "").otherwise(F.col("p_type")))
    return aggregates.first_nonempty(p, ["p_name"], "p_type", "p_partkey")


@_query("unique_match", f"WITH {SYM} SELECT package, name, min(id) AS id, min(file_path) AS file_path FROM sym GROUP BY 1, 2 HAVING count(*) = 1")
def _unique_match(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.unique_match(symbols(spark, d), ["package", "name"])


@_query("first_definition", f"WITH {SYM} SELECT name, min(id) AS id FROM sym GROUP BY 1")
def _first_definition(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.first_definition(symbols(spark, d))


_BASES = """base AS (SELECT 'customer' || c_custkey AS c, 'nation' || c_nationkey AS b, 0 AS ord FROM customer
UNION ALL SELECT 'nation' || n_nationkey, 'region' || n_regionkey, 0 FROM nation UNION ALL SELECT 'supplier' || s_suppkey, 'nation' || s_nationkey, 0 FROM supplier)"""


@_query("inheritance_lookup", f"""WITH RECURSIVE {_BASES}, w(class_name, ancestor, level) AS (SELECT c, b, 1 FROM base UNION SELECT w.class_name, base.b, w.level + 1 FROM w JOIN base ON base.c = w.ancestor WHERE w.level < 20)
SELECT class_name, ancestor, min(level) AS level FROM w GROUP BY 1, 2""")
def _inheritance(spark: SparkSession, d: str) -> DataFrame:
    def rows(t: str, prefix: str, key: str, base: str, parent: str) -> DataFrame:
        return table(spark, d, t).select(
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("class_name"), F.concat(F.lit(base), F.col(parent).cast("string")).alias("base_name"), F.lit(0).alias("ord")
        )

    bases = rows("customer", "customer", "c_custkey", "nation", "c_nationkey").unionByName(rows("nation", "nation", "n_nationkey", "region", "n_regionkey"))
    bases = bases.unionByName(rows("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"))
    return graph.inheritance_closure(bases).select("class_name", "ancestor", "level")


@_query("implements_division", """WITH want AS (SELECT DISTINCT o_custkey AS iface, o_orderstatus AS method FROM orders), have AS (SELECT DISTINCT l_suppkey AS type, l_linestatus AS method FROM lineitem),
n AS (SELECT iface, count(*) AS n FROM want GROUP BY 1)
SELECT w.iface, h.type FROM want w JOIN have h USING (method) JOIN n ON n.iface = w.iface GROUP BY w.iface, h.type, n.n HAVING count(*) = n.n AND w.iface != h.type""")
def _implements(spark: SparkSession, d: str) -> DataFrame:
    want = table(spark, d, "orders").select(F.col("o_custkey").alias("iface"), F.col("o_orderstatus").alias("method"))
    have = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("type"), F.col("l_linestatus").alias("method"))
    return graph.implements(have, want)


@_query("interface_dispatch", f"""WITH {SYM}, site AS (SELECT l_orderkey AS site, l_linenumber AS line, p_brand AS iface, p_name AS callee_name FROM lineitem JOIN part ON p_partkey = l_partkey),
impl AS (SELECT DISTINCT package AS iface, kind AS type FROM sym), m AS (SELECT kind AS type, name AS method, min(id) AS id FROM sym GROUP BY 1, 2)
SELECT site, line, site.iface, callee_name, count(*) AS edges FROM site JOIN impl ON impl.iface = site.iface JOIN m ON m.type = impl.type AND m.method = site.callee_name GROUP BY ALL""")
def _interface_dispatch(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d)
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("receiver_type"), F.col("p_name").alias("callee_name"))
    sites = table(spark, d, "lineitem").join(p, "l_partkey").select(
        F.col("l_orderkey").alias("site"), F.col("l_linenumber").alias("line"), "receiver_type", "callee_name", F.lit("var").alias("receiver_kind")
    )
    impl = s.select(F.col("package").alias("iface"), F.col("kind").alias("type")).distinct()
    methods = s.groupBy(F.col("kind").alias("type"), F.col("name").alias("method")).agg(F.min("id").alias("id"))
    return graph.dispatch_edges(sites, impl, methods).groupBy("site", "line", "iface", "callee_name").agg(F.count("*").alias("edges"))


@_query("stale_edges", f"WITH {SYM}, {EDGE} SELECT * FROM edge WHERE EXISTS (SELECT 1 FROM sym WHERE sym.id = callee_id AND file_path IN ('Brand#7/PROMO', 'Brand#3/SMALL'))")
def _stale(spark: SparkSession, d: str) -> DataFrame:
    changed = spark.createDataFrame([("Brand#7/PROMO",), ("Brand#3/SMALL",)], "path string")
    return edges.stale_edges(calls(spark, d), symbols(spark, d), changed)


@_query("stale_repair", f"""WITH {SYM}, {EDGE}, st AS (SELECT * FROM edge WHERE EXISTS (SELECT 1 FROM sym WHERE sym.id = callee_id AND file_path = 'Brand#7/PROMO')),
new AS (SELECT file_path, line, callee_name, min(callee_id) AS callee_id FROM edge WHERE callee_id IS NOT NULL AND resolution != 'name-global' GROUP BY 1, 2, 3)
SELECT st.caller_id, st.callee_name, st.file_path, st.line, new.callee_id, CASE WHEN new.callee_id IS NULL THEN 'unresolved' ELSE 'same-package' END AS resolution
FROM st LEFT JOIN new ON new.file_path = st.file_path AND new.line = st.line AND new.callee_name = st.callee_name""")
def _stale_repair(spark: SparkSession, d: str) -> DataFrame:
    c = calls(spark, d)
    changed = spark.createDataFrame([("Brand#7/PROMO",)], "path string")
    new = c.where("callee_id IS NOT NULL AND resolution != 'name-global'").withColumn("resolution", F.lit("same-package")).withColumn("ord", F.col("callee_id"))
    return edges.repair_stale(edges.stale_edges(c, symbols(spark, d), changed), new)


@_query("top_imports_per_file", """WITH f AS (SELECT o_custkey, count(*) AS score FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
i AS (SELECT DISTINCT o_custkey, p_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
r AS (SELECT i.o_custkey, p_name, score, row_number() OVER (PARTITION BY i.o_custkey ORDER BY p_name) AS r FROM f JOIN i USING (o_custkey))
SELECT o_custkey, p_name, score FROM r WHERE r <= 5 ORDER BY score DESC, o_custkey, p_name LIMIT 30""")
def _top_imports(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    top = o.groupBy("o_custkey").agg(F.count("*").alias("score")).orderBy(F.desc("score"), "o_custkey").limit(10)
    used = o.join(F.broadcast(top), "o_custkey").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"), "o_orderkey")
    named = used.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey").select("o_custkey", "p_name", "score").distinct()
    return aggregates.top_per_key(named, ["o_custkey"], ["p_name"], 5).orderBy(F.desc("score"), "o_custkey", "p_name").limit(30)


# ------------------------------------------------------------------------------------------------------- streaming


@_query("debounce_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS started, max(ts) AS last_event, count(*) AS events FROM s GROUP BY user_id, sid""")
def _debounce(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = debounce(e, ["user_id"], "6 hours")
    return out.select("user_id", F.col("first_event").cast("timestamp_ntz").alias("started"), F.col("last_event").cast("timestamp_ntz").alias("last_event"), "events")


@_query("debounce_stream", SQL["debounce_sessions"])
def _debounce_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same bursts from a stream over the table's files."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = debounce_to_table(stream, ["user_id"], "6 hours", scratch(spark, "stream"))
    return out.select("user_id", F.col("first_event").cast("timestamp_ntz").alias("started"), F.col("last_event").cast("timestamp_ntz").alias("last_event"), "events")


@_query("change_upsert", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events WHERE event_type != 'view' GROUP BY user_id")
def _change_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type != 'view'")
    return latest_changes(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "ts")


# ------------------------------------------------------------------------------------------------------ evaluation


def _files(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))


_FILES = "files AS (SELECT conv_id || '/' || turn AS path, coalesce(text, '') AS text FROM conversations)"
_GREP = f"""{_FILES}, t AS (SELECT unnest(['the', 'mentend']) AS term), l AS (SELECT path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM files),
hits AS (SELECT term, path, line, text FROM l, t WHERE contains(text, term))"""


@_query("grep_hits", f"WITH {_GREP} SELECT term, path, line, text FROM hits")
def _grep_hits(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.grep(_files(spark, d), _TERMS)


@_query("grep_regex", f"WITH {_FILES}, l AS (SELECT path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM files) SELECT 'ment[a-z]+ion' AS term, path, line, text FROM l WHERE regexp_matches(text, 'ment[a-z]+ion')")
def _grep_regex(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.grep(_files(spark, d), ["ment[a-z]+ion"], regex=True)


@_query("naive_tokens", f"""WITH {_GREP}, h AS (SELECT term, path, sum(ceil(length(path || ':' || line || ':' || text) / 4.0)::BIGINT) AS n FROM hits GROUP BY 1, 2)
SELECT term, sum(n + w)::BIGINT AS tokens FROM h JOIN (SELECT path, ceil(length(text) / 4.0)::BIGINT AS w FROM files) USING (path) GROUP BY term""")
def _naive_tokens(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.naive_tokens(_files(spark, d), _TERMS)


@_query("skilled_windows", f"""WITH {_GREP}, f AS (SELECT path, line // 40 AS bucket, min(line) AS line FROM hits GROUP BY 1, 2)
SELECT path, bucket, line, array_to_string(string_split(text, chr(10))[greatest(line - 20, 1) : line + 20], chr(10)) AS "window", ceil(length("window") / 4.0)::BIGINT AS tokens
FROM f JOIN files USING (path)""")
def _skilled(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.skilled_windows(_files(spark, d), _TERMS)


@_query("prf1", """WITH g AS (SELECT source, list(DISTINCT d.doc_id) FILTER (toxic = 1) AS want, list(DISTINCT d.doc_id) FILTER (d.n_chars > 2000) AS found FROM documents d JOIN labels USING (doc_id) GROUP BY 1),
c AS (SELECT source, len(list_intersect(coalesce(want, []), coalesce(found, [])))::DOUBLE AS b, len(coalesce(want, [])) AS w, len(coalesce(found, [])) AS f FROM g),
p AS (SELECT source, CASE WHEN f > 0 THEN b / f ELSE 0.0 END AS precision, CASE WHEN w > 0 THEN b / w ELSE 0.0 END AS recall FROM c)
SELECT source, round(precision, 9) AS precision, round(recall, 9) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9) AS f1 FROM p""")
def _prf1(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    sets = j.groupBy("source").agg(
        F.collect_set(F.when(F.col("n_chars") > 2000, F.col("doc_id"))).alias("found"), F.collect_set(F.when(F.col("toxic") == 1, F.col("doc_id"))).alias("want")
    )
    s = sets.select("source", evaluate.prf1(F.col("found"), F.col("want")).alias("s")).select("source", "s.*")
    return s.select("source", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


_PAIRS = "pairs AS (SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'F') AS a, max(o_totalprice) FILTER (o_orderstatus = 'O') AS b FROM orders GROUP BY 1 HAVING a IS NOT NULL AND b IS NOT NULL), dl AS (SELECT *, b - a AS delta FROM pairs)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.paired(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_totalprice", ("F", "O"))


@_query("wilcoxon", f"""WITH {_PAIRS}, r AS (SELECT delta, rank() OVER (ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY abs(delta)) - 1) / 2.0 AS k FROM dl WHERE delta != 0),
s AS (SELECT count(*) AS n, sum(k) FILTER (delta > 0) AS w_plus FROM r)
SELECT n, w_plus::DOUBLE AS w_plus, round((w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0), 6) AS z FROM s""")
def _wilcoxon(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.wilcoxon(_pairs(spark, d)).select("n", "w_plus", F.round("z", 6).alias("z"))


@_query("mcnemar", f"""WITH {_PAIRS}, c AS (SELECT count(*) FILTER (a <= 200000 AND b > 200000) AS b01, count(*) FILTER (a > 200000 AND b <= 200000) AS b10 FROM dl)
SELECT b01, b10, round(CASE WHEN b01 + b10 > 0 THEN greatest(abs(b01 - b10) - 1, 0) ** 2 / (b01 + b10) ELSE 0 END, 9) AS chi2 FROM c""")
def _mcnemar(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d).select((F.col("a") > 200000).alias("x"), (F.col("b") > 200000).alias("y"))
    return evaluate.mcnemar(p, "x", "y").select("b01", "b10", F.round("chi2", 9).alias("chi2"))


@_query("cliffs_delta", f"WITH {_PAIRS} SELECT round(avg(sign(delta)), 9) AS cliffs_delta FROM dl")
def _cliffs(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.cliffs_delta(_pairs(spark, d)).select(F.round("cliffs_delta", 9).alias("cliffs_delta"))


@_query("median_delta", f"WITH {_PAIRS} SELECT round(quantile_cont(delta, 0.5), 6) AS median_delta FROM dl")
def _median(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.median_delta(_pairs(spark, d)).select(F.round("median_delta", 6).alias("median_delta"))


@_query("sign_test", f"WITH {_PAIRS} SELECT count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta < 0) AS losses, count(*) FILTER (delta = 0) AS ties FROM dl")
def _sign_test(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.sign_test(_pairs(spark, d))


@_query("arm_totals", "SELECT o_orderpriority AS arm, count(*) AS runs, count(*) FILTER (o_orderstatus = 'F') AS completed, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def _arm_totals(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.arm_totals(table(spark, d, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F", "o_totalprice")
    return out.withColumn("mean", F.round("mean", 4))


_ANSWERS = """ans AS (SELECT o_orderkey AS task, any_value(o_orderpriority) AS arm, any_value(o_custkey) AS c, list(concat('src/f', l_partkey % 7, '.go') ORDER BY l_linenumber, l_partkey, l_suppkey) AS paths,
  list(concat(' f', l_partkey % 9) ORDER BY l_linenumber, l_partkey, l_suppkey) AS names FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)"""


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """task, arm, c, paths and names, one row for each order."""
    joined = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey"), "o_orderkey")
    held = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("l")
    rows = joined.groupBy(F.col("o_orderkey").alias("task")).agg(F.min("o_orderpriority").alias("arm"), F.min("o_custkey").alias("c"), held)
    paths = F.transform("l", lambda x: F.concat(F.lit("src/f"), (x["l_partkey"] % 7).cast("string"), F.lit(".go")))
    names = F.transform("l", lambda x: F.concat(F.lit(" f"), (x["l_partkey"] % 9).cast("string")))
    return rows.select("task", "arm", "c", paths.alias("paths"), names.alias("names"))


@_query("retrieval_score", f"""WITH {_ANSWERS}, g AS (SELECT *, [concat('f', c % 7, '.go'), concat('lib/f', task % 5, '.go'), concat('/src/f', task % 3, '.go')] AS gold FROM ans),
m AS (SELECT task, paths, gold, [p FOR p IN paths IF len([x FOR x IN gold IF x = p OR ends_with(p, '/' || x) OR ends_with(x, '/' || p)]) > 0] AS hits,
  [x FOR x IN gold IF len([p FOR p IN paths IF x = p OR ends_with(p, '/' || x) OR ends_with(x, '/' || p)]) > 0] AS matched FROM g),
s AS (SELECT task, paths[1] AS lead_file, len([x FOR x IN gold IF x = paths[1] OR ends_with(paths[1], '/' || x) OR ends_with(x, '/' || paths[1])]) > 0 AS lead_correct,
  len(hits)::DOUBLE / len(paths) AS p, len(matched) / 3.0::DOUBLE AS r FROM m)
SELECT task, lead_file, lead_correct, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM s""")
def _retrieval(spark: SparkSession, d: str) -> DataFrame:
    def path(head: str, number):  # noqa: ANN001, ANN202
        return F.concat(F.lit(head), number.cast("string"), F.lit(".go"))

    gold = F.array(path("f", F.col("c") % 7), path("lib/f", F.col("task") % 5), path("/src/f", F.col("task") % 3))
    s = evaluate.retrieval_score(_answers(spark, d).withColumn("expected", gold))
    return s.select("task", "lead_file", "lead_correct", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@_query("symbol_recall", """WITH b AS (SELECT item_id, text, [x.lower() FOR x IN regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')] AS named,
  ['THE', 'Of', 'mentend', 'the' || item_id] AS gold FROM benchmark)
SELECT item_id, array_to_string([g FOR g IN gold IF list_contains(named, lower(g))], ',') AS matched, array_to_string([g FOR g IN gold IF NOT list_contains(named, lower(g))], ',') AS missed,
  round(len([g FOR g IN gold IF list_contains(named, lower(g))]) / 4.0::DOUBLE, 9) AS recall FROM b""")
def _symbol_recall(spark: SparkSession, d: str) -> DataFrame:
    gold = F.array(F.lit("THE"), F.lit("Of"), F.lit("mentend"), F.concat(F.lit("the"), F.col("item_id").cast("string")))
    s = evaluate.symbol_recall(table(spark, d, "benchmark").select("item_id", F.col("text").alias("answer"), gold.alias("expected")))
    return s.select("item_id", F.array_join("matched", ",").alias("matched"), F.array_join("missed", ",").alias("missed"), F.round("recall", 9).alias("recall"))


@_query("arm_scores", f"""WITH {_ANSWERS}, g AS (SELECT task, arm, list_sort(list_distinct([trim(x) FOR x IN names])) AS pred, ['f1', concat('f', 2 + c % 7)] AS gold FROM ans)
SELECT task, arm, array_to_string(list_sort([x FOR x IN gold IF list_contains(pred, x)]), ',') AS found, array_to_string(list_sort([x FOR x IN gold IF NOT list_contains(pred, x)]), ',') AS missed,
  round(len([x FOR x IN gold IF list_contains(pred, x)]) / 2.0::DOUBLE, 9) AS recall, round(len([x FOR x IN gold IF list_contains(pred, x)])::DOUBLE / len(pred), 9) AS precision FROM g""")
def _arm_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _answers(spark, d).withColumn("predicted", F.col("names")).withColumn("expected", F.array(F.lit("f1"), F.concat(F.lit("f"), (F.col("c") % 7 + 2).cast("string"))))
    s = evaluate.arm_scores(rows)
    return s.select("task", "arm", F.array_join("found", ",").alias("found"), F.array_join("missed", ",").alias("missed"), F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


# --------------------------------------------------------------------------------------------------------- scalars


@_query("intent_case", """SELECT item_id, CASE WHEN contains(q, 'where') AND (contains(q, 'defined') OR contains(q, 'definition')) THEN 'definition'
WHEN regexp_matches(q, 'depends on|what uses|callers|impact|breaks if') OR (contains(q, 'where is') AND contains(q, 'used')) THEN 'impact'
WHEN regexp_matches(q, 'edit|change|add |remove ') THEN 'edit_target' ELSE 'search' END AS intent
FROM (SELECT item_id, lower((['Where is it defined? ', 'callers of ', 'please add ', ''])[item_id % 4 + 1] || text) AS q FROM benchmark)""")
def _intent(spark: SparkSession, d: str) -> DataFrame:
    lead = F.element_at(F.array(*map(F.lit, ["Where is it defined? ", "callers of ", "please add ", ""])), (F.col("item_id") % 4 + 1).cast("int"))
    return table(spark, d, "benchmark").select("item_id", fn.intent(F.concat(lead, "text")).alias("intent"))


@_query("doc_title", r"""SELECT doc_id, CASE WHEN lang = 'en' AND trim(regexp_extract(c, '(?m)^\s*#+[ \t]*([^\n]*)$', 1)) != '' THEN trim(regexp_extract(c, '(?m)^\s*#+[ \t]*([^\n]*)$', 1)) ELSE doc_id || '.md' END AS title
FROM (SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN '# ' || text ELSE text END AS c FROM documents)""")
def _doc_title(spark: SparkSession, d: str) -> DataFrame:
    c = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# "), "text")).otherwise(F.col("text"))
    kind = F.when(F.col("lang") == "en", "markdown").otherwise("text")
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return _documents(spark, d).select("doc_id", fn.doc_title(c, path, kind).alias("title"))


@_query("test_file_flag", r"""SELECT page_id, regexp_matches(lower(p), '_test\.(go|py)$|\.(test|spec)\.(ts|tsx|js|jsx)$|(^|/)test_') AS is_test
FROM (SELECT page_id, regexp_extract(url, '^https?://([^?#]*)', 1) || (['_test.go', '.spec.ts', '/test_x.rb', '.go'])[page_id % 4 + 1] AS p FROM pages)""")
def _test_file(spark: SparkSession, d: str) -> DataFrame:
    tail = F.element_at(F.array(*map(F.lit, ["_test.go", ".spec.ts", "/test_x.rb", ".go"])), (F.col("page_id") % 4 + 1).cast("int"))
    path = F.concat(F.regexp_extract("url", "^https?://([^?#]*)", 1), tail)
    return table(spark, d, "pages").select("page_id", fn.is_test_file(path).alias("is_test"))


@_query("path_parts", r"""SELECT page_id, split_part(p, '/', 1) AS top, list_extract(string_split(p, '/'), -1) AS last, split_part(p, '.', 1) AS root
FROM (SELECT page_id, regexp_extract(url, '^https?://([^?#]*)', 1) AS p FROM pages)""")
def _path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = F.regexp_extract("url", "^https?://([^?#]*)", 1)
    return table(spark, d, "pages").select("page_id", fn.top_level_dir(p).alias("top"), fn.last_segment(p).alias("last"), fn.first_dotted(p).alias("root"))


@_query("documents_by_kind", "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2")
def _by_kind(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("lang", "source", F.char_length("text").alias("c")).groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("c").alias("chars"))


_EXT = "(['.go', '.py', '.min.js', '.yaml', '.md', '.bin', '.TSX', '.rb'])[page_id % 8 + 1]"
_PATHS = f"""paths AS (SELECT page_id, 'src/' || (['a', 'node_modules', 'b/vendor', 'lib', 'gen'])[page_id % 5 + 1] || '/' || page_id || {_EXT} AS path FROM pages)"""


def _paths(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, [".go", ".py", ".min.js", ".yaml", ".md", ".bin", ".TSX", ".rb"])), (F.col("page_id") % 8 + 1).cast("int"))
    folder = F.element_at(F.array(*map(F.lit, ["a", "node_modules", "b/vendor", "lib", "gen"])), (F.col("page_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("src/"), folder, F.lit("/"), F.col("page_id").cast("string"), ext)
    return table(spark, d, "pages").select("page_id", path.alias("path"))


@_query("scan_filter", rf"""WITH {_PATHS} SELECT page_id, path FROM paths WHERE len(list_intersect(string_split(path, '/'), ['node_modules', 'vendor'])) = 0
AND NOT regexp_matches(path, '(^|/)gen/') AND NOT regexp_matches(path, '[0-9]*7\.py$')""")
def _scan_filter(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).where(files.wanted(F.col("path"), files.ScanOptions(exclude=["*7.py"]), ["gen/", "# none", "!kept"]))


@_query("language_and_kind", rf"""WITH {_PATHS}, e AS (SELECT page_id, path, lower(regexp_extract(path, '\.([^./]+)$', 1)) AS ext FROM paths)
SELECT page_id, CASE ext WHEN 'go' THEN 'go' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'tsx' THEN 'tsx' WHEN 'rb' THEN 'ruby' END AS language,
CASE WHEN contains(path, '.min.') THEN NULL WHEN ext = 'yaml' THEN 'yaml' WHEN ext = 'md' THEN 'markdown' END AS doc_kind FROM e""")
def _language_and_kind(spark: SparkSession, d: str) -> DataFrame:
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    p = _paths(spark, d)
    return p.select("page_id", known[fn.extension(F.col("path"))].alias("language"), files.doc_kind(F.col("path")).alias("doc_kind"))


@_query("change_filter", rf"""WITH {_PATHS}, ev AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'src/.reindex-queue' ELSE path END AS path, (['write', 'remove', 'create'])[page_id % 3 + 1] AS op FROM paths)
SELECT page_id, path, CASE WHEN path LIKE '%.reindex-queue' THEN 'full' WHEN op = 'remove' THEN 'delete' ELSE 'upsert' END AS op FROM ev
WHERE (path LIKE '%.reindex-queue' AND op != 'remove') OR (regexp_matches(lower(path), '\.(go|py|yaml|md|tsx|rb)$') AND len(list_intersect(string_split(path, '/'), ['node_modules', 'vendor'])) = 0)""")
def _change_filter(spark: SparkSession, d: str) -> DataFrame:
    op = F.element_at(F.array(*map(F.lit, ["write", "remove", "create"])), (F.col("page_id") % 3 + 1).cast("int"))
    path = F.when(F.col("page_id") % 11 == 0, "src/.reindex-queue").otherwise(F.col("path"))
    return relevant(_paths(spark, d).withColumn("path", path).withColumn("op", op))


@_query("listing_changes", """WITH a AS (SELECT p_partkey AS k, p_size AS m FROM part WHERE p_type != 'PROMO'), b AS (SELECT p_partkey AS k, CASE WHEN p_brand = 'Brand#7' THEN p_size + 1 ELSE p_size END AS m FROM part WHERE p_type != 'LARGE')
SELECT coalesce(a.k, b.k)::VARCHAR AS path, CASE WHEN b.k IS NULL THEN 'delete' ELSE 'upsert' END AS op FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.m != b.m""")
def _listing_changes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("path"), "p_size", "p_type", "p_brand")
    before = p.where("p_type != 'PROMO'").select("path", F.col("p_size").alias("modified"))
    after = p.where("p_type != 'LARGE'").select("path", F.when(F.col("p_brand") == "Brand#7", F.col("p_size") + 1).otherwise(F.col("p_size")).alias("modified"))
    return listing_changes(before, after)


@_query("file_summaries", f"""WITH {SYM}, {EDGE}, f AS (SELECT file_path, count(*) FILTER (kind NOT LIKE 'type/%') AS functions, count(*) FILTER (kind LIKE 'type/%') AS types FROM sym GROUP BY 1),
c AS (SELECT s.file_path, count(*) AS calls FROM edge JOIN sym s ON s.id = caller_id GROUP BY 1) SELECT file_path, functions, types, coalesce(calls, 0) AS calls FROM f LEFT JOIN c USING (file_path)""")
def _file_summaries(spark: SparkSession, d: str) -> DataFrame:
    s = symbols(spark, d)
    is_type = F.col("kind").startswith("type/")
    made = calls(spark, d).join(s.select(F.col("id").alias("caller_id"), F.col("file_path").alias("f")), "caller_id").select(F.col("f").alias("file_path"))
    out = aggregates.file_summaries(s.where(~is_type), s.where(is_type), made)
    return out.select("file_path", F.col("function_count").alias("functions"), F.col("type_count").alias("types"), F.col("import_count").alias("calls"))


@_query("impact_both_ways", f"""WITH {SYM}, {EDGE}, e AS (SELECT callee_id AS up, caller_id AS down FROM edge WHERE resolution != 'interface-dispatch' AND callee_id IS NOT NULL AND callee_id != caller_id),
s AS (SELECT id FROM sym WHERE file_path = 'Brand#7/PROMO'), u AS (SELECT DISTINCT down AS id FROM e JOIN s ON s.id = e.up UNION SELECT DISTINCT up FROM e JOIN s ON s.id = e.down)
SELECT DISTINCT file_path AS file, name AS symbol, 1 AS depth FROM u JOIN sym USING (id)""")
def _impact_both(spark: SparkSession, d: str) -> DataFrame:
    return graph.impact(symbols(spark, d), calls(spark, d), _seeds(spark, d), 1, "both").select("file", "symbol", "depth")


@_query("path_suffix_match", """WITH f AS (SELECT DISTINCT 'lib/' || p_brand || '/' || p_type AS path FROM part), e(want) AS (VALUES ('Brand#7/PROMO'), ('PROMO'), ('x/lib/Brand#3/SMALL'), ('d#3/SMALL'))
SELECT path, want FROM f, e WHERE path = want OR ends_with(path, '/' || want) OR ends_with(want, '/' || path)""")
def _path_suffix(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "part").select(F.concat_ws("/", F.lit("lib"), "p_brand", "p_type").alias("path"))
    want = spark.createDataFrame([("Brand#7/PROMO",), ("PROMO",), ("x/lib/Brand#3/SMALL",), ("d#3/SMALL",)], "want string")
    return evaluate.match_paths(found, want)


_LINES = """ln AS (SELECT o_custkey::VARCHAR AS path, o_orderkey AS line, CASE WHEN o_orderpriority LIKE '1%' THEN 'from m import f' || o_orderkey % 7 || ' as g' || o_orderkey % 7
  WHEN o_orderpriority LIKE '2%' THEN 'x = g' || o_orderkey % 7 || '(1)' ELSE 'pass' END AS text FROM orders)"""


@_query("alias_hits", rf"""WITH {_LINES}, i AS (SELECT DISTINCT path, regexp_extract(text, 'import (\w+) as', 1) AS name, regexp_extract(text, ' as (\w+)', 1) AS alias FROM ln WHERE text LIKE '%import%')
SELECT ln.path, line, name FROM ln JOIN i ON i.path = ln.path AND text LIKE 'x = %' AND regexp_extract(text, '(\w+)\(', 1) = alias""")
def _alias_hits(spark: SparkSession, d: str) -> DataFrame:
    k, p = (F.col("o_orderkey") % 7).cast("string"), F.col("o_orderpriority")
    text = F.when(p.startswith("1"), F.concat(F.lit("from m import f"), k, F.lit(" as g"), k)).when(p.startswith("2"), F.concat(F.lit("x = g"), k, F.lit("(1)"))).otherwise("pass")
    return evaluate.alias_hits(table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").alias("line"), text.alias("text")))


@_query("scenario_coverage", """WITH c AS (SELECT conv_id, list(turn || CASE role WHEN 'user' THEN '.go' WHEN 'assistant' THEN '.PY' ELSE '.zig' END) AS fs FROM conversations GROUP BY 1)
SELECT 'k' || conv_id % 5 AS task_category, count(*) AS scenarios, sum(len(fs))::BIGINT AS files, sum(len([f for f in fs if NOT f LIKE '%.zig']))::BIGINT AS known, count(*) FILTER (len([f for f in fs if f LIKE '%.zig']) = 0) AS fully FROM c GROUP BY 1""")
def _coverage(spark: SparkSession, d: str) -> DataFrame:
    ext = F.when(F.col("role") == "user", ".go").when(F.col("role") == "assistant", ".PY").otherwise(".zig")
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.concat(F.col("turn").cast("string"), ext)).alias("context_files"))
    return evaluate.coverage(c.withColumn("task_category", F.concat(F.lit("k"), (F.col("conv_id") % 5).cast("string"))), EXTENSIONS)


@_query("key_drift", """WITH e AS (SELECT o_custkey AS task_id, list_sort(list(DISTINCT o_orderpriority)) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), g AS (SELECT o_custkey AS task_id, list_sort(list(DISTINCT o_orderpriority)) AS b FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT coalesce(e.task_id, g.task_id) AS task_id, array_to_string(a, ',') AS expected, array_to_string(b, ',') AS actual FROM e FULL JOIN g ON e.task_id = g.task_id WHERE a IS DISTINCT FROM b""")
def _key_drift(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("task_id"), "o_orderstatus", "o_orderpriority")

    def keys(status: str) -> DataFrame:
        return o.where(F.col("o_orderstatus") == status).groupBy("task_id").agg(F.collect_set("o_orderpriority").alias("symbols"))  # at most five values

    out = evaluate.key_drift(keys("F"), keys("O"))
    return out.select("task_id", F.array_join("a", ",").alias("expected"), F.array_join("b", ",").alias("actual"))


@_query("quality_mapping", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 WHEN o_orderstatus = 'O' THEN o_custkey % 10 / 10.0 WHEN o_custkey % 3 > 0 THEN 1.0 / (o_custkey % 3) ELSE 0.0 END::DOUBLE AS quality FROM orders""")
def _quality(spark: SparkSession, d: str) -> DataFrame:
    o, most = table(spark, d, "orders"), F.col("o_custkey") % 3
    f1 = F.when(F.col("o_orderstatus") == "O", F.col("o_custkey") % 10 / F.lit(10.0))
    return o.select("o_orderkey", evaluate.quality(F.col("o_orderstatus") == "F", f1, F.lit(1.0), most).cast("double").alias("quality"))


@_query("mentioned_files", r"""SELECT item_id, array_to_string(list_distinct_ordered, ',') AS files FROM (SELECT item_id, [x for x, i in m if list_position(m, x) = i] AS list_distinct_ordered
FROM (SELECT item_id, regexp_extract_all('see src/a' || item_id || '.go and b.py, then src/a' || item_id || '.go; ' || text, '[A-Za-z0-9_./-]+\.(?:go|py|ts|tsx|js|jsx|rs|java|c|cpp|h|rb|swift)\b') AS m FROM benchmark))""")
def _mentioned(spark: SparkSession, d: str) -> DataFrame:
    a = F.concat(F.lit("src/a"), F.col("item_id").cast("string"), F.lit(".go"))
    prose = F.concat(F.lit("see "), a, F.lit(" and b.py, then "), a, F.lit("; "), "text")
    return table(spark, d, "benchmark").select("item_id", F.array_join(fn.paths_in_text(prose), ",").alias("files"))


@_query("json_fields", "SELECT event_type, sum((props->>'k')::BIGINT)::BIGINT AS total, count(*) AS n FROM events GROUP BY 1")
def _json_fields(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("total"), F.count("*").alias("n"))


@_query("location_and_truncation", "SELECT doc_id, source || ':' || n_chars AS place, CASE WHEN length(text) > 160 THEN left(text, 160) || '...' ELSE text END AS head FROM documents")
def _location(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", fn.location(F.col("source"), F.col("n_chars")).alias("place"), fn.truncated(F.col("text"), 160).alias("head"))


# ----------------------------------------------------------------------- rows only: parsing, snippets, statistics


@_query("search_snippets")
def _snippets(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    q = search.understood("the ther")
    top = search.best(search.bm25(_post(spark, d), search.lengths(docs, ["text"], "doc_id"), q, {"text": 1.0}), 30)
    rows = top.join(docs.withColumnRenamed("doc_id", "id"), "id").select("id", F.round("rank", 9).alias("rank"), "text")
    return search.with_snippets(rows, "text", q).select("id", "rank", "snippet")


_BOOT = 200


@_query("bootstrap_interval", f"""WITH RECURSIVE r AS (SELECT c_nationkey, o_orderstatus, avg(o_totalprice) AS price FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
p AS (SELECT c_nationkey, max(price) FILTER (o_orderstatus = 'F') AS a, max(price) FILTER (o_orderstatus = 'O') AS b FROM r GROUP BY 1 HAVING a IS NOT NULL AND b IS NOT NULL),
x AS (SELECT row_number() OVER (ORDER BY c_nationkey) - 1 AS i, b - a AS delta FROM p), n AS (SELECT count(*) AS n FROM x),
rng(k, s) AS (SELECT 0, (4::UHUGEINT * 6364136223846793005 + 3) % 18446744073709551616 UNION ALL SELECT k + 1, (s * 6364136223846793005 + 3) % 18446744073709551616 FROM rng, n WHERE k + 1 < {_BOOT} * n),
o AS (SELECT k, ((xor(s::UBIGINT >> 18, s::UBIGINT) >> 27) & 4294967295::UBIGINT) AS v, (s::UBIGINT >> 59)::INT AS rot FROM rng),
w AS (SELECT k, (((v >> rot) | ((v << ((32 - rot) & 31)) & 4294967295::UBIGINT)))::BIGINT AS draw FROM o),
m AS (SELECT k // n AS it, median(delta) AS m FROM w, n JOIN x ON x.i = draw % n GROUP BY 1), l AS (SELECT list(m ORDER BY m) AS m FROM m)
SELECT round(m[{int(0.05 / 2 * _BOOT) + 1}], 6) AS low, round(m[{int(0.975 * _BOOT) + 1}], 6) AS high FROM l""")
def _bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the median difference between two order states over nations: each nation is one task with both arms."""
    nation = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    runs = table(spark, d, "orders").join(nation, "o_custkey").groupBy("c_nationkey", "o_orderstatus").agg(F.avg("o_totalprice").alias("price"))
    pairs = evaluate.paired(runs, "c_nationkey", "o_orderstatus", "price", ("F", "O"))
    deltas = [r["delta"] for r in pairs.orderBy("c_nationkey").select("delta").collect()]  # one row a nation
    return evaluate.bootstrap_ci(deltas, _BOOT, spark=spark).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
