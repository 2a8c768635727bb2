"""Registered queries of call resolution: the resolver over the driver's tables in the roles of symbols and call sites.

``part`` plays the functions, ``nation`` the types and their bases, ``supplier`` the struct fields, ``customer`` the package
variables, ``lineitem`` the call sites.  Each rule has a query over the sites that it decides, and an SQL form written from
the rules, not from the operator's plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators import resolve
from codequarry.plans.views import table
from codequarry.schema import BUILTINS, TYPED_LANGUAGES
from codequarry.session import cut

_NAMES, _TYPES = 53, 25
_LANGUAGES = ["go", "python", "typescript", "rust"]
_KINDS = ["import", "var", "from-callee", "field", "maybe-global", "unresolved-field", "", ""]

#: Both forms share these expressions, which read alike in either dialect; ``LANG`` and ``KIND`` are picks from a list.
_FUNCTION = f"""p_partkey + 1 AS id, concat('f', p_partkey % {_NAMES}) AS name, concat(p_brand, '/', p_partkey % 5, '.go') AS file_path, p_size AS start_line,
p_brand AS package, CASE WHEN p_partkey % 3 = 0 THEN 'method' ELSE 'func' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN concat('T', p_partkey % {_TYPES}) ELSE '' END AS receiver_type,
CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('T', p_partkey % 11) END AS return_type"""
_TYPE = "concat('T', n_nationkey) AS name, CASE n_nationkey % 4 WHEN 0 THEN 'interface' WHEN 1 THEN 'class' WHEN 2 THEN 'struct' ELSE 'enum' END AS kind, 'types.go' AS file_path"
_FIELD = f"concat('T', s_suppkey % {_TYPES}) AS struct_type, concat('x', s_suppkey % 40) AS field_name, concat('T', s_nationkey) AS field_type"
_VARIABLE = "concat('v', c_custkey % 29) AS name, concat('Brand#', c_custkey % 25 + 1) AS package, concat('T', c_nationkey % 7) AS var_type"
_SITE = f"""concat('Brand#', l_partkey % 25 + 1) AS package, concat('Brand#', l_partkey % 25 + 1, '/', l_suppkey % 5, '.go') AS file_path, l_orderkey AS line, l_linenumber AS ord,
LANG AS language, KIND AS receiver_kind,
CASE WHEN (l_orderkey + l_linenumber) % 8 < 6 THEN concat('f', l_partkey % {_NAMES}) WHEN l_suppkey % 5 = 0 THEN 'len' WHEN l_suppkey % 5 = 1 THEN concat('T', l_partkey % {_TYPES}) ELSE concat('f', l_partkey % {_NAMES}) END AS callee_name,
CASE WHEN (l_orderkey + l_linenumber) % 8 = 4 THEN concat('v', l_suppkey % 29) WHEN l_linenumber = 5 THEN 'r' ELSE '' END AS receiver_name,
concat('T', l_suppkey % {_TYPES}) AS receiver_type, concat('x', l_suppkey % 40) AS receiver_field,
CASE WHEN l_suppkey % 2 = 0 THEN concat('T', l_suppkey % {_TYPES}) ELSE concat('f', l_suppkey % {_NAMES}) END AS receiver_from_callee,
concat('Brand#', l_suppkey % 25 + 1) AS receiver_package, CASE WHEN l_partkey % 2 = 0 THEN concat('f', l_suppkey % {_NAMES}) END AS imported_origin,
CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Brand#3' ELSE 'nowhere' END AS imported_module_root"""


def _site(pick: Callable[[list[str], str], str]) -> str:
    return _SITE.replace("LANG", pick(_LANGUAGES, "l_linenumber % 4")).replace("KIND", pick(_KINDS, "(l_orderkey + l_linenumber) % 8"))


def _pick(values: list[str], index: str) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def functions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr(*_columns(_FUNCTION))


def _columns(sql: str) -> list[str]:
    """The expressions of a select list (split at commas outside brackets)."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(sql):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(sql[at:i])
            at = i + 1
    return [*out, sql[at:]]


def _bases(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    steps = F.array(*(F.struct(F.lit(i).alias("ord"), (F.col("n_nationkey") + step).alias("to")) for i, step in enumerate((5, 3))))
    each = n.select("n_nationkey", F.explode(steps).alias("b")).where(f"b.to < {_TYPES}")
    return each.select(F.concat(F.lit("T"), "n_nationkey").alias("class_name"), F.concat(F.lit("T"), "b.to").alias("base_name"), "b.ord")


def sites(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(*_columns(_site(_pick)))


def _resolved(spark: SparkSession, d: str, rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    types = table(spark, d, "nation").selectExpr(*_columns(_TYPE))
    fields, variables = table(spark, d, "supplier").selectExpr(*_columns(_FIELD)), table(spark, d, "customer").selectExpr(*_columns(_VARIABLE))
    return resolve.resolve_calls(rows, functions(spark, d) if known is None else known, types, _bases(spark, d), fields, variables)


def _lists(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_BUILTIN = " OR ".join(f"(language = '{lang}' AND callee_name IN {_lists(names)})" for lang, names in BUILTINS.items())


def _rules(cut_off: str = "true") -> str:
    """CTEs up to ``r``: every site with callee_id and resolution; ``cut_off`` limits the functions."""
    return f"""WITH RECURSIVE fn AS (SELECT * FROM (SELECT {_FUNCTION} FROM part) WHERE {cut_off}), ty AS (SELECT {_TYPE} FROM nation), fi AS (SELECT {_FIELD} FROM supplier), va AS (SELECT {_VARIABLE} FROM customer),
ba AS (SELECT 'T' || n_nationkey AS c, 'T' || (n_nationkey + s) AS b, o AS ord FROM nation, (VALUES (0, 5), (1, 3)) v(o, s) WHERE n_nationkey + s < {_TYPES}),
site AS (SELECT {_site(_pick)} FROM lineitem),
walk(t, a, level, path) AS (SELECT c, b, 1, [ord] FROM ba UNION ALL SELECT walk.t, ba.b, level + 1, list_append(path, ord) FROM walk JOIN ba ON ba.c = walk.a),
up AS (SELECT t, a, level, path FROM walk UNION ALL SELECT DISTINCT receiver_type, receiver_type, 0, []::INT[] FROM fn WHERE receiver_type != ''),
one AS (SELECT receiver_type AS t, name, min(id) AS id FROM fn WHERE kind = 'method' AND receiver_type != '' GROUP BY ALL HAVING count(*) = 1),
meth AS (SELECT up.t, one.name, arg_min(one.id, (level, path)) AS id FROM up JOIN one ON one.t = up.a GROUP BY ALL),
tops AS (SELECT * FROM fn WHERE kind != 'method'),
pk AS (SELECT package, name, min(id) AS id, min(file_path) AS file FROM tops GROUP BY ALL HAVING count(*) = 1),
tp AS (SELECT name, min(id) AS id FROM tops GROUP BY ALL HAVING count(*) = 1),
nm AS (SELECT name, arg_min(id, (file_path, start_line, id)) AS id FROM fn GROUP BY ALL),
re AS (SELECT package, name, arg_min(return_type, (file_path, start_line, id)) AS t FROM fn WHERE return_type != '' GROUP BY ALL),
fo AS (SELECT struct_type, field_name, min(field_type) AS t FROM fi GROUP BY ALL HAVING count(DISTINCT field_type) = 1),
go AS (SELECT package, name, min(var_type) AS t FROM va GROUP BY ALL HAVING count(DISTINCT var_type) = 1),
cl AS (SELECT DISTINCT name FROM ty WHERE kind IN ('class', 'struct', 'type', 'interface')),
rt AS (SELECT DISTINCT CASE WHEN contains(file_path, '/') THEN split_part(file_path, '/', 1) ELSE regexp_replace(file_path, '[.][^.]*$', '') END AS root FROM fn),
hint AS (SELECT site.*, CASE receiver_kind
  WHEN 'var' THEN receiver_type
  WHEN 'field' THEN (SELECT t FROM fo WHERE struct_type = receiver_type AND field_name = receiver_field)
  WHEN 'maybe-global' THEN (SELECT t FROM go WHERE go.package = site.package AND go.name = receiver_name)
  WHEN 'from-callee' THEN CASE WHEN receiver_from_callee IN (SELECT name FROM cl) THEN receiver_from_callee
    ELSE (SELECT t FROM re WHERE re.package = site.package AND re.name = receiver_from_callee) END END AS on_type FROM site),
v AS (SELECT h.*, m.id AS m_id, i.id AS i_id, p.id AS p_id, p.file AS p_file, nm.id AS n_id, CASE WHEN imported_module_root = '' OR imported_module_root IN (SELECT root FROM rt) THEN tp.id END AS t_id
  FROM hint h LEFT JOIN meth m ON m.t = on_type AND m.name = callee_name LEFT JOIN pk i ON i.package = receiver_package AND i.name = callee_name
  LEFT JOIN pk p ON p.package = h.package AND p.name = callee_name LEFT JOIN nm ON nm.name = callee_name LEFT JOIN tp ON tp.name = imported_origin),
w AS (SELECT *, CASE
  WHEN language NOT IN {_lists(TYPED_LANGUAGES)} THEN 'name-global'
  WHEN receiver_kind = 'import' THEN CASE WHEN i_id IS NULL THEN 'import-qualified' ELSE 'cross-package' END
  WHEN receiver_kind IN ('var', 'field', 'maybe-global', 'from-callee') THEN CASE WHEN m_id IS NULL THEN 'unresolved' ELSE 'receiver-typed' END
  WHEN receiver_kind != '' OR receiver_name != '' THEN 'unresolved' WHEN {_BUILTIN} THEN 'builtin' WHEN callee_name IN (SELECT name FROM cl) THEN 'constructor'
  WHEN p_id IS NOT NULL THEN CASE WHEN p_file = file_path THEN 'same-file' ELSE 'same-package' END
  WHEN t_id IS NOT NULL THEN 'import-symbol' ELSE 'unresolved' END AS resolution FROM v),
r AS (SELECT * EXCLUDE (on_type, m_id, i_id, p_id, p_file, n_id, t_id), CASE resolution WHEN 'name-global' THEN n_id WHEN 'cross-package' THEN i_id WHEN 'receiver-typed' THEN m_id
  WHEN 'same-file' THEN p_id WHEN 'same-package' THEN p_id WHEN 'import-symbol' THEN t_id END AS callee_id FROM w)"""


_TYPED = f"language IN {_lists(TYPED_LANGUAGES)}"
#: Query -> the sites that its rule decides.
RULES = {
    "resolve_import": f"{_TYPED} AND receiver_kind = 'import'",
    "resolve_receiver_var": f"{_TYPED} AND receiver_kind = 'var'",
    "resolve_from_callee": f"{_TYPED} AND receiver_kind = 'from-callee'",
    "resolve_field": f"{_TYPED} AND receiver_kind = 'field'",
    "resolve_global": f"{_TYPED} AND receiver_kind = 'maybe-global'",
    "resolve_other_receiver": f"{_TYPED} AND (receiver_kind = 'unresolved-field' OR receiver_kind = '' AND receiver_name != '')",
    "resolve_bare": f"{_TYPED} AND receiver_kind = '' AND receiver_name = ''",
    "resolve_name_global": f"NOT {_TYPED}",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _name, _where in RULES.items():
    QUERIES[_name] = lambda spark, d, where=_where: _resolved(spark, d, sites(spark, d).where(where))
    SQL[_name] = f"{_rules()} SELECT * FROM r WHERE {_where}"

QUERIES["resolve_all"] = lambda spark, d: _resolved(spark, d, sites(spark, d)).groupBy("language", "receiver_kind", "resolution").agg(
    F.count("*").alias("n"), F.count("callee_id").alias("found")
)
SQL["resolve_all"] = f"{_rules()} SELECT language, receiver_kind, resolution, count(*) AS n, count(callee_id) AS found FROM r GROUP BY ALL"

QUERIES["method_on_type"] = lambda spark, d: resolve.method_table(functions(spark, d), _bases(spark, d))
SQL["method_on_type"] = f"{_rules()} SELECT t AS type, name, id FROM meth"

QUERIES["import_gate_semi"] = lambda spark, d: resolve.repo_roots(functions(spark, d))
SQL["import_gate_semi"] = f"{_rules()} SELECT root FROM rt"

_GONE = "package IN ('Brand#3', 'Brand#7')"


def _delta(spark: SparkSession, d: str) -> DataFrame:
    """Functions of two packages go: sites that name them are resolved again, the others keep what they had."""
    rows, old = cut(sites(spark, d), "resolution-sites"), functions(spark, d)
    new, none = old.where(f"NOT {_GONE}"), old.where("false").withColumn("file_path", F.lit("").cast("string"))
    types = table(spark, d, "nation").selectExpr(*_columns(_TYPE))
    again = cut(resolve.affected_sites(rows, old.where(_GONE), none, types, types), "resolution-again")
    kept = _resolved(spark, d, rows, old).join(again.select("file_path", "line", "ord").distinct(), ["file_path", "line", "ord"], "left_anti")
    return kept.unionByName(_resolved(spark, d, again, new))


QUERIES["delta_resolution"] = _delta
SQL["delta_resolution"] = f"{_rules('NOT ' + _GONE)} SELECT * FROM r"
