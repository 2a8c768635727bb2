"""Call resolution: every call site gets a callee (or none) and a confidence marker by joins against small lookups.

All lookups are keyed aggregates of the symbol tables.  Sites are parted by the kind of their receiver, and each part meets
only the lookups that its rule needs, so no site moves for a lookup that can't decide it.  The joins are plain equi-joins:
Spark broadcasts a lookup while it is small and shuffles beyond that; ``build_calls`` counts its tables for this (``bounded``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.operators.aggregates import first_nonempty, innermost, sole_value
from codequarry.operators.graph import dispatch_edges, implements, inheritance_closure
from codequarry.schema import BUILTINS, TYPED_LANGUAGES
from codequarry.session import bounded, cut

_ORDER = ("file_path", "start_line", "id")


def _is_method() -> Column:
    return (F.col("kind") == "method") & (F.coalesce("receiver_type", F.lit("")) != "")


def _counted(df: DataFrame, *keys: str) -> DataFrame:
    """n, id and file of the definitions of each key; the first in file order."""
    first = F.min_by(F.struct("id", "file_path"), F.struct(*_ORDER))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), first.alias("d")).select(*keys, "n", F.col("d.id").alias("id"), F.col("d.file_path").alias("file"))


def method_table(functions: DataFrame, bases: DataFrame) -> DataFrame:
    """(type, name, id): the method that a type has or inherits.

    Breadth first over the bases in declared order; the first type with exactly one definition wins, and a type with
    several is passed over.
    """
    own = _counted(functions.where(_is_method()), "receiver_type", "name").where("n = 1")
    up = inheritance_closure(bases).select(F.col("class_name").alias("type"), "ancestor", "level", "path")
    self_ = own.select(F.col("receiver_type").alias("type"), "name", "id", F.lit(0).alias("level"), F.array().cast("array<int>").alias("path"))
    inherited = up.join(own, up["ancestor"] == own["receiver_type"]).select("type", "name", "id", "level", "path")
    return self_.unionByName(inherited).groupBy("type", "name").agg(F.min_by("id", F.struct("level", "path")).alias("id"))


def repo_roots(functions: DataFrame) -> DataFrame:
    """Names by which files of the tree can be imported: the first folder, or the stem of a file at the top."""
    p = F.col("file_path")
    root = F.when(F.instr(p, "/") > 0, F.substring_index(p, "/", 1)).otherwise(F.regexp_replace(p, r"\.[^.]*$", ""))
    return functions.select(root.alias("root")).distinct()


def _builtin() -> Column:
    """Never null, so that it can be negated."""
    out = F.lit(False)
    for lang, names in BUILTINS.items():
        out = out | ((F.col("language") == lang) & F.col("callee_name").isin(names))
    return F.coalesce(out, F.lit(False))


def resolve_calls(
    sites: DataFrame, functions: DataFrame, types: DataFrame, bases: DataFrame, fields: DataFrame, variables: DataFrame,
    methods: DataFrame | None = None, roots: DataFrame | None = None,
) -> DataFrame:
    """Adds callee_id and resolution to *materialized* call sites (with package: the scope that they stand in); methods, roots: where the functions' own are written already."""
    columns, roots = sites.columns, repo_roots(functions) if roots is None else roots
    top = functions.where(~_is_method())
    by_package = _counted(top, "package", "name").where("n = 1").select(F.col("package").alias("p_pkg"), F.col("name").alias("p_name"), F.col("id").alias("p_id"), F.col("file").alias("p_file"))
    classes = types.where(F.col("kind").isin("class", "struct", "type", "interface")).select(F.col("name").alias("c_name")).distinct()
    kind, callee = F.col("receiver_kind"), F.col("callee_name")
    s = sites.withColumn("receiver_kind", F.coalesce("receiver_kind", F.lit("")))
    is_typed = F.coalesce(F.col("language").isin(TYPED_LANGUAGES), F.lit(False))
    is_bare = (kind == "") & (F.coalesce("receiver_name", F.lit("")) == "")
    on_type_kinds = ["var", "field", "maybe-global", "from-callee"]

    def found(rows: DataFrame, target: Column | None, marker: Column) -> DataFrame:
        return rows.select(*columns, (F.lit(None).cast("long") if target is None else target).alias("callee_id"), marker.alias("resolution"))

    # languages without hints
    by_name = _counted(functions, "name").select(F.col("name").alias("n_name"), F.col("id").alias("n_id"))
    out = found(s.where(~is_typed).join(by_name, callee == F.col("n_name"), "left"), F.col("n_id"), F.lit("name-global"))
    typed = s.where(is_typed)
    # an imported package's functions
    own = typed.where(kind == "import").join(by_package, (F.col("receiver_package") == F.col("p_pkg")) & (callee == F.col("p_name")), "left")
    out = out.unionByName(found(own, F.col("p_id"), F.when(F.col("p_id").isNotNull(), "cross-package").otherwise("import-qualified")))
    # methods on a receiver's type, which each kind knows in its own way
    field = sole_value(fields, ["struct_type", "field_name"], "field_type").select(F.col("struct_type").alias("f_struct"), F.col("field_name").alias("f_name"), F.col("field_type").alias("on_type"))
    glob = sole_value(variables, ["package", "name"], "var_type").select(F.col("package").alias("g_pkg"), F.col("name").alias("g_name"), F.col("var_type").alias("on_type"))
    returns = first_nonempty(functions.withColumn("_o", F.struct(*_ORDER)), ["package", "name"], "return_type", "_o")
    returns = returns.select(F.col("package").alias("r_pkg"), F.col("name").alias("r_fn"), F.col("return_type").alias("r_type"))
    made = typed.where(kind == "from-callee").join(classes, F.col("receiver_from_callee") == F.col("c_name"), "left")
    made = made.join(returns, (F.col("package") == F.col("r_pkg")) & (F.col("receiver_from_callee") == F.col("r_fn")), "left")
    known = [
        typed.where(kind == "var").withColumn("on_type", F.col("receiver_type")),
        typed.where(kind == "field").join(field, (F.col("receiver_type") == F.col("f_struct")) & (F.col("receiver_field") == F.col("f_name")), "left"),
        typed.where(kind == "maybe-global").join(glob, (F.col("package") == F.col("g_pkg")) & (F.col("receiver_name") == F.col("g_name")), "left"),
        made.withColumn("on_type", F.coalesce("c_name", "r_type")),
    ]
    methods = (method_table(functions, bases) if methods is None else methods).select(F.col("type").alias("m_type"), F.col("name").alias("m_name"), F.col("id").alias("m_id"))
    on_type = reduce(DataFrame.unionByName, [k.select(*columns, "on_type") for k in known])
    on_type = on_type.join(methods, (F.col("on_type") == F.col("m_type")) & (callee == F.col("m_name")), "left")
    out = out.unionByName(found(on_type, F.col("m_id"), F.when(F.col("m_id").isNotNull(), "receiver-typed").otherwise("unresolved")))
    # bare calls
    bare = typed.where(is_bare)
    out = out.unionByName(found(bare.where(_builtin()), None, F.lit("builtin")))
    by_top = _counted(top, "name").where("n = 1").select(F.col("name").alias("t_name"), F.col("id").alias("t_id"))
    bare = bare.where(~_builtin()).join(classes, callee == F.col("c_name"), "left")
    bare = bare.join(by_package, (F.col("package") == F.col("p_pkg")) & (callee == F.col("p_name")), "left")
    bare = bare.join(by_top, F.col("imported_origin") == F.col("t_name"), "left").join(roots, F.col("imported_module_root") == F.col("root"), "left")
    linked = F.col("t_id").isNotNull() & ((F.col("imported_module_root") == "") | F.col("root").isNotNull())
    marker = (
        F.when(F.col("c_name").isNotNull(), "constructor")
        .when(F.col("p_id").isNotNull(), F.when(F.col("p_file") == F.col("file_path"), "same-file").otherwise("same-package"))
        .when(linked, "import-symbol").otherwise("unresolved")
    )
    target = F.when(marker.isin("same-file", "same-package"), F.col("p_id")).when(marker == "import-symbol", F.col("t_id"))
    out = out.unionByName(found(bare, target, marker))
    # whatever else has a receiver
    return out.unionByName(found(typed.where(~is_bare & ~kind.isin("import", *on_type_kinds)), None, F.lit("unresolved")))


def attach_callers(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """Adds caller_id and the caller's package; sites outside any function go."""
    keyed = sites.withColumn("point_id", F.xxhash64("file_path", "line", "ord"))
    spans = functions.select("id", "file_path", "start_line", "end_line")
    inside = innermost(keyed.select("point_id", "file_path", "line"), spans).select("point_id", F.col("span_id").alias("caller_id"))
    scope = functions.select(F.col("id").alias("caller_id"), "package")
    return keyed.join(inside, "point_id").join(scope, "caller_id").drop("point_id")


def build_calls(sites: DataFrame, functions: DataFrame, types: DataFrame, bases: DataFrame, fields: DataFrame, variables: DataFrame) -> DataFrame:
    """The call table: one resolved edge per site, and the interface dispatch edges."""
    given = functions
    sites, functions, types, bases, fields, variables = bounded(sites, functions, types, bases, fields, variables)
    own, written = cut(attach_callers(sites, functions), "sites"), []
    if functions is not given:  # methods come from a union, which bears no mark; the roots are few, with many sites each
        written = bounded(cut(method_table(functions, bases), "methods"), cut(repo_roots(functions), "roots"))
    plain = resolve_calls(own, functions, types, bases, fields, variables, *written)
    wanted = types.where("kind = 'interface'").select(F.col("name").alias("iface"), F.explode("methods").alias("method"))
    methods = functions.where(_is_method()).select(F.col("receiver_type").alias("type"), F.col("name").alias("method"), "id")
    extra = dispatch_edges(bounded(own)[0], implements(methods, wanted), methods)
    columns = ["caller_id", "callee_id", "callee_name", "file_path", "line", "resolution", "receiver_name"]
    return plain.select(*columns).unionByName(extra.select(*columns))


def affected_sites(sites: DataFrame, before: DataFrame, after: DataFrame, types_before: DataFrame, types_after: DataFrame) -> DataFrame:
    """Call sites that a change of definitions may resolve otherwise: those that name a changed symbol, type or import root in any role."""
    key = ["id", "name", "file_path", "receiver_type", "package", "return_type", "kind"]

    def differing(a: DataFrame, b: DataFrame, columns: list[str], out: list[str]) -> DataFrame:
        both = a.select(*columns, F.lit(1).alias("_n")).unionByName(b.select(*columns, F.lit(-1).alias("_n")))
        moved = both.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n != 0")
        return moved.select(F.explode(F.array(*out)).alias("x"))

    names = differing(before, after, key, ["name", "receiver_type"]).unionByName(differing(types_before, types_after, ["name", "kind", "file_path"], ["name"]))
    names = names.unionByName(differing(repo_roots(before), repo_roots(after), ["root"], ["root"]))
    names = names.where("x IS NOT NULL").distinct()
    roles = F.array("callee_name", "imported_origin", "receiver_type", "receiver_from_callee", "imported_module_root")
    hit = sites.withColumn("_k", F.xxhash64("file_path", "line", "ord")).select("_k", F.explode(roles).alias("x")).join(names, "x", "left_semi").select("_k").distinct()
    return sites.withColumn("_k", F.xxhash64("file_path", "line", "ord")).join(hit, "_k", "left_semi").drop("_k")
