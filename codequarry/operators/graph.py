"""Bounded walks over the call graph, PageRank and closures.

A walk to depth d is d joins; each level is made distinct and written before the next starts from it, so its rows are
bounded by the edges and never by the paths, and no level is computed twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions.text import is_test_file
from codequarry.operators.edges import confidence
from codequarry.session import bounded, cut

EXTERNAL = "(external)"
MAX_DEPTH, MAX_IMPACT = 5, 1000


def _clamp(x: int, lo: int, hi: int) -> int:
    return max(lo, min(hi, x))


def walk(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, depth, resolution, name) reached from seeds (id) along edges (src, dst, resolution, name), each level distinct.

    Nodes are met again at other depths, seeds included; ends without a node (null dst) stop there as id 0.
    """
    frontier, levels = seeds.select("id").distinct(), []
    for d in range(1, _clamp(depth, 1, MAX_DEPTH) + 1):
        met = edges.join(frontier.withColumnRenamed("id", "src"), "src").select(
            F.coalesce("dst", F.lit(0)).alias("id"), F.when(F.col("dst").isNull(), F.col("name")).alias("name"), "resolution", F.col("dst").isNull().alias("external")
        ).distinct()
        met = cut(met, "walk")
        levels.append(met.withColumn("depth", F.lit(d)))
        frontier = met.where(~F.col("external")).select("id").distinct()
    return reduce(DataFrame.unionByName, levels)


def call_chain(functions: DataFrame, calls: DataFrame, name: str, depth: int = 2, direction: str = "callers", min_confidence: str | None = None) -> DataFrame:
    """name, file_path, start_line, depth, resolution of callers or callees of all functions of that name."""
    seeds = functions.where(F.col("name") == name).select("id")
    kept = calls.where(confidence(F.col("resolution"), min_confidence))
    if direction == "callers":
        edges = kept.where("callee_id IS NOT NULL").select(F.col("callee_id").alias("src"), F.col("caller_id").alias("dst"), "resolution", F.lit(None).cast("string").alias("name"))
    else:
        edges = kept.select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"), "resolution", F.col("callee_name").alias("name"))
    met = walk(edges, seeds, depth)
    known = functions.select("id", F.col("name").alias("known"), "file_path", "start_line")
    inner = met.where(~F.col("external")).join(known, "id").select(F.col("known").alias("name"), "file_path", "start_line", "depth", "resolution")
    if direction == "callers":
        return inner.distinct()
    outer = met.where("external").select("name", F.lit(EXTERNAL).alias("file_path"), F.lit(None).cast("int").alias("start_line"), "depth", "resolution")
    return inner.unionByName(outer).distinct()


def capped(rows: DataFrame, limit: int = 50) -> DataFrame:
    """The nearest rows with the exact total."""
    total = rows.agg(F.count("*").alias("total"))
    top = rows.orderBy("depth", "name", "file_path", "start_line", "resolution").limit(_clamp(limit, 1, 200))
    return top.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > limit)  # a one-row side


def impact(
    functions: DataFrame, calls: DataFrame, seeds: DataFrame, depth: int = 2, direction: str = "callers", include_tests: bool = True,
    min_confidence: str | None = None,
) -> DataFrame:
    """What a change of the seed functions (id) reaches: one row per function at its least depth, with the seed and the marker it came by.

    Self-loops don't count.  Per level and function one row is kept (least via id, then marker), so the walk carries one row per node.
    """
    if direction == "both":
        up = impact(functions, calls, seeds, depth, "callers", include_tests, min_confidence)
        down = impact(functions, calls, seeds, depth, "callees", include_tests, min_confidence)
        both = up.withColumn("_o", F.lit(0)).unionByName(down.withColumn("_o", F.lit(1)))
        first = F.min_by(F.struct(*up.columns), F.struct("_o", "depth", "id"))
        return both.groupBy("file", "symbol").agg(first.alias("r")).select("r.*")
    kept = calls.where(confidence(F.col("resolution"), min_confidence)).where("callee_id IS NOT NULL AND callee_id != caller_id")
    src, dst = ("callee_id", "caller_id") if direction == "callers" else ("caller_id", "callee_id")
    edges = kept.select(F.col(src).alias("src"), F.col(dst).alias("id"), F.col("resolution").alias("via_resolution"))
    frontier = seeds.select(F.col("id"), F.col("id").alias("via_id")).distinct()
    levels = []
    for d in range(1, _clamp(depth, 1, MAX_DEPTH) + 1):
        step = cut(edges.join(frontier.withColumnRenamed("id", "src"), "src").groupBy("id").agg(F.min(F.struct("via_id", "via_resolution")).alias("v")), "impact")
        levels.append(step.select("id", F.lit(d).alias("depth"), "v.via_id", "v.via_resolution"))
        frontier = step.select("id", "v.via_id")
    met = reduce(DataFrame.unionByName, levels)
    least = met.groupBy("id").agg(F.min(F.struct("depth", "via_id", "via_resolution")).alias("m")).select("id", "m.*")
    known = functions.select("id", F.col("name").alias("symbol"), F.col("file_path").alias("file"), F.col("start_line").alias("line"), "kind")
    via = functions.select(F.col("id").alias("via_id"), F.col("name").alias("via"))
    out = least.join(known, "id").join(via, "via_id")
    if not include_tests:
        out = out.where(~is_test_file(F.col("file")))
    return out.select("id", "file", "symbol", "line", "depth", "via", "kind", "via_resolution")


def impact_stats(impacted: DataFrame, limit: int = MAX_IMPACT) -> DataFrame:
    """One row: symbols, greatest depth, whether the list is cut, and how many came by each marker."""
    each = impacted.groupBy("via_resolution").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))
    entries = F.array_sort(F.collect_list(F.struct("via_resolution", "n")))  # at most one entry per marker
    return each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("impacted_symbols"), F.coalesce(F.max("deepest"), F.lit(0)).alias("max_depth_reached"),
        (F.coalesce(F.sum("n"), F.lit(0)) > limit).alias("truncated"), F.map_from_entries(entries).alias("resolution_breakdown"),
    )


def pagerank(functions: DataFrame, calls: DataFrame, iterations: int = 30, damping: float = 0.85, epsilon: float | None = 1e-6) -> DataFrame:
    """(id, score).  Uniform start, the mass of functions without callees is spread evenly, self-loops and interface dispatch don't count,
    parallel edges do.  With ``epsilon`` it ends early once the scores move less than that in sum.

    Each step is one join over tables that were written, so its plan does not grow; one aggregate gives both the
    movement of the scores and the mass without callees for the next step.
    """
    ids = functions.select("id")
    edges = calls.where("callee_id IS NOT NULL AND callee_id != caller_id AND resolution != 'interface-dispatch'")
    edges = edges.select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"))
    edges = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    weighted = edges.groupBy("src", "dst").agg(F.count("*").alias("w"))  # parallel edges become a weight
    degree = weighted.groupBy("src").agg(F.sum("w").alias("degree"))
    weighted = cut(weighted.join(degree, "src").select("src", "dst", (F.col("w") / F.col("degree")).alias("share")), "pagerank-edges")
    nodes = cut(ids.join(weighted.select(F.col("src").alias("id")).distinct().withColumn("calls", F.lit(True)), "id", "left"), "pagerank-nodes")
    n, ends = nodes.agg(F.count("*"), F.count_if(F.col("calls").isNull())).first()
    if n == 0:
        return ids.withColumn("score", F.lit(0.0))
    rank, dangling, base = nodes.withColumn("score", F.lit(1.0 / n)), ends / n, (1.0 - damping) / n
    for _ in range(iterations):
        into = weighted.join(rank.select(F.col("id").alias("src"), "score"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        score = F.lit(base) + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.lit(dangling / n))
        moved = rank.select("id", "calls", F.col("score").alias("before")).join(into, "id", "left")
        rank = cut(moved.select("id", "calls", "before", score.alias("score")), "pagerank")
        change, dangling = rank.agg(F.sum(F.abs(F.col("score") - F.col("before"))), F.coalesce(F.sum(F.when(F.col("calls").isNull(), F.col("score"))), F.lit(0.0))).first()
        if epsilon is not None and change < epsilon:
            break
    return rank.select("id", "score")


def file_scores(functions: DataFrame, ranks: DataFrame) -> DataFrame:
    return functions.select("id", "file_path").join(ranks, "id").groupBy("file_path").agg(F.sum("score").alias("score"))


def inheritance_closure(bases: DataFrame, max_levels: int = 20) -> DataFrame:
    """(class_name, ancestor, level): ancestors in breadth-first order, each at its first level; cycles end by an anti-join.

    ``path`` orders the ancestors of one level by declaration.
    """
    step = bases.select(F.col("class_name").alias("c"), F.col("base_name").alias("b"), "ord").distinct()
    now = bases.select("class_name", F.col("base_name").alias("ancestor"), F.array("ord").alias("path"))
    now = now.groupBy("class_name", "ancestor").agg(F.min("path").alias("path")).withColumn("level", F.lit(1)).where("class_name != ancestor")
    (found,) = bounded(cut(now, "closure"))
    level = found
    for d in range(2, max_levels + 1):
        nxt = level.join(step, level["ancestor"] == step["c"]).where(F.col("b") != F.col("class_name"))
        nxt = nxt.groupBy("class_name", F.col("b").alias("ancestor")).agg(F.min(F.concat("path", F.array("ord"))).alias("path")).withColumn("level", F.lit(d))
        level = cut(nxt.join(found.select("class_name", "ancestor"), ["class_name", "ancestor"], "left_anti"), "closure")
        if level.isEmpty():
            break
        (found,) = bounded(cut(found.unionByName(level), "closure"))
    return found


def implements(methods: DataFrame, wanted: DataFrame) -> DataFrame:
    """(iface, type): types (type, method) that have every method of an interface (iface, method).

    Method sets are divided once for each distinct set, not for each interface and type; only the result is as large as
    the pairs that it holds.
    """
    want = wanted.groupBy("iface").agg(F.array_sort(F.collect_set("method")).alias("needs"))
    have = methods.groupBy("type").agg(F.array_sort(F.collect_set("method")).alias("has"))
    a = want.select("needs").distinct().select("needs", F.explode("needs").alias("method"))
    b = have.select("has").distinct().select("has", F.explode("has").alias("method"))
    hits = a.join(b, "method").groupBy("needs", "has").agg(F.count("*").alias("n")).where(F.col("n") == F.size("needs"))
    return want.join(hits, "needs").join(have, "has").where("iface != type").select("iface", "type")


def dispatch_edges(sites: DataFrame, implementations: DataFrame, methods: DataFrame) -> DataFrame:
    """One edge for each implementation of the interface that a call's receiver has."""
    made = implementations.join(methods.select("type", "method", "id"), "type").select("iface", F.col("method").alias("callee_name"), F.col("id").alias("callee_id"))
    own = sites.where("receiver_kind = 'var'").withColumn("iface", F.col("receiver_type"))
    return own.join(made, ["iface", "callee_name"]).withColumn("resolution", F.lit("interface-dispatch"))
