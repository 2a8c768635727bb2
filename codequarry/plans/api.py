"""The five query functions over a store, and the architecture report.

Rows reach the driver only after a limit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions import text as fn
from codequarry.operators import graph, search
from codequarry.operators.aggregates import directory_map, language_counts, top_per_key
from codequarry.operators.store import Store
from codequarry.schema import RANKS
from codequarry.sources.files import changed_files, glob_regex

#: Definitions that an answer lists; its counts and its decision are over all of them.
MAX_MATCHES = 200


@dataclass
class Session:
    """What is kept between calls: how often the caller has searched."""

    searches: int = 0
    nudge_from: int = 4
    stop_from: int = 6
    seen: list[str] = field(default_factory=list)


def _clamp(x: int | None, lo: int, hi: int, default: int) -> int:
    return default if x is None else max(lo, min(hi, x))


def _pick(matches: list[dict], equal: int | None = None) -> dict:
    """The decision among exact matches: none partial, one or a unique best definitive, else ambiguous.

    ``equal``: how many have the best priority, where the list does not hold all of them.
    """
    if not matches:
        return {"answer_status": "partial", "recommended_next_action": "call_query_codebase", "canonical": None}
    best = min(m["priority"] for m in matches)
    top = [m for m in matches if m["priority"] == best]
    if len(top) > 1:
        return {"answer_status": "ambiguous", "recommended_next_action": "narrow_scope", "ambiguous": True, "canonical": None, "ambiguity_reason": f"{equal or len(top)} definitions of equal standing"}
    out = {"answer_status": "definitive", "recommended_next_action": "answer_now", "canonical": top[0]}
    if len(matches) > 1:
        out |= {"overloaded": True, "secondary_matches": [m for m in matches if m is not top[0]], "disambiguation_reason": "a type outranks a function, a function a method"}
    return out


def _definitions(store: Store) -> DataFrame:
    f = store.table("functions").select("id", "name", F.when(F.col("kind") == "method", "method").otherwise("function").alias("kind"), "file_path", "start_line")
    t = store.table("types").select("id", "name", F.concat(F.lit("type/"), "kind").alias("kind"), "file_path", "start_line")
    return f.unionByName(t)


def get_definition(store: Store, symbol: str) -> dict:
    hits = _definitions(store).where(fn.equal_fold(F.col("name"), F.lit(symbol)))
    kind = F.col("kind")
    rows = hits.select("name", "kind", fn.label(kind).alias("label"), fn.priority(kind).alias("priority"), F.col("file_path").alias("file"), F.col("start_line").alias("line"))
    counts = dict(sorted(rows.groupBy("priority").agg(F.count("*")).collect()))  # at most one row for each priority
    matches = [r.asDict() for r in rows.orderBy("priority", "file", "line").limit(MAX_MATCHES).collect()]
    total, equal = sum(counts.values()), next(iter(counts.values()), 0)
    out = {"matches": matches, "total": total, "truncated": total > len(matches)} | _pick(matches, equal)
    if c := out["canonical"]:
        out["answer"] = f"{c['name']} ({c['label']}) is defined at {c['file']}:{c['line']}"
    return out | {"staleness": store.health()}


_CORPORA = {
    "functions": ("functions", search.FUNCTION_COLUMNS, "code"),
    "types": ("types", search.TYPE_COLUMNS, "definition"),
    "docs": ("documents", search.DOCUMENT_COLUMNS, "content"),
}


def _search(store: Store, corpus: str, query: str, q: search.Query, limit: int, file_filter: str | None) -> list[dict]:
    table, weights, body = _CORPORA[corpus]
    rows = store.table(table)
    own = F.col("corpus") == table
    scored = search.bm25(store.table("postings").where(own), store.table("lengths").where(own), q, weights)
    if file_filter:
        path = F.col("file_path") if "/" in file_filter else F.substring_index("file_path", "/", -1)
        scored = scored.join(rows.where(path.rlike(f"^{glob_regex(file_filter)}$")).select("id"), "id", "left_semi")
    top = search.best(scored, limit).join(rows, "id")
    name = F.col("title") if corpus == "docs" else F.col("name")
    kind = F.lit("document") if corpus == "docs" else F.concat(F.lit("type/"), "kind") if corpus == "types" else F.when(F.col("kind") == "method", "method").otherwise("function")
    line = F.lit(1) if corpus == "docs" else F.col("start_line")
    out = top.select(name.alias("name"), kind.alias("kind"), F.col("file_path").alias("file"), line.alias("line"), "rank", "id", F.col(body).alias("_body"))
    out = out.withColumn("_exact", search.is_exact(F.col("name"), query) & (F.col("kind") != "document"))
    out = search.with_snippets(out, "_body", q).withColumn("label", F.when(F.col("kind") == "document", "document").otherwise(fn.label(F.col("kind"))))
    return [r.asDict() for r in out.withColumn("priority", fn.priority(F.col("kind"))).drop("_body").orderBy("rank", "id").collect()]


def query_codebase(store: Store, query: str, limit: int | None = None, scope: str = "all", file_filter: str | None = None, session: Session | None = None) -> dict:
    if scope not in ("all", "functions", "types", "docs", "files"):
        raise ValueError(f"unknown scope {scope!r}")
    n = _clamp(limit, 1, 50, 3)
    session = session or Session()
    session.searches += 1

    def run(make) -> list[dict]:  # noqa: ANN001
        found: list[dict] = []
        for corpus in ("functions", "types", "docs"):
            if scope in ("all", "files", corpus):
                q = make(list(_CORPORA[corpus][1]))
                own = min(n, 3) if corpus == "docs" and scope == "all" else n if corpus == "docs" else search.overfetch(n)
                found += _search(store, corpus, query, q, own, file_filter) if q else []
        return found

    found, expanded = run(lambda columns: search.understood(query, columns)), False
    if not found and (wide := search.expanded(query)):
        found, expanded = run(lambda _: wide), True
    if scope == "files":
        seen: dict[str, dict] = {}
        for r in found:
            seen.setdefault(r["file"], r)
        found = list(seen.values())
    hits = [r for r in found if r.pop("_exact")]
    decision = _pick(hits)
    if hits and decision["answer_status"] == "definitive":
        results = [decision["canonical"], *(r for r in found if r is not decision["canonical"])][:n]
    elif hits:
        results = hits
    else:
        results = found[:n]
        decision |= {"recommended_next_action": "inspect_top_result" if found else "retry_with_suggestion"}
    intent = store.spark.range(1).select(fn.intent(F.lit(query))).first()[0]
    out = {"results": results, "total": len(results), "detected_intent": intent, "expanded_query": expanded} | decision
    if not results:
        out["suggestions"] = [r["name"] for r in search.suggestions(store.table("functions"), store.table("types"), query).collect()]
    if session.searches >= session.nudge_from:
        out["nudge"] = "several searches so far: inspect a result before the next one"
    if session.searches >= session.stop_from:
        out["loop_guard"] = "stop_searching"
    return out | {"staleness": store.health()}


def get_call_chain(store: Store, name: str, direction: str = "both", depth: int | None = None, min_confidence: str | None = None, max_results: int | None = None) -> dict:
    depth, limit = _clamp(depth, 1, 5, 2), _clamp(max_results, 1, 200, 50)
    out: dict = {"function": name, "depth": depth, "truncated": False}
    functions, calls = store.table("functions"), store.table("calls")
    for d in ("callers", "callees"):
        if direction in (d, "both"):
            rows = [r.asDict() for r in graph.capped(graph.call_chain(functions, calls, name, depth, d, min_confidence), limit).collect()]
            out[d] = [{k: r[k] for k in ("name", "file_path", "start_line", "depth", "resolution")} for r in rows]
            out[f"{d}_total"] = rows[0]["total"] if rows else 0
            out["truncated"] |= out[f"{d}_total"] > limit
    out["recommended_next_action"] = "narrow_scope" if out["truncated"] else "answer_now" if out.get("callers") or out.get("callees") else "call_query_codebase"
    return out | {"staleness": store.health()}


def get_impact(
    store: Store, files: list[str] | None = None, from_git: str | None = None, root: str | None = None, depth: int | None = None,
    direction: str = "callers", include_tests: bool = True, min_confidence: str | None = None,
) -> dict:
    if files is None:
        if not root:
            raise ValueError("give files, or the root of a git work tree")
        changed = changed_files(store.spark, root, from_git or "HEAD")
    else:
        changed = store.spark.createDataFrame([(f,) for f in files], "path string")
    functions, calls = store.table("functions"), store.table("calls")
    seeds = functions.join(changed.distinct().withColumnRenamed("path", "file_path"), "file_path", "left_semi")
    per_file = {r["file_path"]: r["n"] for r in seeds.groupBy("file_path").agg(F.count("*").alias("n")).collect()}  # at most the given files
    known = sorted(per_file)
    unresolved = sorted({r["path"] for r in changed.collect()} - set(known))
    reached = graph.impact(functions, calls, seeds.select("id"), _clamp(depth, 1, 5, 2), direction, include_tests, min_confidence)
    rows = [r.asDict() for r in reached.orderBy("depth", "symbol", "file", "line").limit(graph.MAX_IMPACT).collect()]
    stats = graph.impact_stats(reached).first().asDict()
    return {
        "changed": [{"file": f, "symbols": per_file[f]} for f in known],
        "impacted": [{k: v for k, v in r.items() if k != "id"} for r in rows], "unresolved_files": unresolved,
        "stats": stats | {"changed_files": len(known), "changed_symbols": sum(per_file.values())}, "staleness": store.health(),
    }


def get_architecture(store: Store, focus: str | None = None) -> str:
    """A short Markdown report; ``focus`` keeps what lies under a folder."""
    functions, calls, imports = store.table("functions"), store.table("calls"), store.table("imports")
    if focus:
        under = F.col("file_path").startswith(focus.rstrip("/") + "/")
        functions, imports = functions.where(under), imports.where(under)
    ranks = graph.pagerank(functions, calls)
    ranked = functions.select("id", "name", "file_path", "start_line", "language").join(ranks, "id")
    files = graph.file_scores(functions, ranks).orderBy(F.desc("score"), "file_path").limit(10)
    top = [r.asDict() for r in files.collect()]
    langs = language_counts(functions).orderBy(F.desc("n"), "language").collect()
    dirs = directory_map(functions).withColumnRenamed("functions", "n").orderBy(F.desc("n"), "dir").limit(20).collect()
    key = ranked.orderBy(F.desc("score"), "name", "file_path").limit(15).collect()
    own = imports.where(F.col("file_path").isin([t["file_path"] for t in top]))
    needs = top_per_key(own.select("file_path", "imported_path").distinct(), ["file_path"], ["imported_path"], 5).orderBy("file_path", "imported_path").limit(30).collect()
    lines = ["# Architecture", "", "## Languages", *(f"- {r['language']}: {r['n']} functions" for r in langs), "", "## Folders", *(f"- {r['dir']}: {r['n']}" for r in dirs)]
    lines += ["", "## Central files", *(f"- {t['file_path']} ({t['score']:.4f})" for t in top)]
    lines += ["", "## Key functions", *(f"- {r['name']} ({fmt_place(r['file_path'], r['start_line'])})" for r in key)]
    lines += ["", "## Dependencies", *(f"- {r['file_path']} -> {r['imported_path']}" for r in needs)]
    return "\n".join(lines) + "\n"


def get_summary(store: Store) -> str:
    functions, types = store.table("functions"), store.table("types")
    n_files = functions.select("file_path").unionByName(types.select("file_path")).distinct().count()
    entry = functions.where(F.col("file_path").like("%main.%") | F.col("file_path").like("%index.%")).select("file_path").distinct().orderBy("file_path").limit(10).collect()
    return "\n".join(["# Summary", "", f"- files: {n_files}", f"- functions: {functions.count()}", f"- types: {types.count()}", "", "## Entry points", *(f"- {r['file_path']}" for r in entry)]) + "\n"


def get_status(store: Store) -> dict:
    counts = {n: store.table(n).count() for n in ("functions", "types", "calls", "documents")}
    return store.health() | {"counts": counts, "confidence_levels": list(RANKS)}


def fmt_place(path: str, line: int | None) -> str:
    return f"{path}:{line}" if line else path


TOOLS = {"get_definition": get_definition, "query_codebase": query_codebase, "get_call_chain": get_call_chain, "get_impact": get_impact, "get_architecture": get_architecture}


def call_tool(store: Store, name: str, arguments: dict) -> dict | str:
    if name not in TOOLS:
        raise ValueError(f"unknown tool {name!r}")
    return TOOLS[name](store, **arguments)
