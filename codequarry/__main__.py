"""Command line: ``python -m codequarry --store DIR COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys

from codequarry.operators.store import Store
from codequarry.plans import api, artifacts, benchmark, rpc
from codequarry.session import local_session
from codequarry.sources import config, evaluation
from codequarry.sources.files import ScanOptions, scan
from codequarry.streaming.maintain import maintain
from codequarry.streaming.tree_source import tree_changes


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="codequarry")
    parser.add_argument("--store", required=True)
    sub = parser.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index")
    index.add_argument("root")
    index.add_argument("--include", action="append", default=[])
    index.add_argument("--exclude", action="append", default=[])
    sub.add_parser("def").add_argument("symbol")
    query = sub.add_parser("query")
    query.add_argument("query")
    query.add_argument("--limit", type=int)
    query.add_argument("--scope", default="all", choices=["all", "functions", "types", "docs", "files"])
    query.add_argument("--file-filter")
    calls = sub.add_parser("calls")
    calls.add_argument("name")
    calls.add_argument("--max-results", type=int)
    impact = sub.add_parser("impact")
    impact.add_argument("files", nargs="*")
    impact.add_argument("--from-git", metavar="REV", help="the files that differ from a revision of the tree at --root")
    impact.add_argument("--root")
    impact.add_argument("--no-tests", action="store_true")
    for p, default in ((calls, "both"), (impact, "callers")):
        p.add_argument("--direction", default=default, choices=["callers", "callees", "both"])
        p.add_argument("--depth", type=int)
        p.add_argument("--min-confidence")
    arch = sub.add_parser("arch")
    arch.add_argument("--focus")
    sub.add_parser("status")
    tool = sub.add_parser("tool")
    tool.add_argument("name", choices=sorted(api.TOOLS))
    tool.add_argument("--json", default="{}")
    sub.add_parser("serve")
    watch = sub.add_parser("watch")
    watch.add_argument("root")
    watch.add_argument("--state", required=True)
    report = sub.add_parser("artifacts")
    report.add_argument("folder")
    bench = sub.add_parser("bench")
    bench.add_argument("root")
    bench.add_argument("--questions", required=True)
    bench.add_argument("--out", required=True)
    a = parser.parse_args(argv)
    store = Store(local_session(), a.store)
    if a.command == "serve":
        for line in rpc.serve(store, sys.stdin):
            print(line, flush=True)
        return 0
    if a.command == "watch":
        events = tree_changes(store.spark, a.root, f"{a.state}/listings")
        own = config.load(a.root)
        maintain(store, events, a.root, f"{a.state}/checkpoint", own.options(), gap_ms=own.debounce_ms).awaitTermination()
        return 0

    def options() -> ScanOptions:
        own = config.load(a.root).options()
        return ScanOptions(own.include + a.include, own.exclude + a.exclude, own.languages, own.max_file_size)

    def measured() -> dict:
        asked = [r.asDict() for r in evaluation.questions(store.spark, a.questions).collect()]  # one file of questions
        result = benchmark.run(scan(store.spark, a.root), asked, lambda tool, args: api.call_tool(store, tool, args), a.root)
        benchmark.write(result, a.out)
        return result["summary"]

    run = {
        "index": lambda: {"version": store.index(a.root, options())},
        "artifacts": lambda: artifacts.write_all(store, a.folder) or {"written": a.folder},
        "bench": measured,
        "def": lambda: api.get_definition(store, a.symbol),
        "query": lambda: api.query_codebase(store, a.query, a.limit, a.scope, a.file_filter),
        "calls": lambda: api.get_call_chain(store, a.name, a.direction, a.depth, a.min_confidence, a.max_results),
        "impact": lambda: api.get_impact(store, a.files or None, a.from_git, a.root, a.depth, a.direction, not a.no_tests, a.min_confidence),
        "arch": lambda: api.get_architecture(store, a.focus),
        "status": lambda: api.get_status(store),
        "tool": lambda: api.call_tool(store, a.name, json.loads(a.json)),
    }[a.command]()
    print(run if isinstance(run, str) else json.dumps(run, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
