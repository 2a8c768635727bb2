"""Source trees end to end: scan, parse, resolve, query, update."""

from __future__ import annotations

import itertools
import json

import pytest
from pyspark.sql import functions as F

from codequarry.operators.store import Store
from codequarry.plans import api
from codequarry.sources.files import ScanOptions, scan

GO = {
    "go.mod": "module x\n",
    "widget/engine.go": """package widget

import (
	"fmt"
	st "example.com/x/store"
)

const Limit = 10

type Conn struct{ addr string }

func (c *Conn) Query(q string) string { return q }

type Engine struct {
	db *Conn
}

func (e *Engine) Start(db *Conn) {
	db.Query("call Stop() in a string")
	e.Stop()
	e.db.Query("x")
	fmt.Println("hi") // Stop()
	st.BuildPayload(1)
	helper(make([]int, 1))
}

func (e *Engine) Stop() {}

func NewEngine() *Engine { return &Engine{} }

func Run() {
	e := NewEngine()
	e.Start(nil)
}
""",
    "widget/helper.go": "package widget\n\nfunc helper(x []int) int { return len(x) }\n",
    "store/store.go": "package store\n\nfunc BuildPayload(n int) int { return n }\n",
    "notify/n.go": """package notify

type Notifier interface {
	Send(msg string) error
}

type Email struct{}

func (e *Email) Send(msg string) error { return nil }

type SMS struct{}

func (s SMS) Send(msg string) error { return nil }

func Notify(n Notifier) {
	n.Send("x")
}
""",
}
PY = {
    "pay/ledger.py": '''"""Ledger."""
LIMIT = 5
try:
    FAST = True
except ImportError:
    FAST = False


def post_transaction(x):
    """Post it."""
    return helper(x)


def helper(x):
    return len(x)
''',
    "pay/fees.py": """from pay.ledger import post_transaction as apply_entry
from urllib.parse import quote


class Base:
    def save(self):
        pass


class Repo(Base):
    conn: Conn

    def __init__(self):
        self.log = Log()

    def get(self, c: Conn):
        self.save()
        self.conn.query()
        c.query()
        self.log.write()
        quote("x")
        return apply_entry([1])


class Conn:
    def query(self):
        pass


class Log:
    def write(self):
        pass


def use():
    r = Repo()
    r.get(None)
    r.save()
""",
    "pay/broken.py": "def ok(x):\n    return helper(x)\n\ndef bad(:\n",
}
TS = {
    "web/store.ts": """import * as util from './util'
import { build as make } from './util'

export interface Row { id: number }
export class Link {
  query(sql: string): Row { return run(sql) }
}
function run(sql: string): Row { return { id: 1 } }
export class Repository {
  private conn: Link
  constructor(conn: Link) { this.conn = conn }
  find(id: number) { return this.conn.query('select') }
  all() { return this.find(1) }
}
export const newRepo = (c: Link): Repository => {
  const r = new Repository(c)
  r.all()
  make(1)
  parseInt('1')
  return r
}
""",
    "web/util.ts": "export function build(n: number) { return n }\n",
    "web/app.js": "import x from 'y'\nfunction go() { return build(1) }\nclass View { draw() { go() } }\n",
    "native/a.rs": "use std::io;\nfn main() { helper(1); }\nfn helper(x: i32) {}\nstruct P { x: i32 }\n",
    "native/b.c": "#include <stdio.h>\nint add(int a, int b) { return sub(a, b); }\nint sub(int a, int b) { return a - b; }\n",
    "native/c.rb": "require 'json'\nclass Dog\n  def bark\n    say('x')\n  end\n  def say(x)\n    if x\n      x\n    end\n  end\nend\n",
    "native/D.java": "import java.util.List;\nclass D {\n  int run(int x) { return go(x); }\n  int go(int x) { return x; }\n}\n",
    "native/e.swift": "import Foundation\nstruct S { func f() { g() } }\nfunc g() {}\n",
    "native/f.cpp": "#include <x>\nclass K {\n public:\n  int m() { return n(); }\n};\nint n() { return 1; }\n",
}
DOCS = {
    "docs/guide.md": "\n# User Guide\n\nSet the replica count before a deployment.\n",
    "Dockerfile": "FROM x\n",
    "config/app.yaml": "a: 1\n",
    "package-lock.json": "{}",
    "node_modules/z.go": "package z\nfunc Z() {}\n",
    "generated/skip.go": "package g\nfunc Skip() {}\n",
    "big.go": "package big\n" + "// x\n" * 400_000,
    ".gitignore": "generated/\n",
}


def plant(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    plant(root, GO | PY | TS | DOCS)
    return root


@pytest.fixture(scope="module")
def store(spark, tree, tmp_path_factory):
    s = Store(spark, f"file://{tmp_path_factory.mktemp('store')}")
    s.index(str(tree))
    return s


def edges(store):
    f = store.table("functions")
    caller = f.select(F.col("id").alias("caller_id"), F.col("name").alias("caller"))
    callee = f.select(F.col("id").alias("callee_id"), F.col("file_path").alias("to"), F.col("receiver_type").alias("on"))
    rows = store.table("calls").join(caller, "caller_id").join(callee, "callee_id", "left").collect()
    return {(r.caller, r.callee_name, r.resolution, r.to, r["on"]) for r in rows}


def test_scan(spark, tree):
    got = {r.path for r in scan(spark, str(tree)).select("path").collect()}
    assert "node_modules/z.go" not in got and "generated/skip.go" not in got and "big.go" not in got and "package-lock.json" not in got
    assert {"Dockerfile", "docs/guide.md", "widget/engine.go"} <= got
    only = {r.path for r in scan(spark, str(tree), ScanOptions(include=["*.py"], exclude=["fees.py"])).select("path").collect()}
    assert only == {"pay/ledger.py", "pay/broken.py"}


def test_documents(store):
    got = {r.file_path: (r.kind, r.title) for r in store.table("documents").collect()}
    assert got == {"docs/guide.md": ("markdown", "User Guide"), "Dockerfile": ("dockerfile", "Dockerfile"), "config/app.yaml": ("yaml", "app.yaml")}


def test_go_edges(store):
    e = edges(store)
    eng = "widget/engine.go"
    assert ("Start", "Query", "receiver-typed", eng, "Conn") in e
    assert ("Start", "Stop", "receiver-typed", eng, "Engine") in e
    assert ("Start", "Println", "import-qualified", None, None) in e
    assert ("Start", "BuildPayload", "cross-package", "store/store.go", None) in e
    assert ("Start", "helper", "same-package", "widget/helper.go", None) in e
    assert ("Start", "make", "builtin", None, None) in e
    assert ("Run", "NewEngine", "same-file", eng, None) in e
    assert ("Run", "Start", "receiver-typed", eng, "Engine") in e
    assert {x for x in e if x[0] == "Notify"} == {
        ("Notify", "Send", "unresolved", None, None),
        ("Notify", "Send", "interface-dispatch", "notify/n.go", "Email"),
        ("Notify", "Send", "interface-dispatch", "notify/n.go", "SMS"),
    }
    assert sum(x[:2] == ("Start", "Stop") for x in e) == 1


def test_python_edges(store):
    e = edges(store)
    fees = "pay/fees.py"
    assert ("get", "save", "receiver-typed", fees, "Base") in e
    assert ("get", "query", "receiver-typed", fees, "Conn") in e
    assert ("get", "write", "receiver-typed", fees, "Log") in e
    assert ("use", "Repo", "constructor", None, None) in e
    assert ("use", "get", "receiver-typed", fees, "Repo") in e
    assert ("use", "save", "receiver-typed", fees, "Base") in e
    assert ("get", "quote", "unresolved", None, None) in e
    assert ("post_transaction", "helper", "same-file", "pay/ledger.py", None) in e
    assert ("get", "apply_entry", "import-symbol", "pay/ledger.py", None) in e
    assert ("helper", "len", "builtin", None, None) in e


def test_typescript_and_generic_edges(store):
    e = edges(store)
    ts = "web/store.ts"
    assert ("find", "query", "receiver-typed", ts, "Link") in e
    assert ("all", "find", "receiver-typed", ts, "Repository") in e
    assert ("newRepo", "all", "receiver-typed", ts, "Repository") in e
    assert ("newRepo", "make", "import-symbol", "web/util.ts", None) in e
    assert ("newRepo", "parseInt", "builtin", None, None) in e
    assert ("query", "run", "same-file", ts, None) in e
    assert ("go", "build", "name-global", "web/util.ts", None) in e
    assert ("main", "helper", "name-global") in {x[:3] for x in e}
    assert ("add", "sub", "name-global", "native/b.c", None) in e
    assert ("bark", "say", "name-global", "native/c.rb", None) in e
    assert ("run", "go", "name-global") in {x[:3] for x in e}
    assert ("f", "g", "name-global", "native/e.swift", None) in e
    assert ("m", "n", "name-global", "native/f.cpp", None) in e


def test_types_and_constants(store):
    got = {(r.name, r.kind) for r in store.table("types").collect()}
    assert {("Limit", "constant"), ("LIMIT", "constant"), ("FAST", "constant"), ("newRepo", "constant")} <= got
    assert {("Engine", "type"), ("Notifier", "interface"), ("Repo", "class"), ("Row", "interface"), ("Dog", "type"), ("P", "type"), ("K", "type")} <= got


def test_definition_and_search(store):
    d = api.get_definition(store, "newengine")
    assert d["answer_status"] == "definitive" and d["canonical"]["file"] == "widget/engine.go"
    assert api.get_definition(store, "nothing")["answer_status"] == "partial"
    assert api.get_definition(store, "helper")["answer_status"] == "ambiguous"
    q = api.query_codebase(store, "new engine")
    assert q["answer_status"] == "definitive" and q["results"][0]["name"] == "NewEngine"
    assert [r["kind"] for r in api.query_codebase(store, "replica count", scope="docs")["results"]] == ["document"]
    q = api.query_codebase(store, "Notifer")
    assert q["results"] == [] and "Notifier" in q["suggestions"]
    for text in ["db.Open(path)", "retry-logic", 'what calls "Stop"?', "foo NEAR bar"]:
        api.query_codebase(store, text)


def test_chain_and_impact(store):
    c = api.get_call_chain(store, "Stop")
    assert {(r["name"], r["depth"]) for r in c["callers"]} == {("Start", 1), ("Run", 2)} and c["callees"] == []
    i = api.get_impact(store, ["store/store.go", "gone.go"])
    assert {(r["symbol"], r["depth"], r["via"]) for r in i["impacted"]} == {("Start", 1, "BuildPayload"), ("Run", 2, "BuildPayload")}
    assert i["unresolved_files"] == ["gone.go"] and i["stats"]["max_depth_reached"] == 2
    with pytest.raises(ValueError, match="confidence"):
        api.get_call_chain(store, "Stop", min_confidence="sure")


def test_architecture_and_status(store):
    text = api.get_architecture(store)
    assert "## Central files" in text and "widget/engine.go" in text
    assert "pay/" not in api.get_architecture(store, focus="widget")
    assert api.get_status(store)["healthy"]


def test_incremental_equals_full(spark, tmp_path):
    root = tmp_path / "src"
    plant(root, GO | PY)
    live = Store(spark, f"file://{tmp_path}/live")
    live.index(str(root))
    changes = [
        ({"widget/helper.go": "package widget\n\nfunc helper(x []int) int { return more() }\n\nfunc more() int { return 1 }\n"}, []),
        ({"widget/helper.go": "package widget\n\n// moved down\n\nfunc helper(x []int) int { return more() }\n\nfunc more() int { return 1 }\n"}, []),
        ({"notify/p.go": "package notify\n\ntype Push struct{}\n\nfunc (p Push) Send(msg string) error { return nil }\n"}, ["store/store.go"]),
    ]
    number = itertools.count()
    for written, removed in changes:
        plant(root, written)
        for r in removed:
            (root / r).unlink()
        rows = [(p, "upsert") for p in written] + [(p, "delete") for p in removed]
        live.apply(spark.createDataFrame(rows, "path string, op string"), str(root))
        full = Store(spark, f"file://{tmp_path}/full-{next(number)}")
        full.index(str(root))
        assert edges(live) == edges(full)
        for t in ("functions", "types", "call_sites", "postings", "lengths"):
            a, b = live.table(t), full.table(t)
            assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    want = edges(live)
    live.compact()
    assert edges(live) == want and len(live.manifest()["tables"]["calls"]) == 1


def test_rpc(store):
    from codequarry.plans import rpc

    ask = [
        {"id": 1, "method": "tools/list"}, {"method": "notifications/initialized"},
        {"id": 2, "method": "tools/call", "params": {"name": "get_definition", "arguments": {"symbol": "NewEngine"}}},
        {"id": 3, "method": "nope"}, {"id": 4, "method": "tools/call", "params": {"name": "get_definition", "arguments": {"x": 1}}},
        {"id": 5, "method": "tools/call", "params": {"name": "get_call_chain", "arguments": {"function_name": "Stop", "min_confidence": "sure"}}},
        {"id": 6, "method": "resources/read", "params": {"uri": "index://summary"}}, {"id": 7, "method": "resources/read", "params": {"uri": "x"}},
    ]
    got = [json.loads(x) for x in rpc.serve(store, [json.dumps(a) for a in ask] + ["{", ""])]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5, 6, 7, None]
    assert len(got[0]["result"]["tools"]) == 5 and "definitive" in got[1]["result"]["content"][0]["text"]
    assert [g.get("error", {}).get("code") for g in got] == [None, None, rpc.METHOD, rpc.PARAMS, None, None, rpc.RESOURCE, rpc.PARSE]
    assert got[4]["result"]["isError"] and "# Summary" in got[5]["result"]["contents"][0]["text"]


def test_loop_guard(store):
    s = api.Session()
    answers = [api.query_codebase(store, "engine", session=s) for _ in range(6)]
    assert ["nudge" in a for a in answers] == [False] * 3 + [True] * 3 and answers[5]["loop_guard"] == "stop_searching" and "loop_guard" not in answers[4]


def test_artifacts_and_benchmark(spark, store, tree, tmp_path):
    from codequarry.plans import artifacts, benchmark
    from codequarry.sources import evaluation

    artifacts.write_all(store, str(tmp_path / "out"))
    assert "# Architecture" in artifacts.read(str(tmp_path / "out"), "architecture.md") and json.loads(artifacts.read(str(tmp_path / "out"), "status.json"))["healthy"]
    asked = [{"id": "L1", "text": "Where is Engine?", "category": "lookup", "mc_tool": "get_definition", "baseline_terms": ["Engine"], "mc_args": {"symbol": "Engine"}}]
    (tmp_path / "q.json").write_text(json.dumps(asked))
    rows = [r.asDict() for r in evaluation.questions(spark, f"{tmp_path}/q.json").collect()]
    result = benchmark.run(scan(spark, str(tree)), rows, lambda tool, args: api.call_tool(store, tool, args), "tree")
    benchmark.write(result, str(tmp_path / "bench"))
    assert result["summary"]["question_count"] == 1 and result["questions"][0]["naive_tokens"] >= result["questions"][0]["skilled_tokens"] > 0
    with pytest.raises(ValueError, match="match nothing"):
        benchmark.run(scan(spark, str(tree)), [asked[0] | {"baseline_terms": ["zzzz"]}], lambda t, a: "x")


def test_config(tmp_path):
    from codequarry.sources import config

    assert config.load(str(tmp_path)).debounce_ms == 500
    (tmp_path / ".quarry").mkdir()
    (tmp_path / ".quarry/config.json").write_text('{"languages": ["golang"], "exclude": "no list", "maxFileSize": 5}')
    c = config.load(str(tmp_path))
    assert c.options().extensions() == ["go"] and c.exclude == [] and c.options().max_file_size == 5
    (tmp_path / ".quarry/config.json").write_text("{")
    assert config.load(str(tmp_path)) == config.Config()


def test_evaluation_sources(spark, tmp_path):
    from codequarry.sources import evaluation

    protocol = {"version": "1", "tasks": [{"id": "t1", "type": "edit"}, {"id": "t2"}], "keys": [{"task_id": "t1", "expected_files": ["a.py"], "expected_symbols": ["f"]}]}
    (tmp_path / "p.json").write_text(json.dumps(protocol))
    got = {r.id: r.expected_files for r in evaluation.protocol_tasks(spark, f"{tmp_path}/p.json").collect()}
    assert got == {"t1": ["a.py"], "t2": None} and len(evaluation.protocol_hash(spark, f"{tmp_path}/p.json")) == 64
    (tmp_path / "r.json").write_text(json.dumps({"manifest": {"x": 1}, "runs": [{"task_id": "t1", "arm": "grep", "input_tokens": 5}]}))
    assert [(r.task_id, r.input_tokens) for r in evaluation.runs(spark, f"{tmp_path}/r.json").collect()] == [("t1", 5)]
    (tmp_path / "s.json").write_text(json.dumps({"id": "s", "task_prompt": ["a", "b"], "ground_truth": {"x": 1}, "context_files": ["a.go", "b.zig"], "task_category": "c"}))
    s = evaluation.scenarios(spark, f"{tmp_path}/s.json").first()
    assert s.task_prompt == "a\nb" and json.loads(s.ground_truth) == {"x": 1}


def test_manifests_swap_whole_and_old_ones_go(spark, tmp_path):
    from codequarry.operators.store import KEEP, ConcurrentUpdate

    root = tmp_path / "src"
    plant(root, {"a.py": "def one():\n    return 1\n"})
    a, b = (Store(spark, f"file://{tmp_path}/store") for _ in range(2))
    assert a.table("functions").isEmpty()
    a.index(str(root))
    held = b.manifest()
    for i in range(KEEP + 1):
        plant(root, {"a.py": f"def one{i}():\n    return 1\n"})
        a.apply(spark.createDataFrame([("a.py", "upsert")], "path string, op string"), str(root))
        if i == 0:  # a reader of the state before still finds it whole
            assert [r.name for r in b.table("functions", held).collect()] == ["one"]
    assert a._numbers() == list(range(3, KEEP + 3))
    with pytest.raises(ConcurrentUpdate):
        b._flip(held, held["n"] + 1)
    assert [r.name for r in b.table("functions").collect()] == [f"one{KEEP}"] and not list((tmp_path / "store/manifests").glob("*.temp"))
    a.compact()
    a.compact()
    a.compact()
    named = {layer["path"] for n in a._numbers() for layers in a._read(n)["tables"].values() for layer in layers}
    on_disk = {f"file://{p}" for p in (tmp_path / "store/data").glob("functions/*")}
    assert on_disk <= named


def test_another_schema_version_is_built_anew(spark, tmp_path):
    root = tmp_path / "src"
    plant(root, {"a.py": "def one():\n    return 1\n", "b.py": "def two():\n    return 1\n"})
    store = Store(spark, f"file://{tmp_path}/store")
    store.index(str(root))
    now = store.manifest()
    store._flip({"tables": now["tables"], "meta": now["meta"] | {"schema_version": "1"}}, now["n"])
    plant(root, {"b.py": "def three():\n    return 1\n"})
    store.apply(spark.createDataFrame([("a.py", "upsert")], "path string, op string"), str(root))
    assert {r.name for r in store.table("functions").collect()} == {"one", "three"} and store.health()["schema_version"] != "1"


def test_more_changes_than_a_layer_lists(spark, tmp_path, monkeypatch):
    from codequarry.operators import store as module

    monkeypatch.setattr(module, "MAX_CHANGED", 1)
    root = tmp_path / "src"
    plant(root, {"a.py": "def one():\n    return 1\n", "b.py": "def two():\n    return 1\n"})
    store = Store(spark, f"file://{tmp_path}/store")
    store.apply(spark.createDataFrame([("a.py", "upsert"), ("b.py", "upsert")], "path string, op string"), str(root))
    assert {r.name for r in store.table("functions").collect()} == {"one", "two"}


def test_ignore_files_of_any_scheme_and_contents_of_wanted_files_only(spark, tmp_path):
    plant(tmp_path, {"a.py": "x = 1\n", "gen/b.py": "x = 1\n", "sub/c.py": "x = 1\n", "sub/d.py": "x = 1\n", "node_modules/e.py": "x = 1\n", ".gitignore": "gen/\n", "sub/.gitignore": "d.py\n"})
    for path in (str(tmp_path), f"file://{tmp_path}"):
        files = scan(spark, path)
        assert {r.path for r in files.collect()} == {"a.py", "sub/c.py"}
        # the files that are opened at all
        assert len(files.inputFiles()) == 2


def test_a_search_reads_postings_once(spark, store):
    from codequarry.operators import search

    post, length = (store.table(t).where("corpus = 'functions'") for t in ("postings", "lengths"))
    q = search.parse_query('name:engine OR "new engine" OR stop* NOT zzz', list(search.FUNCTION_COLUMNS))
    plan = search.bm25(post, length, q, search.FUNCTION_COLUMNS)._jdf.queryExecution().optimizedPlan().toString()
    # the same subplan for scores and for the numbers of rows, whatever the phrases, and the lengths
    assert plan.count("Relation [corpus") <= 4
    assert search.bm25(post, length, q, search.FUNCTION_COLUMNS).count() > 0


def test_search_index_is_rebuilt_from_the_tables(spark, tmp_path):
    root = tmp_path / "src"
    plant(root, GO)
    store = Store(spark, f"file://{tmp_path}/store")
    store.index(str(root))
    before = store.table("postings").collect()
    store.rebuild_search()
    assert sorted(map(str, store.table("postings").collect())) == sorted(map(str, before)) and len(before) > 100


def test_totals_beyond_what_is_listed(spark, tmp_path, monkeypatch):
    root = tmp_path / "src"
    plant(root, {f"p{i}/a.py": "def same():\n    return 1\n" for i in range(5)})
    store = Store(spark, f"file://{tmp_path}/store")
    store.index(str(root))
    monkeypatch.setattr(api, "MAX_MATCHES", 2)
    d = api.get_definition(store, "same")
    assert (d["total"], len(d["matches"]), d["truncated"], d["answer_status"]) == (5, 2, True, "ambiguous") and d["ambiguity_reason"].startswith("5 ")


def test_command_line_options(store, monkeypatch, capsys):
    import codequarry.__main__ as cli

    seen = {}
    for name in ("query_codebase", "get_call_chain", "get_impact"):
        monkeypatch.setattr(api, name, lambda s, *a, name=name: seen.update({name: a}) or {})
    base = ["--store", store.path]
    cli.main([*base, "query", "new engine", "--limit", "7", "--scope", "types", "--file-filter", "*.go"])
    cli.main([*base, "calls", "Stop", "--direction", "callees", "--depth", "3", "--min-confidence", "same-file", "--max-results", "9"])
    cli.main([*base, "impact", "--from-git", "HEAD~1", "--root", "/x", "--depth", "1", "--no-tests"])
    assert seen == {
        "query_codebase": ("new engine", 7, "types", "*.go"), "get_call_chain": ("Stop", "callees", 3, "same-file", 9),
        "get_impact": (None, "HEAD~1", "/x", 1, "callers", False, None),
    }
