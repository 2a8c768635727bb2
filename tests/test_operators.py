"""Graph, aggregates, statistics and streams against small expected tables or plain Python."""

from __future__ import annotations

import json
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codequarry.operators import aggregates, edges, evaluate, graph, resolve
from codequarry.operators.store import Store
from codequarry.streaming import changes
from codequarry.streaming.maintain import change_stream, debounced, listing_changes, maintain

FN = "id long, name string, file_path string, start_line int, end_line int, kind string, receiver_type string, package string, return_type string, language string"
CALL = "caller_id long, callee_id long, callee_name string, file_path string, line int, resolution string, receiver_name string"


def functions(spark, rows):
    full = [(i, n, f, i, i, kind, recv, pkg, ret, "go") for i, n, f, kind, recv, pkg, ret in rows]
    return spark.createDataFrame(full, FN)


def plain(spark, names):
    return functions(spark, [(i, n, f, "func", None, "p", None) for i, n, f in names])


def calls(spark, rows):
    return spark.createDataFrame([(a, b, f"f{b}", "x", 1, r, None) for a, b, r in rows], CALL)


def test_pagerank(spark):
    f = plain(spark, [(1, "A", "a.go"), (2, "B", "b.go"), (3, "C", "c.go")])
    got = {r.id: r.score for r in graph.pagerank(f, calls(spark, [(1, 2, "same-package"), (3, 2, "same-package")])).collect()}
    assert got[2] > got[1] == pytest.approx(got[3]) and sum(got.values()) == pytest.approx(1)
    got = {r.id: r.score for r in graph.pagerank(f, calls(spark, [(1, 2, "interface-dispatch"), (1, 3, "same-package")])).collect()}
    assert got[3] > got[2]


def test_impact(spark):
    f = plain(spark, [(1, "Foo", "a.go"), (2, "Bar", "b.go"), (3, "Baz", "b.go"), (4, "Top", "c.go"), (5, "TestFoo", "a_test.go")])
    c = calls(spark, [(2, 1, "receiver-typed"), (3, 1, "name-global"), (4, 2, "same-file"), (5, 1, "same-package"), (1, 1, "same-file"), (2, 4, "same-file")])
    seeds = spark.createDataFrame([(1,)], "id long")
    got = {(r.symbol, r.depth, r.via, r.via_resolution) for r in graph.impact(f, c, seeds, include_tests=False).collect()}
    assert got == {("Bar", 1, "Foo", "receiver-typed"), ("Baz", 1, "Foo", "name-global"), ("Top", 2, "Foo", "same-file")}
    assert {r.symbol for r in graph.impact(f, c, seeds, 1, min_confidence="receiver-typed").collect()} == {"Bar", "TestFoo"}
    s = graph.impact_stats(graph.impact(f, c, seeds)).first()
    assert s.impacted_symbols == 4 and s.max_depth_reached == 2 and not s.truncated and s.resolution_breakdown["name-global"] == 1


def test_hub_is_capped(spark):
    f = plain(spark, [(1, "Hub", "hub.go")] + [(i, f"Caller{i:03}", f"c{i}.go") for i in range(2, 302)])
    c = calls(spark, [(i, 1, "same-package") for i in range(2, 302)])
    rows = graph.capped(graph.call_chain(f, c, "Hub")).collect()
    assert len(rows) == 50 and {(r.total, r.truncated) for r in rows} == {(300, True)}


def test_walk_equals_path_enumeration(spark):
    rng = random.Random(3)
    arcs = [(rng.randrange(1, 20), rng.choice([None, *range(1, 20)]), rng.choice(["a", "b"])) for _ in range(60)]
    f = plain(spark, [(i, f"n{i}", "x") for i in range(1, 20)])
    want, frontier = set(), {1}
    for d in (1, 2, 3):
        met = {(b, r) for a, b, r in arcs if a in frontier}
        want |= {(f"n{b}" if b else "fNone", d, r) for b, r in met}
        frontier = {b for b, _ in met if b}
    got = graph.call_chain(f, calls(spark, arcs), "n1", 3, "callees")
    assert {(r.name, r.depth, r.resolution) for r in got.collect()} == want


def test_closure_with_a_cycle(spark):
    rows = [("A", "B", 0), ("A", "C", 1), ("B", "D", 0), ("C", "D", 0), ("D", "A", 0)]
    bases = spark.createDataFrame(rows, "class_name string, base_name string, ord int")
    got = {(r.class_name, r.ancestor): r.level for r in graph.inheritance_closure(bases).collect()}
    assert got["A", "B"] == got["A", "C"] == 1 and got["A", "D"] == 2 and ("A", "A") not in got and got["D", "C"] == 2


RESOLVER_CASES = [
    ("bare, own file", {"callee_name": "Helper", "file_path": "a.go"}, ("same-file", 1)),
    ("bare, other file", {"callee_name": "Helper", "file_path": "z.go"}, ("same-package", 1)),
    ("typed", {"callee_name": "Start", "receiver_kind": "var", "receiver_name": "e", "receiver_type": "Engine"}, ("receiver-typed", 3)),
    ("typed otherwise", {"callee_name": "Start", "receiver_kind": "var", "receiver_name": "s", "receiver_type": "Server"}, ("receiver-typed", 4)),
    ("import", {"callee_name": "Run", "receiver_kind": "import", "receiver_name": "x"}, ("import-qualified", None)),
    ("other package", {"callee_name": "Run", "receiver_kind": "import", "receiver_name": "x", "receiver_package": "app"}, ("cross-package", 2)),
    ("builtin", {"callee_name": "make"}, ("builtin", None)),
    ("unknown type", {"callee_name": "Start", "receiver_kind": "var", "receiver_name": "m", "receiver_type": "Mystery"}, ("unresolved", None)),
    ("no kind", {"callee_name": "Run", "receiver_name": "q"}, ("unresolved", None)),
    ("untyped language", {"callee_name": "Run", "language": "javascript"}, ("name-global", 2)),
    ("returned type", {"callee_name": "Start", "receiver_kind": "from-callee", "receiver_name": "e", "receiver_from_callee": "New"}, ("receiver-typed", 3)),
    ("unknown function", {"callee_name": "Start", "receiver_kind": "from-callee", "receiver_name": "e", "receiver_from_callee": "Mystery"}, ("unresolved", None)),
    ("field", {"callee_name": "Start", "receiver_kind": "field", "receiver_name": "s.e", "receiver_type": "Server", "receiver_field": "engine"}, ("receiver-typed", 3)),
    ("no such field", {"callee_name": "Start", "receiver_kind": "field", "receiver_name": "s.x", "receiver_type": "Server", "receiver_field": "x"}, ("unresolved", None)),
    ("global", {"callee_name": "Start", "receiver_kind": "maybe-global", "receiver_name": "main"}, ("receiver-typed", 3)),
    ("constructor", {"callee_name": "Engine"}, ("constructor", None)),
    ("inherited", {"callee_name": "Start", "receiver_kind": "var", "receiver_name": "t", "receiver_type": "Turbo"}, ("receiver-typed", 3)),
    ("imported symbol", {"callee_name": "alias", "imported_origin": "Run", "imported_module_root": ""}, ("import-symbol", 2)),
    ("foreign symbol", {"callee_name": "alias", "imported_origin": "Run", "imported_module_root": "urllib"}, ("unresolved", None)),
]


def test_resolver_cases(spark):
    f = functions(spark, [
        (1, "Helper", "a.go", "func", None, "app", None), (2, "Run", "b.go", "func", None, "app", None), (3, "Start", "c.go", "method", "Engine", "app", None),
        (4, "Start", "d.go", "method", "Server", "app", None), (5, "New", "c.go", "func", None, "app", "Engine"),
    ])
    hints = ["callee_name", "file_path", "language", "receiver_name", "receiver_kind", "receiver_type", "receiver_from_callee", "receiver_field", "receiver_package", "imported_origin", "imported_module_root", "package"]
    rows = [tuple({"file_path": "z.go", "language": "go", "package": "app", **case}.get(h) for h in hints) + (name,) for name, case, _ in RESOLVER_CASES]
    sites = spark.createDataFrame(rows, ", ".join(f"{h} string" for h in [*hints, "case"]))
    types = spark.createDataFrame([("Engine", "type"), ("Server", "type")], "name string, kind string")
    bases = spark.createDataFrame([("Turbo", "Engine", 0)], "class_name string, base_name string, ord int")
    fields = spark.createDataFrame([("Server", "engine", "Engine")], "struct_type string, field_name string, field_type string")
    variables = spark.createDataFrame([("app", "main", "Engine")], "package string, name string, var_type string")
    got = {r["case"]: (r.resolution, r.callee_id) for r in resolve.resolve_calls(sites, f, types, bases, fields, variables).collect()}
    assert got == {name: want for name, _, want in RESOLVER_CASES}


def test_aggregates(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("b", "x", 3), ("b", "y", 4), ("c", "", 5), ("c", "z", 6)], "k string, v string, o int")
    assert {r.k: r.v for r in aggregates.sole_value(df, ["k"], "v").collect()} == {"a": "x"}
    assert {r.k: r.v for r in aggregates.first_nonempty(df, ["k"], "v", "o").collect()} == {"a": "x", "b": "x", "c": "z"}
    assert {r.k: r.o for r in aggregates.keep_last(df, ["k"], "o").collect()} == {"a": 2, "b": 4, "c": 6}
    assert {r.k: r.v for r in aggregates.unique_best(df, ["k"], "v").collect()} == {"b": "x", "c": ""}
    with pytest.raises(ValueError):
        edges.markers_at_least("certain")
    assert edges.markers_at_least("receiver-typed") == ["receiver-typed", "same-file", "same-package"]
    assert "import-symbol" in edges.markers_at_least("same-package", strict_ranks=False)


def test_statistics(spark):
    d = [1.5, -0.5, 2.0, 0.0, -1.5, 3.0, 0.5, 0.5]
    df = spark.createDataFrame([(x,) for x in d], "delta double")
    nz = sorted((abs(x), x) for x in d if x)
    ranks = defaultdict(list)
    for i, (a, _) in enumerate(nz, 1):
        ranks[a].append(i)
    w = sum(sum(ranks[a]) / len(ranks[a]) for a, x in nz if x > 0)
    got = evaluate.wilcoxon(df).first()
    n = len(nz)
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    assert (got.n, got.w_plus) == (n, w) and got.z == pytest.approx(z) and got.p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-6)
    assert evaluate.cliffs_delta(df).first()[0] == pytest.approx(3 / 8) and evaluate.median_delta(df).first()[0] == 0.5
    pairs = spark.createDataFrame([(False, True)] * 8 + [(True, False)] * 2 + [(True, True)] * 5, "a boolean, b boolean")
    m = evaluate.mcnemar(pairs, "a", "b").first()
    assert (m.b01, m.b10) == (8, 2) and m.chi2 == pytest.approx(2.5) and m.p == pytest.approx(math.erfc(math.sqrt(1.25)), abs=1e-6)
    a, b = (evaluate.bootstrap_ci(d, 200, spark=spark).first() for _ in range(2))
    assert a == b and a.low <= 0.5 <= a.high
    runs = spark.createDataFrame([("t1", "g", 1.0), ("t1", "m", 3.0), ("t2", "g", 1.0)], "task string, arm string, v double")
    assert [r.delta for r in evaluate.paired(runs, "task", "arm", "v", ("g", "m")).collect()] == [2.0]


def test_text_search_sources(spark):
    files = spark.createDataFrame([("a/x.py", "def f():\n    go()\n\ndef g():\n    pass\n    go()\n"), (".hid/y.py", "go()"), ("vendor/z.py", "go()")], "path string, text string")
    assert {r.path for r in evaluate.skip_noise(files).collect()} == {"a/x.py"}
    hits = evaluate.grep(evaluate.skip_noise(files), ["go"])
    assert [(r.line, r.text) for r in hits.orderBy("line").collect()] == [(2, "    go()"), (6, "    go()")]
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("i", "text")).select("path", (F.col("i") + 1).alias("line"), "text")
    assert {(r.line, r.name) for r in evaluate.enclosing_function(lines, hits).collect()} == {(2, "f"), (6, "g")}
    blobs = spark.createDataFrame([(bytearray(b"a\x00b"),), (bytearray(b"x" * 9000 + b"\x00"),), (bytearray(b""),)], "c binary")
    assert [r[0] for r in blobs.select(evaluate.is_binary(F.col("c"))).collect()] == [True, False, False]
    sets = spark.createDataFrame([(["a", "b", "b"], ["b", "c"]), ([], ["x"])], "f array<string>, e array<string>")
    assert [tuple(r[0]) for r in sets.select(evaluate.prf1(F.col("f"), F.col("e"))).collect()] == [(0.5, 0.5, 0.5), (0.0, 0.0, 0.0)]


def test_changes(spark):
    rows = [("a.go", "write", 0), ("node_modules/b.go", "write", 0), ("c.bin", "write", 0), ("d.py", "remove", 1), ("x/.reindex-queue", "create", 2), (".reindex-queue", "remove", 3), ("Dockerfile", "create", 3)]
    ev = spark.createDataFrame(rows, "path string, op string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert {(r.path, r.op) for r in changes.relevant(ev).collect()} == {("a.go", "upsert"), ("d.py", "delete"), ("x/.reindex-queue", "full"), ("Dockerfile", "upsert")}
    before = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "path string, modified int")
    after = spark.createDataFrame([("a", 1), ("b", 2), ("d", 1)], "path string, modified int")
    assert {tuple(r) for r in listing_changes(before, after).collect()} == {("b", "upsert"), ("c", "delete"), ("d", "upsert")}


def test_debounced_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    at = ["00.0", "00.3", "00.7", "05.0", "59.0"]
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps({"path": "a.go", "op": "write", "ts": f"2024-01-01T00:00:{t}Z"}) for t in at))
    (tmp_path / "in/2.json").write_text(json.dumps({"path": "z.go", "op": "write", "ts": "2024-01-01T01:00:00Z"}))
    q = debounced(change_stream(spark, f"{tmp_path}/in", 1)).writeStream.format("memory").queryName("bursts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.events for r in spark.table("bursts").where("path = 'a.go'").collect()) == [1, 1, 3]


def test_maintained_index(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def one():\n    return two()\n")
    store = Store(spark, f"file://{tmp_path}/store")
    store.index(str(src))
    (tmp_path / "ev").mkdir()

    def send(n, **event):
        (tmp_path / f"ev/{n}.json").write_text(json.dumps({"ts": f"2024-01-01T00:00:0{n}Z"} | event))
        maintain(store, change_stream(spark, f"{tmp_path}/ev"), str(src), f"{tmp_path}/ck", once=True).awaitTermination(240)

    (src / "b.py").write_text("def two():\n    return 1\n")
    send(1, path="b.py", op="create")
    assert {r.name for r in store.table("functions").collect()} == {"one", "two"}
    (src / "a.py").unlink()
    send(2, path="a.py", op="remove")
    assert {r.name for r in store.table("functions").collect()} == {"two"} and store.table("calls").isEmpty()
    (src / "c.py").write_text("def three():\n    pass\n")
    send(3, path=".reindex-queue", op="create")
    assert {r.name for r in store.table("functions").collect()} == {"two", "three"}
    assert store.table("changes").isEmpty() and store.health()["healthy"]


def until(done, seconds=120):
    import time

    end = time.time() + seconds
    while not done():
        assert time.time() < end
        time.sleep(0.5)


def test_a_burst_is_one_change(spark, tmp_path):
    """Events of a path that follow each other within the gap come out as one, with the last op; also the very last burst."""
    import time

    from codequarry.streaming.maintain import quiet

    (tmp_path / "in").mkdir()
    seen = []
    stream = quiet(change_stream(spark, f"{tmp_path}/in"), 3000).writeStream.foreachBatch(lambda b, i: seen.extend(tuple(r)[:2] for r in b.collect()))
    q = stream.option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="200 milliseconds").start()
    try:
        for i, (path, op) in enumerate([("a.go", "write"), ("b.go", "write"), ("a.go", "write"), ("b.go", "remove"), ("x.bin", "write")]):
            (tmp_path / f"in/.{i}").write_text(json.dumps({"path": path, "op": op, "ts": f"2024-01-01T00:00:0{i}Z"}))
            (tmp_path / f"in/.{i}").rename(tmp_path / f"in/{i}.json")
            time.sleep(0.3)
        until(lambda: len(seen) >= 2)
        time.sleep(1)
    finally:
        q.stop()
    assert sorted(seen) == [("a.go", "upsert"), ("b.go", "delete")]


def test_tree_source(spark, tmp_path):
    from codequarry.streaming.tree_source import TreeReader, tree_changes

    src = tmp_path / "src"
    (src / "node_modules").mkdir(parents=True)
    (src / "node_modules/x.py").write_text("x")
    (src / "a.py").write_text("def one():\n    return two()\n")
    reader = TreeReader(str(src), str(tmp_path / "state"))
    rows, first = reader.read(reader.initialOffset())
    assert [r[:2] for r in rows] == [("a.py", "upsert")] and list(reader.read(first)[0]) == []
    (src / "a.py").unlink()
    (src / "new").mkdir()
    (src / "new/b.py").write_text("y")
    rows, second = reader.read(first)
    want = [("a.py", "delete"), ("new/b.py", "upsert")]
    assert [r[:2] for r in rows] == want == [r[:2] for r in reader.readBetweenOffsets(first, second)]
    store = Store(spark, f"file://{tmp_path}/store")
    store.index(str(src))
    q = maintain(store, tree_changes(spark, str(src), f"{tmp_path}/q"), str(src), f"{tmp_path}/ck")
    try:
        (src / "c.py").write_text("def three():\n    pass\n")
        until(lambda: {r.name for r in store.table("functions").collect()} == {"three"})
        (src / ".reindex-queue").write_text("")
        until(lambda: not (src / ".reindex-queue").exists())
        n = store.manifest()["n"]
        (src / "c.py").unlink()
        until(lambda: store.table("functions").isEmpty())
    finally:
        q.stop()
    # the control file asked for one rebuild, and its removal for none
    assert store.manifest()["n"] == n + 1


def test_published_generator():
    """The draws of every stretch equal a plain run of the generator."""

    def plain(seed, n):
        state, inc, out = 0, seed << 1 | 1, []
        for k in range(n + 2):
            old, state = state, (state * 6364136223846793005 + inc) % 2**64
            if k == 0:
                state = (state + seed) % 2**64
            x, rot = (((old >> 18) ^ old) >> 27) & 0xFFFFFFFF, old >> 59
            out.append(((x >> rot) | (x << (-rot & 31))) & 0xFFFFFFFF)
        return out[2:]

    for seed in (1, 42, 2**40):
        want = plain(seed, 300)
        assert evaluate.pcg_draws(seed, 0, 300).tolist() == want and evaluate.pcg_draws(seed, 123, 7).tolist() == want[123:130] and evaluate.pcg_draws(seed, 5, 0).tolist() == []


def test_enclosing_function_equals_looking_up(spark):
    import random

    rng = random.Random(2)
    lines = [("f.py", i + 1, " " * rng.randrange(0, 9, 2) + rng.choice(["def f%d():" % i, "async def g%d():" % i, "x()", "y()"])) for i in range(200)]
    lines += [("g.py", 1, "x()"), ("g.py", 2, "def h():"), ("g.py", 3, "  x()")]

    def above(path, line, text):
        depth = len(text) - len(text.lstrip())
        for p, n, t in reversed([x for x in lines if x[0] == path and x[1] < line]):
            if "def " in t and len(t) - len(t.lstrip()) < depth:
                return t.split("def ")[1].split("(")[0]

    hits = [x for x in lines if "()" in x[2] and "def" not in x[2]] + [lines[20]]
    want = {(p, n, a) for p, n, t in hits if (a := above(p, n, t))}
    make = lambda rows: spark.createDataFrame(rows, "path string, line int, text string")
    assert {tuple(r) for r in evaluate.enclosing_function(make(lines), make(hits)).collect()} == want


def test_probe_and_arm_reports(spark):
    from codequarry.plans import reports

    plain = spark.createDataFrame([
        ("a.py", "def target():\n    pass\n"), ("b.py", "from a import target\n\ndef one():\n    target()\n"),
        ("c.py", "import a.target as hidden\nimport target as t2\n\ndef two():\n    t2()\n"),
    ], "path string, text string")
    probe = {"task_id": "A1", "symbol": "target", "expected": ["one", "two"]}
    scores = reports.run_probes(plain, [probe], lambda tool, symbol: '{"callers": [{"name": "one"}, {"name": "two"}, {"name": "three"}]}')
    got = {r.arm: (r.found, r.missed, round(r.recall, 2), round(r.precision, 2), r.calls) for r in scores.collect()}
    assert got[reports.ONE_SHOT] == (["one"], ["two"], 0.5, 1.0, 1) and got[reports.CHAINED] == (["one", "two"], [], 1.0, 1.0, 2)
    assert got[reports.INDEX] == (["one", "two"], [], 1.0, 0.67, 1)
    assert f"| {reports.ONE_SHOT} | 1/2 | 1.00 | 1 |" in reports.probe_report(scores)
    rows = [(f"t{i}", arm, "completed" if i < 9 or arm == "b" else "failed", 0.5 + 0.1 * (arm == "b"), 1000.0 - 100 * i * (arm == "b"), 5.0) for i in range(10) for arm in "ab"]
    text = reports.arms_report(spark.createDataFrame(rows, "task_id string, arm string, status string, quality double, tokens double, millis double"), ("a", "b"))
    assert "| quality | 9 | +0.10 | +0.10 to +0.10 | 9 | 0 |" in text and "| tokens | 9 | -400.00 |" in text and "| a | failed | 1 |" in text
