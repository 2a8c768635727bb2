"""Registered queries of extraction and of the calls that are built from it, over generated source files.

Each template below becomes one file for every row of a driver table, with ``{n}`` as the row's number.  What must come out is
written down as plain rows, by hand from the sources; the SQL form fills them in for every number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators import resolve
from codequarry.plans.views import table
from codequarry.session import bounded, cut
from codequarry.sources.extract import parse_files, symbol_tables

PYTHON = """import os
from lib.util import helper as h

class Base{n}:
    def run(self):
        return self.step()

    def step(self):
        return helper_{n}()

class Sub{n}(Base{n}):
    def go(self):
        self.run()
        os.getcwd()

def helper_{n}():
    return len([])

def make_{n}() -> Sub{n}:
    s = Sub{n}()
    s.run()
    return s
"""
GO = """package shop

import "strings"

type Shop{n} struct {
	clock Clock{n}
}

type Clock{n} struct{}

type Ticker{n} interface {
	Tick{n}() int
}

func (c Clock{n}) Tick{n}() int { return 1 }

func New{n}() *Shop{n} {
	return &Shop{n}{}
}

func (s *Shop{n}) Open(x string) int {
	strings.TrimSpace(x)
	return s.clock.Tick{n}() + len(x)
}

func Run{n}(t Ticker{n}) {
	s := New{n}()
	s.Open("a // no comment(")
	t.Tick{n}()
	Missing()
}
"""
TYPESCRIPT = """import { make } from "./util";

export interface Shape{n} {
  area(): number;
}

export class Box{n} implements Shape{n} {
  area(): number {
    return this.side();
  }

  side(): number {
    return parseInt("3");
  }
}

export function build{n}(): Box{n} {
  const b = new Box{n}();
  b.area();
  return b;
}
"""
RUBY = """class Dog{n}
  def bark_{n}
    say_{n}
  end

  def say_{n}
    puts("woof")
  end
end

def main_{n}
  bark_{n}()
end
"""
#: (template, path, driver table, its key)
SOURCES = [
    (PYTHON, "py/s{n}.py", "supplier", "s_suppkey"), (GO, "go/c{n}.go", "customer", "c_custkey"),
    (TYPESCRIPT, "web/n{n}.ts", "nation", "n_nationkey"), (RUBY, "rb/n{n}.rb", "nation", "n_nationkey"),
]
#: A table of keys is a few bytes a row, so Spark would read the keys of a million files in one task.
FILES_PER_TASK = 2_000


def files(spark: SparkSession, d: str) -> DataFrame:
    """path, content of all generated files."""

    def filled(texts: list[str]) -> Column:
        return F.replace(F.element_at(F.array(*map(F.lit, texts)), F.col("source")), F.lit("{n}"), F.col("n"))

    keys = (table(spark, d, name).select(F.lit(i).alias("source"), F.col(key).cast("string").alias("n")) for i, (_, _, name, key) in enumerate(SOURCES, 1))
    rows = reduce(DataFrame.unionByName, keys)
    dealt = rows.repartition(1 + rows.count() // FILES_PER_TASK)
    return dealt.select(filled([s[1] for s in SOURCES]).alias("path"), filled([s[0] for s in SOURCES]).cast("binary").alias("content"))


def tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return symbol_tables(cut(parse_files(files(spark, d)), "extracted"))


def _functions(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d)["functions"].select("file_path", "name", "kind", "start_line", "end_line", F.coalesce("receiver_type", F.lit("")).alias("receiver_type"), "exported")


def _types(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d)["types"].select("file_path", "name", "kind", "start_line", F.array_join("methods", ",").alias("methods"))


def _calls(spark: SparkSession, d: str) -> DataFrame:
    t = tables(spark, d)
    built = resolve.build_calls(t["call_sites"], t["functions"], t["types"], t["class_bases"], t["struct_fields"], t["package_vars"])
    (f,) = bounded(t["functions"])
    own = f.select(F.col("id").alias("caller_id"), F.col("name").alias("caller"))
    to = f.select(F.col("id").alias("callee_id"), F.concat_ws(".", F.when(F.col("receiver_type") != "", F.col("receiver_type")), "name").alias("target"))
    return built.join(own, "caller_id").join(to, "callee_id", "left").select("file_path", "caller", "line", "callee_name", "resolution", F.coalesce("target", F.lit("")).alias("target"))


#: For each source what must come out: functions, types and calls in the columns of the queries, but for the path.
EXPECTED = [
    (
        [("run", "method", 5, 6, "Base{n}", True), ("step", "method", 8, 9, "Base{n}", True), ("go", "method", 12, 14, "Sub{n}", True), ("helper_{n}", "func", 16, 17, "", True), ("make_{n}", "func", 19, 22, "", True)],
        [("Base{n}", "class", 4, ""), ("Sub{n}", "class", 11, "")],
        [
            ("run", 6, "step", "receiver-typed", "Base{n}.step"), ("step", 9, "helper_{n}", "same-file", "helper_{n}"), ("go", 13, "run", "receiver-typed", "Base{n}.run"),
            ("go", 14, "getcwd", "import-qualified", ""), ("helper_{n}", 17, "len", "builtin", ""), ("make_{n}", 20, "Sub{n}", "constructor", ""), ("make_{n}", 21, "run", "receiver-typed", "Base{n}.run"),
        ],
    ),
    (
        [("Tick{n}", "method", 15, 15, "Clock{n}", True), ("New{n}", "func", 17, 19, "", True), ("Open", "method", 21, 24, "Shop{n}", True), ("Run{n}", "func", 26, 31, "", True)],
        [("Shop{n}", "type", 5, ""), ("Clock{n}", "type", 9, ""), ("Ticker{n}", "interface", 11, "Tick{n}")],
        [
            ("Open", 22, "TrimSpace", "import-qualified", ""), ("Open", 23, "Tick{n}", "receiver-typed", "Clock{n}.Tick{n}"), ("Open", 23, "len", "builtin", ""),
            ("Run{n}", 27, "New{n}", "same-file", "New{n}"), ("Run{n}", 28, "Open", "receiver-typed", "Shop{n}.Open"), ("Run{n}", 29, "Tick{n}", "unresolved", ""),
            ("Run{n}", 29, "Tick{n}", "interface-dispatch", "Clock{n}.Tick{n}"), ("Run{n}", 30, "Missing", "unresolved", ""),
        ],
    ),
    (
        [("area", "method", 8, 10, "Box{n}", True), ("side", "method", 12, 14, "Box{n}", True), ("build{n}", "func", 17, 21, "", True)],
        [("Shape{n}", "interface", 3, "area"), ("Box{n}", "class", 7, "")],
        [("area", 9, "side", "receiver-typed", "Box{n}.side"), ("side", 13, "parseInt", "builtin", ""), ("build{n}", 19, "area", "receiver-typed", "Box{n}.area")],
    ),
    (
        [("bark_{n}", "func", 2, 4, "", False), ("say_{n}", "func", 6, 8, "", False), ("main_{n}", "func", 11, 13, "", False)],
        [("Dog{n}", "type", 1, "")],
        [("say_{n}", 7, "puts", "name-global", ""), ("main_{n}", 12, "bark_{n}", "name-global", "bark_{n}")],
    ),
]


def _sql(part: int, columns: list[str]) -> str:
    """The expected rows of one part for every number of each source's table."""

    def value(v: object) -> str:
        return f"replace('{v}', '{{n}}', k::VARCHAR)" if isinstance(v, str) else str(v).lower()

    out = []
    for (_, path, name, key), expected in zip(SOURCES, EXPECTED, strict=True):
        for row in expected[part]:
            picked = ", ".join(f"{value(v)} AS {c}" for v, c in zip((path, *row), ["file_path", *columns], strict=True))
            out.append(f"SELECT {picked} FROM (SELECT {key} AS k FROM {name})")
    return " UNION ALL ".join(out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"extract_functions": _functions, "extract_types": _types, "extract_calls": _calls}
SQL = {
    "extract_functions": _sql(0, ["name", "kind", "start_line", "end_line", "receiver_type", "exported"]),
    "extract_types": _sql(1, ["name", "kind", "start_line", "methods"]),
    "extract_calls": _sql(2, ["caller", "line", "callee_name", "resolution", "target"]),
}
