"""Extraction of symbols and call sites: one Arrow pass over the files, then flat tables."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codequarry.functions.text import split_identifier
from codequarry.schema import EXTENSIONS
from codequarry.sources.parse import generic, golang, python, typescript
from codequarry.sources.parse.common import Parsed

_PARTS = {
    "functions": "name string, start_line int, end_line int, exported boolean, code string, docstring string, signature string, kind string, receiver_type string, package string, return_type string, nth int",
    "calls": "callee_name string, line int, receiver_name string, receiver_kind string, receiver_type string, receiver_from_callee string, receiver_field string, receiver_package string, imported_origin string, imported_module_root string",
    "types": "name string, kind string, start_line int, definition string, methods array<string>, exported boolean, nth int",
    "imports": "imported_path string, imported_symbols string",
    "fields": "struct_type string, field_name string, field_type string, package string",
    "variables": "name string, var_type string, package string",
    "bases": "class_name string, base_name string, ord int, package string",
}
_SCHEMA = "file_path string, language string, error string, " + ", ".join(f"{k} array<struct<{v.replace(' ', ':').replace(',:', ', ')}>>" for k, v in _PARTS.items())


def parse_source(path: str, text: str, language: str) -> Parsed:
    if language == "python":
        return python.parse(path, text)
    if language == "go":
        return golang.parse(path, text)
    if language in ("typescript", "tsx"):
        return typescript.parse(path, text)
    return generic.parse(path, text, language)


def _number(p: Parsed) -> None:
    """Tell equal definitions of one file apart by their order."""
    for records in (p.functions, p.types):
        seen: Counter = Counter()
        for r in records:
            key = (r["name"], r["kind"], r.get("receiver_type"))
            r["nth"] = seen[key]
            seen[key] += 1


def parse_files(files: DataFrame) -> DataFrame:
    """One row per file (path, content): its records as arrays; a file that can't be read or parsed has an error."""
    schema = to_arrow_schema(T._parse_datatype_string(_SCHEMA))
    languages = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    known = files.withColumn("language", languages[F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))]).where("language IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content, language in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                error, parsed = None, Parsed()
                try:
                    parsed = parse_source(path, (content or b"").decode("utf-8", "replace"), language)
                except Exception as e:  # one bad file must not end the index; it is reported in index_errors
                    error = f"{type(e).__name__}: {e}"[:500]
                _number(parsed)
                rows.append({"file_path": path, "language": language, "error": error} | {k: getattr(parsed, k) for k in _PARTS})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return known.select("path", "content", "language").mapInArrow(run, _SCHEMA)


def symbol_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """The flat tables of *materialized* parse results.

    Ids are hashes of file, name and kind: stable over runs, edits elsewhere and moved lines, and made without ordering all rows.
    """

    def flat(part: str) -> DataFrame:
        return parsed.select("file_path", "language", F.posexplode(part).alias("ord", "r")).select("file_path", "language", "ord", "r.*")

    def with_id(df: DataFrame, *more: str) -> DataFrame:
        key = F.xxhash64("file_path", "name", "kind", "nth", *more)
        return df.withColumn("id", F.call_function("shiftrightunsigned", key, F.lit(1))).withColumn("name_parts", split_identifier(F.col("name")))

    bases = parsed.select("file_path", F.explode("bases").alias("r")).select("file_path", "r.*")
    return {
        "functions": with_id(flat("functions"), "receiver_type").drop("ord", "nth"),
        "call_sites": flat("calls"),
        "types": with_id(flat("types")).drop("ord", "nth", "language"),
        "imports": flat("imports").drop("ord", "language"),
        "struct_fields": flat("fields").drop("ord", "language"),
        "package_vars": flat("variables").drop("ord", "language"),
        "class_bases": bases,
    }
