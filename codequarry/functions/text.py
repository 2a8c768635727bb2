"""Scalar functions as native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of an identifier: digits start one and keep the lower-case letters after them; an acronym ends before a capitalised word.
IDENTIFIER_WORD = r"[0-9]+[a-z]*|[A-Z]+(?![a-z])|[A-Z][a-z]*|[a-z]+"
TOKEN = r"[\p{L}\p{N}]+"


def split_identifier(name: Column) -> Column:
    """Words of an identifier joined by blanks; null if there are fewer than two."""
    words = F.regexp_extract_all(name, F.lit(IDENTIFIER_WORD), F.lit(0))
    return F.when(F.size(words) >= 2, F.array_join(words, " "))


def tokens(text: Column) -> Column:
    """Lower-case tokens of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def query_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0))


def query_terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))


def alphanumeric(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]", "")


def equal_fold(a: Column, b: Column) -> Column:
    """Equal but for ASCII letter case."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(a, upper, lower) == F.translate(b, upper, lower)


def truncated(text: Column, n: int, suffix: str = "...") -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit(suffix))).otherwise(text)


def is_exported(name: Column) -> Column:
    return name.rlike("^[A-Z]")


def location(path: Column, line: Column) -> Column:
    return F.concat_ws(":", path, line.cast("string"))


def top_level_dir(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(".")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def first_dotted(path: Column) -> Column:
    return F.substring_index(path, ".", 1)


def module_root(path: Column) -> Column:
    """First segment of a bare module specifier; empty for a relative one."""
    return F.when(path.startswith("."), "").otherwise(F.substring_index(path, "/", 1))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


#: Test files by the usual naming of each language (lower case).
TEST_FILE = r"_test\.(go|py)$|\.(test|spec)\.(ts|tsx|js|jsx)$|(^|/)test_"


def is_test_file(path: Column) -> Column:
    return F.lower(path).rlike(TEST_FILE)


def intent(query: Column) -> Column:
    """What a query is after; the first of these that holds."""
    q = F.lower(query)
    # fixed values: the words that tell it
    asks_definition = q.contains("where") & (q.contains("defined") | q.contains("definition"))
    asks_impact = q.rlike("depends on|what uses|callers|impact|breaks if") | (q.contains("where is") & q.contains("used"))
    asks_edit = q.rlike("edit|change|add |remove ")
    return F.when(asks_definition, "definition").when(asks_impact, "impact").when(asks_edit, "edit_target").otherwise("search")


def label(kind: Column) -> Column:
    """Label of a symbol's kind (``type/...``, method, property, anything else a function)."""
    k = F.lower(kind)
    sub = F.regexp_extract(k, "^type/(class|interface|enum|struct)", 1)
    return F.when(sub != "", sub).when(k.startswith("type/"), "type").when(k.isin("method", "property"), k).otherwise("function")


def priority(kind: Column) -> Column:
    name = label(kind)
    return F.when(name == "function", 1).when(name.isin("method", "property"), 2).otherwise(0)


def doc_title(content: Column, path: Column, kind: Column) -> Column:
    """First heading of a Markdown text, else the file's name."""
    head = F.trim(F.regexp_extract(content, r"(?m)^\s*#+[ \t]*([^\n]*)$", 1))
    return F.when((kind == "markdown") & (head != ""), head).otherwise(basename(path))


def interface_methods(definition: Column) -> Column:
    return F.regexp_extract_all(definition, F.lit(r"(?m)^\s*([A-Za-z_]\w*)\s*\("), F.lit(1))


def approx_tokens(text: Column) -> Column:
    return F.ceil(F.char_length(text) / F.lit(4)).cast("long")


def paths_in_text(text: Column) -> Column:
    """File paths that a text mentions, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_./-]+\.(?:go|py|ts|tsx|js|jsx|rs|java|c|cpp|h|rb|swift)\b"), F.lit(0)))


def paths_match(a: Column, b: Column) -> Column:
    """Equal, or one is a suffix of the other at a folder boundary."""
    return (a == b) | F.endswith(a, F.concat(F.lit("/"), b)) | F.endswith(b, F.concat(F.lit("/"), a))


def names_in_json(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r'"name"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))


def json_in_prose(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def query_words(name: str) -> list[str]:
    """Words of an identifier for query expansion: lower case, at least two characters, digits stay with the word before."""
    words = re.findall(r"[A-Z]+(?=[A-Z][a-z])[0-9]*|[A-Z]?[a-z]+[0-9]*|[A-Z]+[0-9]*|[0-9]+", name)
    return [w.lower() for w in words if len(w) >= 2]
