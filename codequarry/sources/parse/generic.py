"""Extraction for JavaScript, Rust, Java, C, C++, Ruby and Swift: definitions by head patterns, calls by name, no receivers."""

from __future__ import annotations

import re

from codequarry.sources.parse.common import Lines, Parsed, mask, matching

_ID = r"[A-Za-z_$][\w$]*"
_CALL = re.compile(rf"({_ID})\s*[!]?\s*\(")

# Per language the heads of functions, of types, and of imports.
HEADS = {
    "javascript": (
        [rf"\bfunction\s*\*?\s*({_ID})\s*\(", rf"\b(?:const|let|var)\s+({_ID})\s*=\s*(?:async\s*)?(?:\([^()]*\)|{_ID})\s*=>", rf"^[ \t]+(?:async\s+|static\s+|get\s+|set\s+)*({_ID})\s*\([^()]*\)\s*(?=\{{)"],
        [rf"\bclass\s+({_ID})"],
        [r"^import\s+[^;\"']*?from\s*[\"']([^\"']+)", r"\brequire\(\s*[\"']([^\"']+)"],
    ),
    "rust": ([rf"\bfn\s+({_ID})\s*(?:<[^>]*>)?\s*\("], [rf"\b(?:struct|enum|trait|union)\s+({_ID})"], [r"^\s*(?:pub\s+)?use\s+([^;{]+)"]),
    "java": ([rf"^[ \t]*(?:[\w<>\[\],.?@]+\s+)+({_ID})\s*\([^;{{]*\)[^;{{]*(?=\{{)"], [rf"\b(?:class|interface|enum|record)\s+({_ID})"], [r"^import\s+(?:static\s+)?([^;]+)"]),
    "c": ([rf"^[A-Za-z_][\w\s*]*?\b({_ID})\s*\([^;{{}}]*\)\s*(?=\{{)"], [rf"\b(?:struct|enum|union)\s+({_ID})\s*(?=\{{)"], [r"^\s*#\s*include\s*[<\"]([^>\"]+)"]),
    "cpp": (
        [rf"^[ \t]*[A-Za-z_][\w\s*&:<>,~]*?\b({_ID})\s*\([^;{{}}]*\)[^;{{}}()]*(?=\{{)"], [rf"\b(?:class|struct|enum)\s+({_ID})[^;{{()]*(?=\{{)"], [r"^\s*#\s*include\s*[<\"]([^>\"]+)"],
    ),
    "ruby": ([r"^[ \t]*def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)"], [r"^[ \t]*(?:class|module)\s+([A-Z]\w*)"], [r"^\s*require(?:_relative)?\s*\(?\s*[\"']([^\"']+)"]),
    "swift": ([rf"\bfunc\s+({_ID})\s*(?:<[^>]*>)?\s*\("], [rf"\b(?:class|struct|enum|protocol|actor)\s+({_ID})"], [rf"^import\s+({_ID})"]),
}
HEADS["jsx"] = HEADS["javascript"]
_KEYWORDS = set("if for while switch catch function return sizeof match fn func def unless until elsif else new super loop do try guard defer in".split())
_RUBY_OPEN = re.compile(r"^[ \t]*(?:def|class|module|if|unless|while|until|case|begin|for)\b|\bdo\s*(?:\|[^|]*\|)?\s*$", re.M)


def _ruby_end(text: str, start: int) -> int:
    depth = 0
    for m in re.compile(r"^.*$", re.M).finditer(text, start):
        if _RUBY_OPEN.search(m[0]):
            depth += 1
        if re.match(r"\s*end\b", m[0]):
            depth -= 1
            if depth <= 0:
                return m.end()
    return len(text)


def parse(path: str, raw: str, language: str) -> Parsed:
    p, lines = Parsed(), Lines(raw)
    ruby = language == "ruby"
    text = mask(raw, "#", None, "\"'") if ruby else mask(raw, quotes='"`' if language in ("rust", "swift") else "\"'`")
    functions, types, imports = HEADS[language]
    bodies, heads = [], set()
    for rx in functions:
        for m in re.finditer(rx, text, re.M):
            name = m[1]
            if name in _KEYWORDS or m.start(1) in heads:
                continue
            if ruby:
                start, end = m.start(), _ruby_end(text, text.rfind("\n", 0, m.start(1)) + 1)
            else:
                brace = text.find("{", m.end())
                semi = text.find(";", m.end())
                if brace < 0 or 0 <= semi < brace:
                    continue
                start, end = brace, matching(text, brace)
            heads.add(m.start(1))
            bodies.append((start, end))
            p.function(name, lines.of(m.start(1)), lines.of(max(start, end - 1)), raw[start:end], exported=name[:1].isupper())
    for rx in types:
        for m in re.finditer(rx, text, re.M):
            brace = text.find("{", m.end())
            end = _ruby_end(text, m.start()) if ruby else matching(text, brace) if brace >= 0 else m.end()
            p.type(m[1], "type", lines.of(m.start(1)), raw[m.start() : end])
    for rx in imports:
        for m in re.finditer(rx, raw, re.M):
            p.imports.append({"imported_path": m[1].strip(), "imported_symbols": None})
    seen: set[int] = set()
    for a, b in bodies:
        for c in _CALL.finditer(text, a, b):
            if c.start() not in seen and c.start() not in heads and c[1] not in _KEYWORDS:
                seen.add(c.start())
                p.call(c[1], lines.of(c.start()))
    return p
