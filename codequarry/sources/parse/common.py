"""Shared pieces of the extractors: masking of comments and strings, spans, records."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

CODE_CHARS, DEFINITION_CHARS = 500, 300


@dataclass
class Parsed:
    functions: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    types: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    fields: list[dict] = field(default_factory=list)
    variables: list[dict] = field(default_factory=list)
    bases: list[dict] = field(default_factory=list)

    def function(self, name: str, start: int, end: int, code: str, **more) -> None:
        self.functions.append({"name": name, "start_line": start, "end_line": end, "code": cut(code, CODE_CHARS), "signature": name, "kind": "func"} | more)

    def call(self, callee: str, line: int, **hints) -> None:
        self.calls.append({"callee_name": callee, "line": line} | hints)

    def type(self, name: str, kind: str, line: int, definition: str, methods: list[str] | None = None, exported: bool | None = None) -> None:
        exported = name[:1].isupper() if exported is None else exported
        self.types.append({"name": name, "kind": kind, "start_line": line, "definition": cut(definition, DEFINITION_CHARS), "methods": methods or [], "exported": exported})

    def constant(self, name: str, line: int) -> None:
        self.type(name, "constant", line, name)


def cut(text: str, n: int) -> str:
    return text if len(text) <= n else text[:n] + "..."


class Lines:
    def __init__(self, text: str):
        self.at = [0] + [m.end() for m in re.finditer("\n", text)]

    def of(self, pos: int) -> int:
        return bisect_right(self.at, pos)


def mask(text: str, line_comment: str | None = "//", block: tuple[str, str] | None = ("/*", "*/"), quotes: str = "\"'`") -> str:
    """The text with comments and string contents blanked, positions and line ends kept."""
    marks = [re.escape(q) for q in quotes]
    if line_comment:
        marks.append(re.escape(line_comment))
    if block:
        marks.append(re.escape(block[0]))
    finder, out, at = re.compile("|".join(marks)), [], 0
    while m := finder.search(text, at):
        start, token = m.start(), m[0]
        out.append(text[at:start])
        if token == line_comment:
            end = text.find("\n", start)
            end = len(text) if end < 0 else end
            keep = 0
        elif block and token == block[0]:
            end = text.find(block[1], start + 2)
            end = len(text) if end < 0 else end + len(block[1])
            keep = 0
        else:
            end = start + 1
            while end < len(text) and text[end] != token and (text[end] != "\n" or token == "`"):
                end += 2 if text[end] == "\\" else 1
            end = min(len(text), end + 1)
            keep = 1
        body = text[start:end]
        out.append(body[:keep] + re.sub(r"[^\n]", " ", body[keep : len(body) - keep if keep else None]) + (body[len(body) - keep :] if keep and len(body) > 1 else ""))
        at = end
    out.append(text[at:])
    return "".join(out)


def matching(text: str, start: int, pair: str = "{}") -> int:
    """Position after the bracket that closes the one at ``start`` (the text is masked)."""
    depth = 0
    for m in re.compile("[" + re.escape(pair) + "]").finditer(text, start):
        depth += 1 if m[0] == pair[0] else -1
        if depth == 0:
            return m.end()
    return len(text)


class Spans:
    """Innermost of a file's named spans around a line."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int, object]] = []

    def add(self, start: int, end: int, value: object) -> None:
        self.spans.append((start, end, value))

    def around(self, line: int) -> object | None:
        best = None
        for s in self.spans:
            if s[0] <= line <= s[1] and (best is None or (s[0] >= best[0] and s[1] <= best[1])):
                best = s
        return best[2] if best else None
