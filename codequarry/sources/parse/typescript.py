"""TypeScript and TSX extraction: patterns over masked text, with brace matching for spans."""

from __future__ import annotations

import re

from codequarry.sources.parse.common import Lines, Parsed, Spans, mask, matching

_ID = r"[A-Za-z_$][\w$]*"
_CLASS = re.compile(rf"\bclass\s+({_ID})[^{{;]*?(?=\{{)")
_FUNC = re.compile(rf"\bfunction\s*\*?\s*({_ID})\s*(?:<[^>(]*>)?\s*(?=\()")
_ARROW = re.compile(rf"\b(?:const|let|var)\s+({_ID})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?=(?:<[^>(]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=\n{{]+)?=>|{_ID}\s*=>)")
_METHOD = re.compile(rf"^[ \t]*(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?\s*({_ID})\s*(?:<[^>(]*>)?\s*(?=\()", re.M)
_FIELD = re.compile(rf"^[ \t]*(?:(?:public|private|protected|static|readonly|declare)\s+)*({_ID})[?!]?\s*:\s*({_ID})", re.M)
_CALL = re.compile(rf"((?:{_ID}\s*\??\.\s*)*)({_ID})\s*(?:<[\w\s,.|]*>)?\s*(?=\()")
_KEYWORDS = set("if for while switch catch function return typeof new super await async of in do else constructor import export class throw delete void yield".split())


def _module_root(source: str) -> str:
    return "" if source.startswith(".") else source.split("/")[0]


def _params(text: str, start: int, end: int, local: dict) -> None:
    for m in re.finditer(rf"({_ID})\??\s*:\s*({_ID})", text[start:end]):
        local[m[1]] = ("var", m[2])


def parse(path: str, raw: str) -> Parsed:
    p, text, lines = Parsed(), mask(raw), Lines(raw)
    symbols: dict[str, tuple[str, str]] = {}
    modules: set[str] = set()
    for m in re.finditer(r"^import\s+(?:type\s+)?([^;\"']*?)\s*from\s*[\"']([^\"'\n]+)[\"']", raw, re.M):
        source = m[2]
        if ns := re.search(rf"\*\s*as\s+({_ID})", m[1]):
            p.imports.append({"imported_path": source, "imported_symbols": ns[1]})
            modules.add(ns[1])
        if named := re.search(r"\{([^}]*)\}", m[1]):
            for part in named[1].split(","):
                words = part.replace("type ", "").split()
                if words:
                    symbols[words[-1]] = (words[0], _module_root(source))

    depth0 = _top_level(text)
    for m in re.finditer(rf"^(?:export\s+)?(?:const|let)\s+({_ID})", text, re.M):
        if depth0(m.start()):
            p.constant(m[1], lines.of(m.start(1)))

    classes, class_spans = [], Spans()
    for m in _CLASS.finditer(text):
        end = matching(text, m.end())
        classes.append((m[1], m.end(), end))
        class_spans.add(lines.of(m.start()), lines.of(end - 1), m[1])
        p.type(m[1], "class", lines.of(m.start(1)), raw[m.start() : end], exported=True)
        inner = _top_level(text[m.end() + 1 : end - 1])
        for f in _FIELD.finditer(text[m.end() + 1 : end - 1]):
            if inner(f.start(1)):
                p.fields.append({"struct_type": m[1], "field_name": f[1], "field_type": f[2], "package": path})
    for m in re.finditer(rf"\binterface\s+({_ID})[^{{]*(?=\{{)", text):
        end = matching(text, m.end())
        p.type(m[1], "interface", lines.of(m.start(1)), raw[m.start() : end], re.findall(rf"^\s*({_ID})\??\s*\(", text[m.end() + 1 : end - 1], re.M), exported=True)
    for m in re.finditer(rf"^(?:export\s+)?type\s+({_ID})[^=\n]*=\s*([^;]*)", text, re.M):
        p.type(m[1], "type", lines.of(m.start(1)), m[2].strip(), exported=True)

    bodies, spans = [], Spans()

    def add(name: str, at: int, paren: int, owner: str | None, arrow: bool = False) -> None:
        local: dict[str, tuple[str, str]] = {}
        after = matching(text, paren, "()") if text[paren : paren + 1] == "(" else paren
        _params(text, paren, after, local)
        head = re.compile(r"\s*(?::\s*([^={\n;]+?))?\s*" + (r"=>\s*" if arrow else r"(?=\{)")).match(text, after)
        start = head.end() if head else after
        if arrow and text[start : start + 1] != "{":
            stop = re.compile(r";|\n(?=\S)|\Z").search(text, start)
            end = stop.start() if stop else len(text)
        elif text[start : start + 1] == "{":
            end = matching(text, start)
        else:
            return
        result = (head[1] or "").strip() if head else ""
        for s in re.finditer(rf"\b(?:const|let|var)\s+({_ID})\s*(?::\s*({_ID})[^=\n;]*)?(?:=\s*(?:await\s+)?(new\s+)?({_ID})\s*(?:<[^>(]*>)?\s*\()?", text[start:end]):
            if s[2]:
                local[s[1]] = ("var", s[2])
            elif s[4]:
                local[s[1]] = ("var", s[4]) if s[3] else ("from-callee", s[4])
        first, last = lines.of(at), lines.of(max(start, end - 1))
        p.function(
            name, first, last, raw[start:end], exported=True, package=path, kind="method" if owner else "func", receiver_type=owner,
            return_type=result if re.fullmatch(_ID, result) else None,
        )
        bodies.append((start, end))
        spans.add(first, last, local)

    for m in _FUNC.finditer(text):
        add(m[1], m.start(1), m.end(), None)
    for m in _ARROW.finditer(text):
        add(m[1], m.start(1), m.end() if text[m.end()] == "(" else text.find("=>", m.end()), None, arrow=True)
    for name, start, end in classes:
        inner = _top_level(text[start + 1 : end - 1])
        for m in _METHOD.finditer(text, start + 1, end - 1):
            if m[1] not in _KEYWORDS - {"constructor"} and inner(m.start(1) - start - 1):
                add(m[1], m.start(1), m.end(), name)

    seen: set[int] = set()
    heads = {m.start(1) for rx in (_FUNC, _METHOD) for m in rx.finditer(text) if rx is _FUNC or any(a < m.start() < b for _, a, b in classes)}
    for a, b in bodies:
        for c in _CALL.finditer(text, a, b):
            at = c.start(2)
            if at in seen or c[2] in _KEYWORDS or (at in heads and text[matching(text, c.end(), "()") :].lstrip()[:1] in "{:" and not c[1]):
                continue
            seen.add(at)
            before = text[: c.start()].rstrip()
            if before.endswith(".") or re.search(r"\bnew$", before):
                continue
            chain = [x.strip().rstrip("?") for x in c[1].split(".")[:-1]]
            line = lines.of(at)
            local, owner = spans.around(line) or {}, class_spans.around(line)
            if not chain:
                hints = dict(zip(("imported_origin", "imported_module_root"), symbols[c[2]], strict=True)) if c[2] in symbols else {}
                p.call(c[2], line, **hints)
            elif chain == ["this"]:
                p.call(c[2], line, receiver_name="this", receiver_kind="var", receiver_type=owner)
            elif chain[0] == "this" and len(chain) == 2:
                p.call(c[2], line, receiver_name=".".join(chain), receiver_kind="field", receiver_type=owner, receiver_field=chain[1])
            elif len(chain) == 1:
                r = chain[0]
                if r in local:
                    kind, t = local[r]
                    p.call(c[2], line, receiver_name=r, receiver_kind=kind, **{"receiver_type" if kind == "var" else "receiver_from_callee": t})
                elif r in modules or r in symbols:
                    p.call(c[2], line, receiver_name=r, receiver_kind="import")
                else:
                    p.call(c[2], line, receiver_name=r, receiver_kind="maybe-global")
            else:
                p.call(c[2], line, receiver_name=".".join(chain), receiver_kind="unresolved-field")
    return p


def _top_level(text: str):
    """Whether a position stands outside all braces of the text."""
    at, depth, marks = [], 0, []
    for m in re.finditer(r"[{}]", text):
        depth += 1 if m[0] == "{" else -1
        at.append(m.start())
        marks.append(depth)

    def outside(pos: int) -> bool:
        from bisect import bisect_left

        i = bisect_left(at, pos)
        return i == 0 or marks[i - 1] == 0

    return outside
