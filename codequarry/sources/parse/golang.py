"""Go extraction: patterns over masked text, with brace matching for spans."""

from __future__ import annotations

import re

from codequarry.sources.parse.common import Lines, Parsed, Spans, mask, matching

_ID = r"[A-Za-z_]\w*"
_FUNC = re.compile(rf"^func\s*(?:\(\s*(?:({_ID})\s+)?\*?({_ID})(?:\[[^\]]*\])?\s*\)\s*)?({_ID})\s*(?:\[[^\]]*\]\s*)?(?=\()", re.M)
_TYPE = re.compile(rf"^[ \t]*(?:type\s+)?({_ID})(?:\[[^\]=]*\])?\s*=?\s*(struct|interface)\s*(?=\{{)|^type\s+({_ID})(?:\[[^\]]*\])?\s+=?\s*([^\n{{]+)$", re.M)
_CALL = re.compile(rf"((?:{_ID}\s*\.\s*)*)({_ID})\s*(?=\()")
# The language's keywords that can stand before a bracket.
_KEYWORDS = {
    "if", "for", "switch", "select", "func", "return", "go", "defer", "range", "case", "var", "const", "type", "struct",
    "interface", "map", "chan", "else", "import", "package",
}
#: ``*pkg.Type`` with its bare name.
_BARE = rf"\*?(?:{_ID}\.)?({_ID})"


def _blocks(text: str, word: str):
    """(offset, body) of each top-level ``word (...)`` group or single declaration."""
    for m in re.finditer(rf"^{word}\b[ \t]*", text, re.M):
        if text[m.end() : m.end() + 1] == "(":
            yield m.end() + 1, text[m.end() + 1 : matching(text, m.end(), "()") - 1]
        else:
            end = text.find("\n", m.end())
            yield m.end(), text[m.end() : end if end >= 0 else len(text)]


def parse(path: str, raw: str) -> Parsed:
    p, text = Parsed(), mask(raw)
    lines = Lines(raw)
    m = re.search(rf"^package\s+({_ID})", text, re.M)
    package = m[1] if m else None
    aliases: dict[str, str] = {}
    for at, body in _blocks(text, "import"):
        for s in re.finditer(rf'(?:({_ID}|\.)[ \t]+)?"([^"]*)"', raw[at : at + len(body)]):
            alias = s[1] or s[2].rsplit("/", 1)[-1]
            p.imports.append({"imported_path": s[2], "imported_symbols": s[1]})
            aliases[alias] = s[2].rsplit("/", 1)[-1]
    for word in ("const", "var"):
        for at, body in _blocks(text, word):
            for s in re.finditer(rf"^[ \t]*({_ID}(?:[ \t]*,[ \t]*{_ID})*)[ \t]*(?:([*\w.\[\]]+)[ \t]*)?(?==|$)", body, re.M):
                for name in re.split(r"\s*,\s*", s[1]):
                    p.constant(name, lines.of(at + s.start(1)))
                    if word == "var" and s[2] and (t := re.fullmatch(_BARE, s[2])):
                        p.variables.append({"name": name, "var_type": t[1], "package": package})

    functions, spans = [], Spans()
    for f in _FUNC.finditer(text):
        after = matching(text, f.end(), "()")
        brace = text.find("{", after)
        line_end = text.find("\n", after)
        if brace < 0 or (0 <= line_end < brace):
            continue
        end = matching(text, brace)
        result = text[after:brace].strip()
        bare = re.fullmatch(_BARE, result) or re.fullmatch(rf"\(\s*{_BARE}\s*\)", result)
        start, stop = lines.of(f.start(3)), lines.of(end - 1)
        p.function(f[3], start, stop, raw[brace:end], exported=f[3][:1].isupper(), package=package, kind="method" if f[2] else "func", receiver_type=f[2], return_type=bare[1] if bare else None)
        local: dict[str, tuple[str, str]] = {}
        if f[1]:
            local[f[1]] = ("var", f[2])
        names: list[str] = []
        for part in text[f.end() + 1 : after - 1].split(","):
            words = part.split(None, 1)
            names += words[:1]
            if len(words) == 2:
                if t := re.fullmatch(_BARE, words[1].strip()):
                    local |= {n: ("var", t[1]) for n in names}
                names = []
        body = text[brace:end]
        for s in re.finditer(rf"\bvar\s+({_ID})\s+{_BARE}\b|\b({_ID})\s*:=\s*(?:&?\s*(?:{_ID}\.)?({_ID})\s*\{{|({_ID})\s*\()", body):
            if s[1]:
                local[s[1]] = ("var", s[2])
            elif s[4]:
                local[s[3]] = ("var", s[4])
            elif s[5] not in _KEYWORDS:
                local[s[3]] = ("from-callee", s[5])
        functions.append((brace, end))
        spans.add(start, stop, local)

    for t in _TYPE.finditer(text):
        if any(a <= t.start() < b for a, b in functions):
            continue
        name, line = t[1] or t[3], lines.of(t.start(1) if t[1] else t.start(3))
        if t[1]:
            end = matching(text, t.end())
            body = text[t.end() + 1 : end - 1]
            methods = re.findall(rf"^\s*({_ID})\s*\(", body, re.M) if t[2] == "interface" else []
            p.type(name, "interface" if t[2] == "interface" else "type", line, raw[t.start(2) : end], methods)
            if t[2] == "struct":
                for s in re.finditer(rf"^\s*({_ID}(?:\s*,\s*{_ID})*)\s+{_BARE}\s*(?:\"[^\n]*|`[^\n]*)?$", body, re.M):
                    for n in re.split(r"\s*,\s*", s[1]):
                        p.fields.append({"struct_type": name, "field_name": n, "field_type": s[2], "package": package})
        elif t[4].strip() not in ("(",):
            p.type(name, "type", line, t[4].strip())

    for a, b in functions:
        for c in _CALL.finditer(text, a, b):
            chain, callee = [x.strip() for x in c[1].split(".")[:-1]], c[2]
            back = c.start()
            while back and text[back - 1].isspace():
                back -= 1
            before = text[back - 1 : back]
            if callee in _KEYWORDS or before in (".", ")", "]") and not chain and before == ".":
                continue
            if re.search(r"\bfunc\s*$", text[max(0, c.start() - 6) : c.start()]):
                continue
            line = lines.of(c.start(2))
            local = spans.around(line) or {}
            if not chain:
                p.call(callee, line)
            elif len(chain) == 1:
                r = chain[0]
                if r in aliases and r not in local:
                    p.call(callee, line, receiver_name=r, receiver_kind="import", receiver_package=aliases[r])
                elif r in local:
                    kind, t = local[r]
                    p.call(callee, line, receiver_name=r, receiver_kind=kind, **{"receiver_type" if kind == "var" else "receiver_from_callee": t})
                else:
                    p.call(callee, line, receiver_name=r, receiver_kind="maybe-global")
            elif len(chain) == 2:
                base = local.get(chain[0])
                if base and base[0] == "var":
                    p.call(callee, line, receiver_name=".".join(chain), receiver_kind="field", receiver_type=base[1], receiver_field=chain[1])
                else:
                    p.call(callee, line, receiver_name=".".join(chain), receiver_kind="unresolved-field")
    return p
