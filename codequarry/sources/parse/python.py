"""Python extraction over the standard library's syntax tree, with a line-based fallback for files that don't parse."""

from __future__ import annotations

import ast
import re

from codequarry.sources.parse.common import Parsed


def _simple(node: ast.expr | None) -> str | None:
    """Bare name of an annotation."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return node.attr
    if isinstance(node, ast.Constant) and isinstance(node.value, str) and node.value.isidentifier():
        return node.value
    return None


class _Visitor(ast.NodeVisitor):
    def __init__(self, path: str, text: str):
        self.p, self.path, self.lines = Parsed(), path, text.split("\n")
        self.classes: list[str] = []
        self.scopes: list[dict[str, tuple[str, str]]] = []
        self.modules: dict[str, str] = {}
        self.symbols: dict[str, tuple[str, str]] = {}

    # -- definitions
    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.p.type(node.name, "class", node.lineno, "\n".join(self.lines[node.lineno - 1 : node.end_lineno]))
        for i, b in enumerate(n for n in node.bases if isinstance(n, ast.Name)):
            self.p.bases.append({"class_name": node.name, "base_name": b.id, "ord": i, "package": self.path})
        self.classes.append(node.name)
        scopes, self.scopes = self.scopes, []
        for child in node.body:
            if isinstance(child, ast.AnnAssign) and isinstance(child.target, ast.Name) and (t := _simple(child.annotation)):
                self._field(child.target.id, t)
            self.visit(child)
        self.scopes = scopes
        self.classes.pop()

    def _field(self, name: str, kind: str) -> None:
        self.p.fields.append({"struct_type": self.classes[-1], "field_name": name, "field_type": kind, "package": self.path})

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        method = bool(self.classes) and not self.scopes
        body = "\n".join(self.lines[node.body[0].lineno - 1 : node.end_lineno])
        self.p.function(
            node.name, node.lineno, node.end_lineno, body, exported=True, package=self.path, kind="method" if method else "func",
            receiver_type=self.classes[-1] if method else None, return_type=_simple(node.returns), docstring=ast.get_docstring(node),
        )
        local: dict[str, tuple[str, str]] = {}
        a = node.args
        for arg in [*a.posonlyargs, *a.args, *a.kwonlyargs]:
            if t := _simple(arg.annotation):
                local[arg.arg] = ("var", t)
        self.scopes.append(local)
        for child in ast.walk(node):
            if isinstance(child, ast.Assign) and isinstance(child.value, ast.Call) and isinstance(child.value.func, ast.Name):
                for t in child.targets:
                    if isinstance(t, ast.Name):
                        local[t.id] = ("from-callee", child.value.func.id)
                    elif isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self" and method:
                        self._field(t.attr, child.value.func.id)
            elif isinstance(child, ast.AnnAssign) and isinstance(child.target, ast.Name) and (t := _simple(child.annotation)):
                local[child.target.id] = ("var", t)
        for d in node.decorator_list:
            self.visit(d)
        for child in node.body:
            self.visit(child)
        self.scopes.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    # -- imports
    def visit_Import(self, node: ast.Import) -> None:
        for n in node.names:
            self.p.imports.append({"imported_path": n.name, "imported_symbols": n.asname})
            self.modules[n.asname or n.name.split(".")[0]] = n.name

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = "." * node.level + (node.module or "")
        self.p.imports.append({"imported_path": module, "imported_symbols": None})
        root = "" if node.level else module.split(".")[0]
        for n in node.names:
            if n.name != "*":
                self.symbols[n.asname or n.name] = (n.name, root)

    # -- calls
    def visit_Call(self, node: ast.Call) -> None:
        f = node.func
        if isinstance(f, ast.Name):
            hints = {}
            if f.id in self.symbols:
                hints = dict(zip(("imported_origin", "imported_module_root"), self.symbols[f.id], strict=True))
            self.p.call(f.id, f.lineno, **hints)
        elif isinstance(f, ast.Attribute):
            self.p.call(f.attr, f.end_lineno, **self._receiver(f.value))
        self.generic_visit(node)

    def _receiver(self, v: ast.expr) -> dict[str, str | None]:
        own = self.classes[-1] if self.classes else None
        if isinstance(v, ast.Name):
            if v.id == "self" and own:
                return {"receiver_name": "self", "receiver_kind": "var", "receiver_type": own}
            for scope in reversed(self.scopes):
                if v.id in scope:
                    kind, t = scope[v.id]
                    return {"receiver_name": v.id, "receiver_kind": kind, "receiver_type" if kind == "var" else "receiver_from_callee": t}
            if v.id in self.modules or v.id in self.symbols:
                return {"receiver_name": v.id, "receiver_kind": "import"}
            return {"receiver_name": v.id, "receiver_kind": "maybe-global"}
        if isinstance(v, ast.Attribute) and isinstance(v.value, ast.Name):
            name = f"{v.value.id}.{v.attr}"
            if v.value.id == "self" and own:
                return {"receiver_name": name, "receiver_kind": "field", "receiver_type": own, "receiver_field": v.attr}
            return {"receiver_name": name, "receiver_kind": "unresolved-field"}
        return {"receiver_name": "?", "receiver_kind": "unresolved-field"}


def _constants(p: Parsed, body: list[ast.stmt]) -> None:
    for node in body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        for t in targets:
            if isinstance(t, ast.Name):
                p.constant(t.id, node.lineno)
        if isinstance(node, ast.If):
            _constants(p, node.body)
            _constants(p, node.orelse)
        elif isinstance(node, ast.Try):
            for part in (node.body, *(h.body for h in node.handlers), node.orelse, node.finalbody):
                _constants(p, part)


def parse(path: str, text: str) -> Parsed:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _fallback(path, text)
    v = _Visitor(path, text)
    # imports first: a call may stand above the import in the file
    for node in ast.walk(tree):
        if isinstance(node, ast.Import | ast.ImportFrom):
            v.visit(node)
    v.p.imports.clear()
    v.visit(tree)
    _constants(v.p, tree.body)
    return v.p


def _fallback(path: str, text: str) -> Parsed:
    p, lines = Parsed(), text.split("\n")
    for i, line in enumerate(lines):
        if m := re.match(r"(\s*)(?:async\s+)?def\s+(\w+)\s*\(", line):
            end = i + 1
            while end < len(lines) and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip()) > len(m[1])):
                end += 1
            p.function(m[2], i + 1, end, "\n".join(lines[i + 1 : end]), exported=True, package=path, kind="method" if m[1] else "func")
        elif m := re.match(r"class\s+(\w+)", line):
            p.type(m[1], "class", i + 1, line)
        elif not line.lstrip().startswith("#"):
            for c in re.finditer(r"(?<![\w.])([A-Za-z_]\w*)\s*\(", line):
                if c[1] not in ("if", "elif", "while", "return", "and", "or", "not", "in", "print"):
                    p.call(c[1], i + 1)
    return p
