"""Schemas of the stored tables and the closed vocabularies."""

from __future__ import annotations

SCHEMA_VERSION = "10"

FUNCTIONS = (
    "id long, name string, name_parts string, file_path string, start_line int, end_line int, language string, exported boolean, "
    "code string, docstring string, signature string, kind string, receiver_type string, package string, return_type string"
)
#: Call sites keep the resolver's hints, so that edges can be resolved again without parsing.
CALL_SITES = (
    "file_path string, line int, callee_name string, language string, receiver_name string, receiver_kind string, receiver_type string, "
    "receiver_from_callee string, receiver_field string, receiver_package string, imported_origin string, imported_module_root string, ord int"
)
CALLS = "caller_id long, callee_id long, callee_name string, file_path string, line int, resolution string, receiver_name string"
TYPES = "id long, name string, name_parts string, file_path string, start_line int, kind string, definition string, exported boolean, methods array<string>"
IMPORTS = "file_path string, imported_path string, imported_symbols string"
STRUCT_FIELDS = "struct_type string, field_name string, field_type string, package string, file_path string"
PACKAGE_VARS = "name string, var_type string, package string, file_path string"
CLASS_BASES = "class_name string, base_name string, ord int, package string, file_path string"
DOCUMENTS = "id long, file_path string, title string, kind string, content string"
#: The search index: every token of the searched columns, and the tokens of each row.
POSTINGS = "corpus string, term string, id long, col string, pos int, file_path string"
LENGTHS = "corpus string, id long, d long, file_path string"
INDEX_ERRORS = "file_path string, error string, ts timestamp"
META = "key string, value string"
CHANGES = "file_path string, change_type string, ts timestamp"
FILES = "path string, content binary, length long, modified timestamp"

TABLES = {
    "functions": FUNCTIONS, "call_sites": CALL_SITES, "calls": CALLS, "types": TYPES, "imports": IMPORTS, "struct_fields": STRUCT_FIELDS,
    "package_vars": PACKAGE_VARS, "class_bases": CLASS_BASES, "documents": DOCUMENTS, "postings": POSTINGS, "lengths": LENGTHS, "index_errors": INDEX_ERRORS, "meta": META, "changes": CHANGES,
}

# Resolution markers, and the confidence ranks that queries can ask for.
RESOLUTIONS = [
    "same-file", "same-package", "import-symbol", "receiver-typed", "cross-package", "import-qualified", "builtin", "constructor",
    "name-global", "unresolved", "stale", "interface-dispatch",
]
RANKS = {"same-file": 5, "same-package": 4, "receiver-typed": 3, "interface-dispatch": 2, "name-global": 1}
#: Ranks for the two import markers too, for callers that don't want them dropped by every level.
WIDE_RANKS = RANKS | {"import-symbol": 4, "cross-package": 4}

# Languages by extension, and names by which a language's extensions can be asked for.
EXTENSIONS = {
    "ts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "py": "python", "pyi": "python",
    "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp",
    "rb": "ruby", "swift": "swift",
}
ALIASES = {
    "typescript": ["ts", "tsx"], "ts": ["ts", "tsx"], "tsx": ["tsx"], "javascript": ["js", "jsx", "mjs", "cjs"], "js": ["js", "jsx", "mjs", "cjs"],
    "jsx": ["jsx"], "python": ["py", "pyi"], "py": ["py", "pyi"], "go": ["go"], "golang": ["go"], "rust": ["rs"], "rs": ["rs"], "java": ["java"],
    "c": ["c", "h"], "cpp": ["cc", "cpp", "cxx", "hh", "hpp", "hxx"], "c++": ["cc", "cpp", "cxx", "hh", "hpp", "hxx"],
    "cxx": ["cc", "cpp", "cxx", "hh", "hpp", "hxx"], "ruby": ["rb"], "rb": ["rb"], "swift": ["swift"],
}
TYPED_LANGUAGES = ["go", "typescript", "tsx", "python"]

# Document kinds by extension, file names that are no documents, and folders that are never scanned.
DOCUMENT_KINDS = {
    "md": "markdown", "markdown": "markdown", "rst": "text", "txt": "text", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml",
    "proto": "proto", "graphql": "graphql", "graphqls": "graphql", "sql": "sql", "xml": "xml", "dockerfile": "dockerfile",
}
LOCK_FILES = [
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "npm-shrinkwrap.json", "Cargo.lock", "poetry.lock", "Pipfile.lock", "composer.lock",
    "Gemfile.lock", "go.sum", "flake.lock",
]
IGNORED_DIRS = [
    "node_modules", ".git", "dist", "build", "vendor", "__pycache__", ".quarry", ".venv", "venv", ".env", "env", ".tox", ".mypy_cache",
    ".pytest_cache", ".next", ".nuxt", ".output", "coverage", "target", ".cargo",
]

# Names that are part of each language.
BUILTINS = {
    "go": [
        "make", "len", "cap", "append", "copy", "delete", "new", "panic", "recover", "close", "print", "println", "complex",
        "real", "imag", "min", "max", "clear",
    ],
    "typescript": [
        "require", "parseInt", "parseFloat", "isNaN", "isFinite", "encodeURIComponent", "decodeURIComponent", "setTimeout",
        "setInterval", "clearTimeout", "clearInterval", "fetch", "structuredClone", "queueMicrotask",
    ],
    "python": [
        "print", "len", "range", "enumerate", "zip", "map", "filter", "sorted", "reversed", "sum", "min", "max", "abs", "open",
        "isinstance", "issubclass", "getattr", "setattr", "hasattr", "str", "int", "float", "bool", "list", "dict", "set",
        "tuple", "type", "super", "format", "repr", "hash", "iter", "next",
    ],
}
BUILTINS["tsx"] = BUILTINS["typescript"]
