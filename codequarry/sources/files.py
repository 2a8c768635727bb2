"""File sources: tree scan with ignore rules, documents, changed files of a git work tree."""

from __future__ import annotations

import os
import re
import subprocess
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.text import doc_title
from codequarry.schema import ALIASES, DOCUMENT_KINDS, EXTENSIONS, FILES, IGNORED_DIRS, LOCK_FILES

MAX_FILE_SIZE = 1 << 20


def glob_regex(glob: str) -> str:
    """``*`` and ``?`` stay within a path segment; no ``**``."""
    out = ""
    for part in re.findall(r"\*|\?|\[[^\]]*\]|[^*?\[]+|\[", glob):
        out += "[^/]*" if part == "*" else "[^/]" if part == "?" else part if part.startswith("[") and part.endswith("]") else re.escape(part)
    return out


def ignore_regex(patterns: list[str]) -> str | None:
    """One expression for a gitignore subset: folders (``x/``), globs (path or name), literals (path, name, folder within)."""
    out = []
    for line in patterns:
        p = line.strip()
        if not p or p.startswith(("#", "!")):
            continue
        p = p.lstrip("/")
        if p.endswith("/"):
            out.append(rf"(?:^|.*/){glob_regex(p[:-1])}/.*")
        elif any(c in p for c in "*?["):
            g = glob_regex(p)
            out += [g, rf"(?:.*/)?{g}"]
        else:
            q = re.escape(p)
            out.append(rf"(?:.*/)?{q}(?:/.*)?")
    return "^(?:" + "|".join(out) + ")$" if out else None


@dataclass
class ScanOptions:
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    max_file_size: int = MAX_FILE_SIZE

    def extensions(self) -> list[str]:
        return sorted({e for n in self.languages for e in ALIASES.get(n.strip().lower(), [])}) or list(EXTENSIONS)


def load_ignore(spark: SparkSession, root: str) -> list[str]:
    """Ignore lines of the root and, prefixed, of each first-level folder; read through Hadoop, so any scheme will do."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    base = hadoop(root if "://" in root else f"file://{os.path.abspath(root)}")
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())

    def lines(*parts: str) -> list[str]:
        path = base
        for p in parts:
            path = hadoop(path, p)
        if not fs.isFile(path):
            return []
        stream = fs.open(path)
        try:
            return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
        finally:
            stream.close()

    found = [line for parts in ((".gitignore",), (".contextignore",), (".quarry", "ignore")) for line in lines(*parts)]
    folders = [s.getPath().getName() for s in fs.listStatus(base) if s.isDirectory()] if fs.exists(base) else []
    for name in sorted(folders):
        found += [f"{name}/{x.strip().lstrip('/')}" for x in lines(name, ".gitignore") if x.strip() and not x.startswith(("#", "!"))]
    return found


def include_column(path: Column, globs: list[str]) -> Column:
    """A glob without ``/`` is held against the file's name, else against the path."""
    keep = F.lit(not globs)
    for g in globs:
        keep = keep | (path if "/" in g else F.substring_index(path, "/", -1)).rlike(f"^{glob_regex(g)}$")
    return keep


def wanted(path: Column, options: ScanOptions, ignore: list[str]) -> Column:
    ignored = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, IGNORED_DIRS)))
    rx = ignore_regex([*ignore, *options.exclude])
    keep = ~ignored & include_column(path, options.include)
    return keep & ~path.rlike(rx) if rx else keep


def doc_kind(path: Column) -> Column:
    """Kind of a document, null for other files."""
    name = F.substring_index(path, "/", -1)
    kinds = F.create_map(*[F.lit(x) for kv in DOCUMENT_KINDS.items() for x in kv])
    return (
        F.when(name.isin(LOCK_FILES) | name.contains(".min."), F.lit(None)).when((name == "Dockerfile") | name.startswith("Dockerfile."), "dockerfile")
        .otherwise(kinds[F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))])
    )


def scan(spark: SparkSession, root: str, options: ScanOptions | None = None, ignore: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """path (relative), content, length, modified of the files to index.

    Paths and sizes are judged on a listing without contents; then only the wanted files are read.  (Spark lists a tree on
    the driver in any case, so the names of its files fit there.)  With ``only`` (relative paths, a bounded list) just these
    are looked up, and the tree isn't listed.
    """
    options = options or ScanOptions()
    ignore = load_ignore(spark, root) if ignore is None else ignore
    base = root.rstrip("/") + "/"
    reader = spark.read.format("binaryFile").option("ignoreMissingFiles", "true")
    if only is None:
        listed = reader.option("recursiveFileLookup", "true").load(base).where(F.col("length") <= options.max_file_size)
        there = [r[0] for r in _wanted(listed, base, options, ignore, "path AS full").select("full").collect()]
    else:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(base).getFileSystem(spark._jsc.hadoopConfiguration())
        there = [base + p for p in only if fs.isFile(hadoop(base + p))]
    if not there:
        return spark.createDataFrame([], FILES)
    raw = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load([re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in there])
    return _wanted(raw.where(F.col("length") <= options.max_file_size), base, options, ignore, "content", "length", "modificationTime AS modified")


def _wanted(raw: DataFrame, base: str, options: ScanOptions, ignore: list[str], *columns: str) -> DataFrame:
    """The relative path and other columns of the files that are to be indexed."""
    plain = base.split("://", 1)[-1]
    relative = F.expr("substr(path, instr(path, %s) + %d)" % ("'" + plain.replace("'", "\\'") + "'", len(plain)))
    files = raw.select(relative.alias("_relative"), *map(F.expr, columns)).withColumnRenamed("_relative", "path")
    code = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(options.extensions())
    return files.where(wanted(F.col("path"), options, ignore) & (code | doc_kind(F.col("path")).isNotNull()))


def documents(files: DataFrame) -> DataFrame:
    """id, file_path, title, kind, content of the documents that are valid UTF-8."""
    docs = files.withColumn("kind", doc_kind(F.col("path"))).where("kind IS NOT NULL").where(F.is_valid_utf8(F.col("content").cast("string")))
    text = F.col("content").cast("string")
    key = F.call_function("shiftrightunsigned", F.xxhash64("path"), F.lit(1))
    return docs.select(key.alias("id"), F.col("path").alias("file_path"), doc_title(text, F.col("path"), F.col("kind")).alias("title"), "kind", text.alias("content"))


def changed_files(spark: SparkSession, root: str, rev: str = "HEAD") -> DataFrame:
    """path: files that differ from a revision, staged, or untracked; each once."""

    def git(*args: str) -> list[str]:
        out = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True, timeout=60)
        return [x for x in out.stdout.split("\0") if x]

    names = set(git("diff", "--name-only", "-z", rev)) | set(git("diff", "--name-only", "-z", "--cached")) | set(git("ls-files", "-z", "--others", "--exclude-standard"))
    return spark.createDataFrame([(n,) for n in sorted(names)], "path string")


def reflog_changes(spark: SparkSession, root: str) -> DataFrame:
    """path: files that the last move of HEAD changed; none where there was no move."""
    out = subprocess.run(["git", "-C", root, "diff", "--name-only", "-z", "HEAD@{1}", "HEAD"], capture_output=True, text=True, timeout=60)
    return spark.createDataFrame([(n,) for n in out.stdout.split("\0") if n] if out.returncode == 0 else [], "path string")
