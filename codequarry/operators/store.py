"""Versioned snapshots of the engine's tables, and the index build that fills them.

``manifests/<n>.json`` names the Parquet folders of each table: a base, and layers of later updates.  The highest number
counts.  A manifest is written under a temporary name and renamed to the next number, which fails if another writer has taken
it; so a reader sees the old state or the new one, whole, and a lost race is an error of the writer and never a lost update.
The last ``KEEP`` manifests stay for readers that hold them; older ones go, with the folders that only they name.

A layer holds the new rows of some files; the rows that these files had below it no longer count.  So an update writes what
changed and nothing else, and after ``MAX_LAYERS`` updates the layers are folded together.  Postings and lengths of the search
index are tables like the others.  Files go through Hadoop's file system, so the store may be anywhere that Spark can read and write.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators import search
from codequarry.operators.aggregates import file_summaries, symbols_in_file
from codequarry.operators.resolve import affected_sites, build_calls
from codequarry.schema import SCHEMA_VERSION, TABLES
from codequarry.session import cut
from codequarry.sources import files as fs
from codequarry.sources.extract import parse_files, symbol_tables

_SYMBOLS = ["functions", "call_sites", "types", "imports", "struct_fields", "package_vars", "class_bases", "documents"]
MAX_LAYERS = 8
#: Manifests that stay readable.
KEEP = 3
#: Changed files that one layer lists in the manifest; beyond them the whole tree is indexed, which gives the same tables.
MAX_CHANGED = 5000


class ConcurrentUpdate(RuntimeError):
    """Another writer has changed the store meanwhile."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(conf)
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._context = hadoop.FileContext.getFileContext(self._path(self.path).toUri(), conf)
        self._no_overwrite = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)

    # -- the manifest
    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n.split(".")[0].isdigit())

    def _read(self, n: int) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/manifests/{n}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"n": n}
        finally:
            stream.close()

    def manifest(self) -> dict:
        numbers = self._numbers()
        return self._read(numbers[-1]) if numbers else {"tables": {}, "meta": {}, "n": 0}

    def _flip(self, manifest: dict, after: int) -> None:
        """Make this the state that follows the one of number ``after``."""
        temp = self._path(f"{self.path}/manifests/{uuid.uuid4().hex}.temp")
        stream = self._fs.create(temp, True)
        stream.write(bytearray(json.dumps({k: v for k, v in manifest.items() if k != "n"}).encode()))
        stream.close()
        try:
            self._context.rename(temp, self._path(f"{self.path}/manifests/{after + 1}.json"), self._no_overwrite)
        except Exception as e:
            self._fs.delete(temp, False)
            raise ConcurrentUpdate(f"state {after + 1} was written by another") from e
        self._prune()

    def _prune(self) -> None:
        numbers = self._numbers()
        if len(numbers) <= KEEP:
            return

        def folders(n: int) -> set[str]:
            return {layer[k] for layers in self._read(n)["tables"].values() for layer in layers for k in ("path", "sites") if layer.get(k)}

        held = set().union(*(folders(n) for n in numbers[-KEEP:]))
        for n in numbers[:-KEEP]:
            for path in folders(n) - held:
                self._fs.delete(self._path(path), True)
            self._fs.delete(self._path(f"{self.path}/manifests/{n}.json"), False)

    # -- tables
    def table(self, name: str, manifest: dict | None = None) -> DataFrame:
        layers = (manifest or self.manifest())["tables"].get(name)
        if name == "meta":
            rows = [(k, v) for k, v in (manifest or self.manifest())["meta"].items()]
            return self.spark.createDataFrame(rows, TABLES[name])
        if not layers:
            return self.spark.createDataFrame([], TABLES[name])
        out: DataFrame | None = None
        for layer in layers:
            rows = self.spark.read.schema(TABLES[name]).parquet(layer["path"])
            if out is not None:
                if layer.get("files"):
                    out = out.where(~F.col("file_path").isin(layer["files"]))
                if layer.get("sites"):  # call sites that were resolved again
                    gone = self.spark.read.schema(_SITES).parquet(layer["sites"])
                    out = out.join(gone, [c.split()[0] for c in _SITES.split(", ")], "left_anti")
                rows = out.unionByName(rows)
            out = rows
        return out

    def is_empty(self) -> bool:
        return self.table("functions").isEmpty()

    def _write(self, rows: dict[str, DataFrame]) -> dict[str, str]:
        """Write tables side by side; name -> folder."""
        version = f"{datetime.now(UTC):%Y%m%d%H%M%S}-{uuid.uuid4().hex[:8]}"

        def one(item: tuple[str, DataFrame]) -> tuple[str, str]:
            name, df = item
            path = f"{self.path}/data/{name}/{version}"
            columns = [c.split()[0] for c in TABLES.get(name, _SITES).split(", ")]
            df.select(*columns).write.parquet(path)
            return name, path

        with ThreadPoolExecutor(len(rows) or 1) as pool:
            return dict(pool.map(one, rows.items()))

    def health(self) -> dict[str, object]:
        m = self.manifest()
        failed = self.table("index_errors", m).count()
        meta = m["meta"]
        return {
            "last_full_index": meta.get("last_full_index"), "last_incremental_update": meta.get("last_incremental_index"),
            "failed_files": failed, "healthy": failed == 0, "schema_version": meta.get("schema_version"),
        }

    # -- building
    def _parsed(self, files: DataFrame) -> dict[str, DataFrame]:
        parsed = cut(parse_files(files), "parsed")
        errors = parsed.where("error IS NOT NULL").select("file_path", "error", F.current_timestamp().alias("ts"))
        tables = symbol_tables(parsed) | {"documents": cut(fs.documents(files), "documents"), "index_errors": errors}
        return tables | self._search_tables(tables.__getitem__)

    @staticmethod
    def _search_tables(get: Callable[[str], DataFrame]) -> dict[str, DataFrame]:
        """Postings sorted by term, so that a query's filter skips most of a folder."""
        made = search.stored(get)
        return made | {"postings": made["postings"].sortWithinPartitions("corpus", "term")}

    def rebuild_search(self) -> None:
        """Write the search index again from the tables."""
        now = self.manifest()
        made = self._write(self._search_tables(lambda n: self.table(n, now)))
        self._flip({"tables": now["tables"] | {n: [{"path": p}] for n, p in made.items()}, "meta": now["meta"]}, now["n"])

    def _calls(self, sites: DataFrame, get: Callable[[str], DataFrame]) -> DataFrame:
        return build_calls(sites, get("functions"), get("types"), get("class_bases"), get("struct_fields"), get("package_vars"))

    def index(self, root: str, options: fs.ScanOptions | None = None) -> str:
        """Full build: everything is replaced."""
        old = self.manifest()
        made = self._write(self._parsed(fs.scan(self.spark, root, options)))
        new = {"tables": {n: [{"path": p}] for n, p in made.items()}, "meta": old["meta"] | _now("last_full_index")}
        calls = self._write({"calls": self._calls(self.table("call_sites", new), lambda n: self.table(n, new))})
        new["tables"]["calls"] = [{"path": calls["calls"]}]
        self._flip(new, old["n"])
        return made["functions"]

    def apply(self, changed: DataFrame, root: str, options: fs.ScanOptions | None = None) -> str:
        """Incremental update: the rows of changed files (path, op) are replaced by what the files hold now, and call sites
        anywhere that name a changed symbol are resolved again.  A store of another schema version is built anew, and so is one of
        which very many files changed."""
        ops = {r["path"]: r["op"] for r in changed.select("path", "op").limit(MAX_CHANGED + 1).collect()}
        names, old = sorted(ops), self.manifest()
        if len(ops) > MAX_CHANGED or old["meta"].get("schema_version", SCHEMA_VERSION) != SCHEMA_VERSION:
            return self.index(root, options)
        rows = self._parsed(fs.scan(self.spark, root, options, only=names))
        log = self.spark.createDataFrame(list(ops.items()), "file_path string, change_type string").withColumn("ts", F.current_timestamp())
        made = self._write(rows | {"changes": log})
        new = {"tables": {n: list(v) for n, v in old["tables"].items()}, "meta": old["meta"] | _now("last_incremental_index")}
        for n, path in made.items():
            new["tables"].setdefault(n, []).append({"path": path} if n == "changes" else {"path": path, "files": names})

        def before(name: str) -> DataFrame:
            return self.table(name, old).where(F.col("file_path").isin(names))

        def after(name: str) -> DataFrame:
            return self.spark.read.schema(TABLES[name]).parquet(made[name])

        sites = self.table("call_sites", new)
        own = F.col("file_path").isin(names)
        if _receivers_moved(before, after, self.table("types", new)):
            again = sites  # types of receivers changed: any typed call may resolve otherwise
        else:
            again = affected_sites(sites.where(~own), before("functions"), after("functions"), before("types"), after("types")).unionByName(sites.where(own))
        again = cut(again, "again")
        redone = self._calls(again, lambda n: self.table(n, new))
        extra = self._write({"calls": redone, "sites": again.select("file_path", "line", "callee_name").distinct()})
        new["tables"].setdefault("calls", []).append({"path": extra["calls"], "files": names, "sites": extra["sites"]})
        self._flip(new, old["n"])
        if len(new["tables"]["functions"]) > MAX_LAYERS:
            self.compact()
        return made["functions"]

    def compact(self) -> None:
        """Fold the layers of every table together."""
        now = self.manifest()
        rows = {n: self.table(n, now) for n in now["tables"]}
        if "postings" in rows:
            rows["postings"] = rows["postings"].repartitionByRange("corpus", "term").sortWithinPartitions("corpus", "term")
        made = self._write(rows)
        self._flip({"tables": {n: [{"path": p}] for n, p in made.items()}, "meta": now["meta"]}, now["n"])

    # -- derived
    def file_summaries(self) -> DataFrame:
        return file_summaries(self.table("functions"), self.table("types"), self.table("imports"))

    def symbols_in_file(self, path: str) -> DataFrame:
        return symbols_in_file(self.table("functions"), path).select("id", "name", "kind", "start_line", "end_line")


_SITES = "file_path string, line int, callee_name string"


def _now(key: str) -> dict[str, str]:
    return {"schema_version": SCHEMA_VERSION, key: datetime.now(UTC).isoformat(timespec="seconds")}


def _receivers_moved(before: Callable[[str], DataFrame], after: Callable[[str], DataFrame], types: DataFrame) -> bool:
    """Whether fields, globals, bases, interfaces, or methods that an interface names differ between two states of some files."""

    def state(get: Callable[[str], DataFrame]) -> DataFrame:
        def flat(name: str, *columns: str) -> DataFrame:
            return get(name).select(F.lit(name).alias("t"), F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("v"))

        rows = flat("struct_fields", "struct_type", "field_name", "field_type")
        rows = rows.unionByName(flat("package_vars", "package", "name", "var_type")).unionByName(flat("class_bases", "class_name", "base_name", "ord"))
        faces = get("types").where("kind = 'interface'").select(F.lit("i").alias("t"), F.concat_ws("\x00", "name", F.array_join("methods", ",")).alias("v"))
        named = types.where("kind = 'interface'").select(F.explode("methods").alias("name")).distinct()
        methods = get("functions").where("kind = 'method'").join(named, "name", "left_semi")
        return rows.unionByName(faces).unionByName(methods.select(F.lit("m").alias("t"), F.concat_ws("\x00", "name", F.coalesce("receiver_type", F.lit(""))).alias("v")))

    # a multiset of the one state must equal the other's: counts cancel out
    both = state(before).withColumn("n", F.lit(1)).unionByName(state(after).withColumn("n", F.lit(-1)))
    return not both.groupBy("t", "v").agg(F.sum("n").alias("n")).where("n != 0").isEmpty()
