"""A streaming source of change events of a local source tree, made by comparing listings.

Comparing listings finds what a plain file source does not: deletions and edits in place, in new folders too.  Each
listing is kept as a file beside the query's state, and offsets number them, so a batch that is replayed gives the same events.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from codequarry.schema import IGNORED_DIRS

EVENTS = "path string, op string, ts timestamp"


def listing(root: str) -> dict[str, int]:
    """Relative path -> modification time in nanoseconds; ignored folders aren't entered, unreadable files are left out."""
    out: dict[str, int] = {}
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in IGNORED_DIRS)
        for name in names:
            path = os.path.join(folder, name)
            try:
                out[os.path.relpath(path, root)] = os.stat(path).st_mtime_ns
            except OSError:
                continue
    return out


def differences(before: dict[str, int], after: dict[str, int]) -> list[tuple[str, str]]:
    gone = [(p, "delete") for p in before.keys() - after.keys()]
    return sorted(gone + [(p, "upsert") for p, t in after.items() if before.get(p) != t])


class TreeReader(SimpleDataSourceStreamReader):
    def __init__(self, root: str, state: str):
        self.root, self.state = root, Path(state)
        self.state.mkdir(parents=True, exist_ok=True)

    def _load(self, n: int) -> dict:
        path = self.state / f"listing-{n}.json"
        return json.loads(path.read_text()) if n >= 0 and path.is_file() else {"at": 0.0, "files": {}}

    def initialOffset(self) -> dict:  # noqa: N802  the interface's name
        return {"n": -1}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        n, now = start["n"], listing(self.root)
        if n >= 0 and self._load(n)["files"] == now:
            return iter([]), start
        temp = self.state / f".listing-{n + 1}"
        temp.write_text(json.dumps({"at": time.time(), "files": now}))
        os.replace(temp, self.state / f"listing-{n + 1}.json")
        end = {"n": n + 1}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        after = self._load(end["n"])
        at = datetime.fromtimestamp(after["at"], UTC)
        return iter([(p, op, at) for p, op in differences(self._load(start["n"])["files"], after["files"])])

    def commit(self, end: dict) -> None:
        for old in self.state.glob("listing-*.json"):
            if int(old.stem.split("-")[1]) < end["n"]:
                old.unlink(missing_ok=True)


class TreeChanges(DataSource):
    """Options: ``root`` and ``state`` (a folder of this query's own)."""

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return EVENTS

    def simpleStreamReader(self, schema) -> TreeReader:  # noqa: ANN001, N802
        return TreeReader(self.options["root"], self.options["state"])


def tree_changes(spark: SparkSession, root: str, state: str):  # noqa: ANN201
    """A streaming DataFrame (path, op, ts) of what changes under a folder; its first batch is the whole tree."""
    spark.dataSource.register(TreeChanges)
    return spark.readStream.format("tree_changes").option("root", root).option("state", state).load()
