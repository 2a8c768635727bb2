"""Change events: filtering, debouncing and keep-last, in batch and in streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.schema import DOCUMENT_KINDS, EXTENSIONS, IGNORED_DIRS, LOCK_FILES

CONTROL_FILE = ".reindex-queue"
FULL, UPSERT, DELETE = "full", "upsert", "delete"


def relevant(events: DataFrame) -> DataFrame:
    """Events (path, op, ts) on files that the engine indexes, and the control file as a full rebuild; its removal is no event."""
    parts = F.split("path", "/")
    name, ext = F.element_at(parts, -1), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = ext.isin(list(EXTENSIONS) + list(DOCUMENT_KINDS)) | (name == "Dockerfile") | name.startswith("Dockerfile.")
    ignored = F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED_DIRS))) | name.isin(LOCK_FILES) | name.contains(".min.")
    gone = F.col("op").isin("remove", "rename", DELETE)
    control = F.coalesce(name == CONTROL_FILE, F.lit(False))
    full = (control & ~gone) | (F.col("op") == FULL)
    return events.where(full | (known & ~ignored & ~control)).withColumn("op", F.when(full, FULL).when(gone, DELETE).otherwise(UPSERT))


def debounce(events: DataFrame, keys: list[str], gap: str = "500 milliseconds", ts: str = "ts") -> DataFrame:
    """One row per burst: events of a key that follow each other within the gap."""
    burst = events.groupBy(*keys, F.session_window(ts, gap).alias("_w"))
    return burst.agg(F.min(ts).alias("first_event"), F.max(ts).alias("last_event"), F.count("*").alias("events")).drop("_w")


def latest_changes(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each key; an arg-max, so no key is sorted or held as a whole."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v")).select(*keys, "_v.*")
