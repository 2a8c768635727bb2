"""Edge filters and the joins of calls with functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.schema import RANKS, WIDE_RANKS


def markers_at_least(level: str, strict_ranks: bool = True) -> list[str]:
    """Markers whose confidence is ``level`` or better."""
    ranks = RANKS if strict_ranks else WIDE_RANKS
    if level not in ranks:
        raise ValueError(f"unknown confidence level {level!r}; known: {', '.join(ranks)}")
    return sorted(m for m, r in ranks.items() if r >= ranks[level])


def confidence(resolution: Column, level: str | None, strict_ranks: bool = True) -> Column:
    """Without a level all edges but interface dispatch; with one the markers that reach it."""
    if not level:
        return resolution != "interface-dispatch"
    return resolution.isin(markers_at_least(level, strict_ranks))


def direct_callers(calls: DataFrame, functions: DataFrame, name: str) -> DataFrame:
    callers = functions.select(F.col("id").alias("caller_id"), F.col("name").alias("caller_name"), F.col("file_path").alias("caller_file"))
    return calls.where(F.col("callee_name") == name).join(callers, "caller_id").select("caller_name", "caller_file", "line", "resolution")


def direct_callees(calls: DataFrame, functions: DataFrame, name: str) -> DataFrame:
    """Callees of every function of that name; those without a definition keep the name that was called."""
    seeds = functions.where(F.col("name") == name).select(F.col("id").alias("caller_id"))
    targets = functions.select(F.col("id").alias("callee_id"), F.col("name").alias("known"), F.col("file_path").alias("callee_file"))
    own = calls.join(seeds, "caller_id", "left_semi").join(targets, "callee_id", "left")
    return own.select(F.coalesce("known", "callee_name").alias("callee"), "callee_file", "line", "resolution")


def resolution_histogram(calls: DataFrame) -> DataFrame:
    return calls.groupBy("resolution").agg(F.count("*").alias("n"))


def edge_languages(calls: DataFrame, functions: DataFrame) -> DataFrame:
    lang = functions.select(F.col("id").alias("caller_id"), "language")
    return calls.join(lang, "caller_id").groupBy("language", "resolution").agg(F.count("*").alias("n"))


def golden_edges(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Each edge with the names of both ends; null target where there is none."""
    src = functions.select(F.col("id").alias("caller_id"), F.col("name").alias("caller_name"))
    dst = functions.select(
        F.col("id").alias("callee_id"), F.col("receiver_type").alias("want_receiver"), F.col("package").alias("want_package"), F.col("file_path").alias("want_file")
    )
    return calls.join(src, "caller_id").join(dst, "callee_id", "left").select(
        "caller_name", "callee_name", F.col("file_path").alias("call_file"), "want_receiver", "want_package", "want_file", F.col("resolution").alias("want_marker")
    )


def stale_edges(calls: DataFrame, functions: DataFrame, changed: DataFrame) -> DataFrame:
    """Edges into functions of changed files (path): the ones that a change may break."""
    gone = functions.join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi").select(F.col("id").alias("callee_id"))
    return calls.join(gone, "callee_id", "left_semi")


def repair_stale(stale: DataFrame, resolved: DataFrame) -> DataFrame:
    """Stored edges matched to newly resolved ones on (file, line, callee name); the first wins, no match is unresolved."""
    first = resolved.groupBy("file_path", "line", "callee_name").agg(
        F.min_by(F.struct("callee_id", "resolution"), "ord").alias("new")
    )
    return stale.drop("callee_id", "resolution").join(first, ["file_path", "line", "callee_name"], "left").select(
        *[c for c in stale.columns if c not in ("callee_id", "resolution")],
        F.col("new.callee_id").alias("callee_id"), F.coalesce("new.resolution", F.lit("unresolved")).alias("resolution"),
    )
