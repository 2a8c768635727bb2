"""Keeping an index current from a stream of change events.

One query reads events (path, op, ts), drops what the engine does not index, waits until a path has been quiet for the gap,
and hands each micro-batch to the store: a full rebuild if the control row is in it or very many files changed, else the last
change of each file.  The control file is deleted once its rebuild is done.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from codequarry.operators.store import Store
from codequarry.sources.files import ScanOptions
from codequarry.streaming.changes import CONTROL_FILE, FULL, debounce, latest_changes, relevant

EVENTS = "path string, op string, ts timestamp"


def change_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Events from JSON lines files that a watcher drops into a folder; ``max_files`` a batch is the back-pressure."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files).json(path)


def debounced(events: DataFrame, gap: str = "500 milliseconds", delay: str = "1 second") -> DataFrame:
    """One row per path and burst of event time, with its last op, once the watermark has passed the burst."""
    marked = relevant(events).withWatermark("ts", delay)
    burst = marked.groupBy("path", F.session_window("ts", gap).alias("_w"))
    out = burst.agg(F.max_by("op", "ts").alias("op"), F.min("ts").alias("first_event"), F.max("ts").alias("last_event"), F.count("*").alias("events"))
    return out.drop("_w")


def quiet(events: DataFrame, gap_ms: int = 500) -> DataFrame:
    """(path, op, ts) of the last event of each path once no other has come for the gap, by the clock of the query.

    Event time would hold the last burst back until something else changes.  State is one op for each path that is changing
    just now.
    """

    def wait(key, frames, state):  # noqa: ANN001, ANN202
        if state.hasTimedOut:
            op, ts = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "op": [op], "ts": [ts]})
            return
        op, ts = state.get if state.exists else (None, None)
        for f in frames:
            last = f.sort_values(["ts", "op"]).iloc[-1]
            if ts is None or (last["ts"], last["op"]) >= (ts, op):
                op, ts = last["op"], last["ts"].to_pydatetime()
        state.update((op, ts))
        state.setTimeoutDuration(gap_ms)

    return relevant(events).groupBy("path").applyInPandasWithState(wait, EVENTS, "op string, ts timestamp", "append", GroupStateTimeout.ProcessingTimeTimeout)


def debounce_to_table(events: DataFrame, keys: list[str], gap: str, path: str) -> DataFrame:
    """Run a debouncing stream over what its source holds now, and return all bursts, the open ones too.

    Each trigger writes the state as a table of its own (complete mode), so a trigger that is replayed writes the same one.
    """
    written: list[str] = []

    def keep(batch: DataFrame, batch_id: int) -> None:
        at = f"{path}/bursts-{batch_id}"
        batch.write.mode("overwrite").parquet(at)
        written.append(at)

    query = debounce(events, keys, gap).writeStream.outputMode("complete").foreachBatch(keep)
    query.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return events.sparkSession.read.parquet(written[-1])


def listing_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, op) between two listings (path, modified): a file source alone does not see deletions."""
    old = before.select("path", F.col("modified").alias("was"))
    joined = after.select("path", "modified").join(old, "path", "full")
    op = F.when(F.col("modified").isNull(), "delete").when(F.col("was").isNull() | (F.col("was") != F.col("modified")), "upsert")
    return joined.select("path", op.alias("op")).where("op IS NOT NULL")


#: Changed files in one batch from which on a full build is cheaper than replacing rows.
MAX_INCREMENTAL = 2000


def _consume(spark: SparkSession, root: str) -> None:
    """Delete the control file, so that it asks for one rebuild only."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root if '://' in root else 'file://' + root}/{CONTROL_FILE}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)


def apply_batch(store: Store, root: str, options: ScanOptions | None = None, max_incremental: int = MAX_INCREMENTAL) -> Callable[[DataFrame, int], None]:
    """foreachBatch function.  A batch that was applied before (same id, replayed after a failure) gives the same tables again."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        events = relevant(batch).persist()
        try:
            if events.isEmpty():
                return
            if not events.where(F.col("op") == FULL).isEmpty():
                store.index(root, options)
                _consume(store.spark, root)
                return
            last = latest_changes(events, ["path"], ["ts", "op"]).select("path", "op")
            if last.limit(max_incremental + 1).count() > max_incremental:
                store.index(root, options)
                return
            store.apply(last, root, options)
        finally:
            events.unpersist()

    return apply


def maintain(
    store: Store, events: DataFrame, root: str, checkpoint: str, options: ScanOptions | None = None, once: bool = False,
    max_incremental: int = MAX_INCREMENTAL, gap_ms: int = 500,
) -> StreamingQuery:
    """Keep the store current.  With ``once`` what is there now is applied, without waiting for quiet."""
    calm = events if once else quiet(events, gap_ms)
    writer = calm.writeStream.foreachBatch(apply_batch(store, root, options, max_incremental)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{max(100, gap_ms // 2)} milliseconds")).start()
