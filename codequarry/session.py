"""Session defaults; nothing here overrides what a cluster has set."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a temporary one on a local master, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_written: list[str] = []


def scratch(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh folder name in the shared folder; ``clean_up`` deletes it but where it is to be kept."""
    path = f"{shared_dir(spark)}/quarry-{name}-{uuid.uuid4().hex}"
    if not keep:
        _written.append(path)
    return path


def scratch_mark() -> int:
    """What ``clean_up`` may be told to start from."""
    return len(_written)


def clean_up(spark: SparkSession, since: int = 0) -> None:
    """Delete the scratch folders of this process (made after a mark); results that still read them must have been written by then."""
    while len(_written) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back.

    Cuts the lineage: a lost executor costs a re-read of a file, not a recomputation, and the rows can't differ
    between two uses.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a table of the tree may be broadcast.
BROADCAST_ROWS = 250_000


def bounded(*tables: DataFrame) -> list[DataFrame]:
    """The tables, counted in one job; joins of one above the bound are sort-merge joins, others are left to Spark's statistics.

    Those go by the size of files, and the columns of a large tree are a few bytes a row there: Spark would send millions of
    rows through the driver.  What is projected, filtered or aggregated from a marked table stays marked up to its next join.
    """
    each = reduce(DataFrame.unionByName, (t.select(F.lit(i).alias("i")) for i, t in enumerate(tables)))
    large = {r["i"] for r in each.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") > BROADCAST_ROWS).collect()}
    return [t.hint("merge") if i in large else t for i, t in enumerate(tables)]
