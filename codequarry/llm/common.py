"""Shared plumbing of the pipeline operators: reading, cutting lineage, hashing words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codequarry.session import cut

#: Rows up to which a side may be broadcast; each such row is a few dozen bytes, so this bounds it to some 20 MB.
BROADCAST_ROWS = 250_000


#: Bytes in one Arrow batch to a Python worker, where the session doesn't say otherwise.
BATCH_BYTES = 4 << 20


def limit_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of bounded bytes, however long they are, so a worker's memory stays small."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    limit_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Name of the helper column beside a table's own ones.
KEY = "__quarry_key"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back (``session.cut``), with bounded batches to Python."""
    limit_batches(df.sparkSession)
    return cut(df, name)


def join_checked(left: DataFrame, right: DataFrame, on, how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join against a *materialized* right side: broadcast if its counted rows are within the bound, else shuffled."""
    return left.join(F.broadcast(right) if right.count() <= rows else right, on, how)


#: Type of ``row_key`` in Spark and in Arrow.
KEY_TYPE = "struct<id:long,hash:long>"
KEY_ARROW = pa.struct([pa.field("id", pa.int64(), False), pa.field("hash", pa.int64(), False)])


def _content_hash(seed: int, columns: tuple[Column, ...]) -> Column:
    return F.xxhash64(F.lit(seed), *(p for c in columns for p in (c.isNull().cast("int"), c)))


def row_key(doc_id: Column, *columns: Column) -> Column:
    """Identity of a row: its id and a 64-bit hash of all its columns; of a null id another hash in its place.

    Rows that are equal in all columns share it, null and '' differ.  Two rows of different ids never share it, and
    strangers without an id would have to meet in 128 bits.
    """
    own = doc_id.cast("long")
    return F.struct(F.coalesce(own, _content_hash(2, columns)).alias("id"), _content_hash(1, (own, *columns)).alias("hash"))


#: Name of the column that ``numbered`` adds.
NUMBER = "__quarry_number"


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds ``NUMBER``: 0, 1, ... within each key, in no particular order.

    Rows are numbered within the part that they stand in, and the parts of a key one after the other, so that no task
    sorts all rows of a hot key.  The parts are written first, so numbers can't change between two uses.
    """
    tagged = materialize(rows.withColumn("__part", F.spark_partition_id()), name)
    at = W.partitionBy(*keys, "__part")
    sizes = tagged.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    ahead = F.sum("__n").over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))  # one row for each part
    start = sizes.select(*keys, "__part", F.coalesce(ahead, F.lit(0)).alias("__start"))
    own = tagged.withColumn("__own", F.row_number().over(at.orderBy("__part")) - 1)
    return own.join(start, [*keys, "__part"]).withColumn(NUMBER, (F.col("__own") + F.col("__start")).cast("long")).drop("__own", "__start", "__part")


# ---------------------------------------------------------------------------------------------- word hashing

BLOCK = 1 << 20
_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; grown by doubling and kept."""
    table = _powers.get(base)
    if table is None or len(table) <= n:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        steps = np.full(size, base & _M64, dtype=np.uint64)
        steps[0] = 1
        table = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return table


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all bits (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _blocks(raw: bytes):
    """Pieces of about BLOCK bytes that end where a word ends, with their offsets."""
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + BLOCK)
        while end < n and not _SPACE[raw[end]]:
            end += 1
        yield at, raw[at:end]
        at = end


def word_hashes(raw: bytes, spans: bool = False):
    """Hashes of the words (runs of bytes other than ASCII white space) of a UTF-8 text, in order.

    With ``spans`` also the byte start and end of each word.  Memory follows the number of words, not the block
    tables, however long the text is.
    """
    hashes, starts, ends = [], [], []
    for at, block in _blocks(raw):
        a = np.frombuffer(block, dtype=np.uint8)
        inside = np.zeros(len(a) + 2, dtype=np.int8)
        inside[1:-1] = ~_SPACE[a]
        edge = np.diff(inside)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(s):
            continue
        total = np.empty(len(a) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(power_table(_BASE, len(a))[: len(a)] * (a.astype(np.uint64) + np.uint64(1)), out=total[1:])
        hashes.append(mix64((total[e] - total[s]) * power_table(_BASE_INVERSE, len(a))[s] + (e - s).astype(np.uint64)))
        if spans:
            starts.append(s + at)
            ends.append(e + at)
    h = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
    if not spans:
        return h
    none = np.empty(0, dtype=np.int64)
    return h, np.concatenate(starts) if starts else none, np.concatenate(ends) if ends else none


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words; of fewer than k words (but at least one) a single hash of all of them."""
    n = len(h)
    if n == 0:
        return h
    k = min(k, n)
    out = np.full(n - k + 1, k, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : n - k + 1 + j]
    return mix64(out)


#: Byte table: ASCII upper case to lower case; ASCII other than digits and letters to a blank; the rest as it is.
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def folded_words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return raw.translate(WORD_TABLE).split()
