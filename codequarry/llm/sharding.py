"""Sharding by extendible hashing (native: DataFrame functions only).

Rows hash to 60 bits.  The directory starts at the depth at which shards would fit on average; it is kept over fine
cells (a few bits deeper), so that it grows with the number of shards and never with the rows.  Only a bucket above
the byte limit splits on its next bit.  Cells that are still too large at the directory's finest depth are split again
over their own rows, a few bits at a time, until every shard fits.

Defined results: a row above the limit has a shard of its own; null text has 0 bytes; a null id is hashed as its text;
rows that are equal in id and text can't be told apart by any bit, so they fill numbered overflow pages of their bucket,
each within the limit; which of them come first is left open.  Only the sizes of texts count, however long they are.  An empty
table gives no shards; further columns are left alone, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codequarry.llm.common import NUMBER, join_checked, materialize, numbered, read_table

HASH_BITS = 60
FINE_BITS = 6
SHARD_BYTES = 4 << 20


def hash_bits(doc_id: Column, text: Column) -> Column:
    """60 bits of MD5 over id and text, so that SQL engines agree on them."""
    inner = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), inner).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(h: Column, depth: Column | int) -> Column:
    shift = F.lit(HASH_BITS) - (depth if isinstance(depth, Column) else F.lit(depth))
    return F.call_function("shiftright", h, shift.cast("int"))


def _split(slim: DataFrame, base: int, limit: int) -> DataFrame:
    """cell, depth of its bucket, bytes of the bucket and its distinct hashes, over cells FINE_BITS below ``base``."""
    fine = min(HASH_BITS, base + FINE_BITS)
    cells = slim.groupBy(_prefix(F.col("h"), fine).alias("cell")).agg(
        F.sum("bytes").alias("cell_bytes"), F.count("*").alias("cell_rows"), F.min("h").alias("lo"), F.max("h").alias("hi")
    )
    # every window's keys start with the base prefix: one shuffle of the cells serves all depths
    cells = cells.withColumn("root", F.call_function("shiftright", "cell", F.lit(fine - base)))
    depth, size, rows = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long")
    for d in range(fine, base - 1, -1):
        at = W.partitionBy("root", F.call_function("shiftright", "cell", F.lit(fine - d)))
        cells = cells.withColumn(f"b{d}", F.sum("cell_bytes").over(at)).withColumn(f"r{d}", F.sum("cell_rows").over(at))
        fits = (F.col(f"b{d}") <= limit) | (F.col(f"r{d}") == 1)
        depth = F.when(fits, F.lit(d)).otherwise(depth)
        size = F.when(fits, F.col(f"b{d}")).otherwise(size)
        rows = F.when(fits, F.col(f"r{d}")).otherwise(rows)
    return cells.select("cell", "lo", "hi", depth.alias("depth"), size.alias("shard_bytes"), rows.alias("shard_rows"))


def assign_shards(slim: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """Adds shard (bits of the bucket, with ``+page`` for overflow), depth, shard_bytes and shard_rows to rows (h, bytes, ...).

    ``slim`` should hold no texts: it is read once for each round, and rounds after the first touch only rows of
    cells that are too large.
    """
    slim = materialize(slim, "shard-rows")
    total = slim.agg(F.sum("bytes")).first()[0] or 0
    base = min(HASH_BITS - FINE_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))))
    done: list[DataFrame] = []
    todo = slim
    while True:
        fine = min(HASH_BITS, base + FINE_BITS)
        directory = materialize(_split(todo, base, limit), "shard-directory")
        placed = todo.withColumn("cell", _prefix(F.col("h"), fine)).join(directory, "cell")
        bits = _bits(_prefix(F.col("h"), F.col("depth")))
        name = F.when(F.col("depth") == 0, "").otherwise(F.expr(f"right({'_bits'}, depth)"))
        done.append(
            placed.where("depth IS NOT NULL").withColumn("_bits", bits).withColumn("shard", name).drop("cell", "lo", "hi", "_bits")
        )
        over = directory.where("depth IS NULL").agg(F.count("*"), F.count_if(F.col("lo") < F.col("hi"))).first()
        if not over[0]:
            break
        rest = placed.where("depth IS NULL")
        same = F.col("lo") == F.col("hi")
        done.append(_overflow(rest.where(same), limit))
        if not over[1]:
            break
        todo = materialize(rest.where(~same).select(*slim.columns), "shard-rest")
        base = fine
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Pages for rows of one hash: they are copies of one record, so any numbering of them is a valid one."""
    largest = rows.groupBy("h").agg(F.greatest(F.max("bytes"), F.lit(1)).alias("_largest"))
    paged = numbered(rows, ["h"], "shard-copies").join(largest, "h")
    fit = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("_largest"))).cast("long")
    paged = paged.withColumn("page", F.floor(F.col(NUMBER) / fit).cast("long")).drop("_largest", NUMBER)
    each = W.partitionBy("h", "page")  # at most ``limit`` bytes
    return (
        paged.withColumn("shard", F.concat(_bits(F.col("h")), F.lit("+"), F.col("page").cast("string")))
        .withColumn("depth", F.lit(HASH_BITS))
        .withColumn("shard_bytes", F.sum("bytes").over(each))
        .withColumn("shard_rows", F.count("*").over(each))
        .drop("cell", "lo", "hi", "page")
    )


def _bits(h: Column) -> Column:
    return F.lpad(F.conv(h.cast("string"), 10, 2), HASH_BITS, "0")


#: Name of the folders of written shards, after which no column of documents is named.
FOLDER = "__quarry_shard"


def write_shards(docs: DataFrame, shards: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """Write documents by shard, one folder each (of the shards that ``assign_shards`` gave with the same limit).

    The buckets' bits make a table as large as the number of shards; a row meets its bucket by the bits that all of them
    have, and then by the whole prefix.  Texts move once, to their shard.
    """
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("doc"), hash_bits(F.col("doc_id"), F.col("text")).alias("h"), _size().alias("bytes"))
    bucket, paged = F.substring_index("shard", "+", 1), F.contains("shard", F.lit("+"))
    buckets = materialize(shards.select(bucket.alias("bucket"), paged.alias("paged")).distinct(), "shard-buckets")
    common = buckets.agg(F.min(F.length("bucket"))).first()[0] or 0
    met = join_checked(
        rows.withColumn("b", _bits(F.col("h"))).withColumn("root", F.substring("b", 1, common)),
        buckets.withColumn("root", F.substring("bucket", 1, common)), "root", "inner",
    ).where(F.startswith("b", "bucket"))
    plain = met.where(~F.col("paged")).select("doc", F.col("bucket").alias("shard"))
    if not buckets.where("paged").isEmpty():
        plain = plain.unionByName(_overflow(met.where("paged").select("doc", "h", "bytes"), limit).select("doc", "shard"))
    out = plain.withColumn(FOLDER, F.concat(F.lit("b"), "shard"))
    out.repartition(FOLDER).select("doc.*", FOLDER).write.partitionBy(FOLDER).parquet(path)


def _size() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")


def slim_rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        hash_bits(F.col("doc_id"), F.col("text")).alias("h"),
        _size().alias("bytes"),
    )


def shard_documents(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    return assign_shards(slim_rows(docs), limit).select("doc_id", "bytes", "shard", "depth", "shard_bytes", "shard_rows")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))


OP9_SQL = f"""
WITH RECURSIVE slim AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, {HASH_BITS // 4}))::BIGINT AS h
  FROM documents
), base AS (
  SELECT greatest(0, ceil(log2(greatest(1.0, sum(bytes)::DOUBLE / {SHARD_BYTES}))))::INT AS d FROM slim
), levels(d) AS (SELECT d FROM base UNION ALL SELECT d + 1 FROM levels WHERE d < {HASH_BITS}),
sized AS (
  SELECT l.d, h >> ({HASH_BITS} - l.d) AS p, sum(bytes) AS b, count(*) AS r FROM slim, levels l GROUP BY 1, 2
), least AS (
  SELECT s.h, min(z.d) AS depth FROM (SELECT DISTINCT h FROM slim) s JOIN sized z ON z.p = s.h >> ({HASH_BITS} - z.d)
  WHERE z.b <= {SHARD_BYTES} OR z.r = 1 GROUP BY ALL
), copies AS (
  SELECT doc_id, bytes, h, (row_number() OVER (PARTITION BY h) - 1) // greatest(1, {SHARD_BYTES} // greatest(bytes, 1)) AS page
  FROM slim WHERE h IN (SELECT p FROM sized WHERE d = {HASH_BITS} AND b > {SHARD_BYTES} AND r > 1)
), paged AS (
  SELECT doc_id, bytes, lpad(bin(h), {HASH_BITS}, '0') || '+' || page AS shard, {HASH_BITS}::INT AS depth,
    sum(bytes) OVER (PARTITION BY h, page)::BIGINT AS shard_bytes, count(*) OVER (PARTITION BY h, page) AS shard_rows FROM copies
), plain AS (
SELECT s.doc_id, s.bytes, CASE WHEN l.depth = 0 THEN '' ELSE right(lpad(bin(z.p), {HASH_BITS}, '0'), l.depth) END AS shard,
  l.depth::INT AS depth, z.b::BIGINT AS shard_bytes, z.r AS shard_rows
FROM slim s JOIN least l ON l.h = s.h JOIN sized z ON z.d = l.depth AND z.p = l.h >> ({HASH_BITS} - l.depth)
)
SELECT * FROM plain UNION ALL SELECT * FROM paged
"""
