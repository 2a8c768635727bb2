"""Corpus pipeline: quality rules, near-duplicate join, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns documents in the
columns of ``docs`` (the last one: every document's shard).  Each is written as Parquet and read again before the next.

Defined results, for every stage (each operator's own are in its module): a null text is an empty one, which the quality rules
reject; a null id or source is a value of its own; documents are told apart by id, source and text, so ties in ids and repeated
rows do no harm; texts are taken whole, however long they are; an empty table gives no rows; further columns pass through,
whatever their names (but ``n_chars``, which follows the text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm import decontamination, mixing, ngram_join, quality_rules, sharding
from codequarry.llm.common import KEY, join_checked, materialize, read_table, row_key
from codequarry.session import clean_up, scratch, scratch_mark


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that are too frequent on their host."""
    kept = quality_rules.clean_documents(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: of the smallest id (null last) the one of smallest key; of rows that are equal in id and text one."""
    key = row_key(F.col("doc_id"), F.coalesce("text", F.lit("")))
    joined = ngram_join.ngram_join(docs)
    others = materialize(joined.where(F.col("row") != F.col("rep")).select(F.col("row").alias(KEY)).distinct(), "gone")
    kept = join_checked(docs.withColumn(KEY, key), others, KEY, "left_anti")
    again = materialize(joined.groupBy(F.col("row").alias(KEY)).agg(F.count("*").alias("_n")).where("_n > 1").select(KEY), "again")
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = join_checked(kept, again, KEY, "left_semi").dropDuplicates([KEY])
    return join_checked(kept, again, KEY, "left_anti").unionByName(once).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as it takes them."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, bytes, shard and folder of every document of the mix; the documents are written there."""
    path = scratch(spark, "shards", keep=True)
    shards = materialize(sharding.assign_shards(sharding.slim_rows(docs)), "shards-of-rows")
    sharding.write_shards(docs, shards, path)
    folder = F.concat(F.lit(f"{path}/{sharding.FOLDER}=b"), "shard")
    return shards.select("doc_id", "bytes", "shard", "depth", "shard_bytes", "shard_rows", folder.alias("folder"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: The join, the alignment and the cube method have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    base = scratch(spark, "pipeline", keep=True)
    for name, stage in STAGES:
        mark = scratch_mark()
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        clean_up(spark, mark)  # the stage's own tables; its result is written
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
