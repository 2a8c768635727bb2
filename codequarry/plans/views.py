"""The engine's table roles over the driver's tables: ``part`` plays the symbols, consecutive line items of an order the calls.

Each view has a DataFrame and an SQL form; the latter are CTE bodies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MARKERS = {"AF": "same-file", "AO": "same-package", "NF": "receiver-typed", "NO": "interface-dispatch", "RF": "name-global", "RO": "import-symbol"}
KINDS = {"ECONOMY": "func", "SMALL": "method", "MEDIUM": "func", "PROMO": "type/class", "STANDARD": "method", "LARGE": "type/interface"}
LANGUAGES = ["go", "python", "typescript", "rust"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _map(values: dict[str, str]):
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id (from 1), name, file_path, start_line, end_line, kind, language, package."""
    p = table(spark, sf_dir, "part")
    return p.select(
        (F.col("p_partkey") + 1).alias("id"), F.col("p_name").alias("name"), F.concat_ws("/", "p_brand", "p_type").alias("file_path"),
        F.col("p_size").alias("start_line"), (F.col("p_size") + 10).alias("end_line"), F.element_at(_map(KINDS), F.col("p_type")).alias("kind"),
        F.element_at(F.array(*map(F.lit, LANGUAGES)), (F.col("p_size") % 4 + 1).cast("int")).alias("language"), F.col("p_brand").alias("package"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """caller_id, callee_id (null where the callee is external), callee_name, file_path, line, resolution."""
    li = table(spark, sf_dir, "lineitem")
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    raw = li.select(
        "l_orderkey", "l_linenumber", "l_discount", "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("flag"), F.lead("l_partkey").over(w).alias("nxt")
    ).where("nxt IS NOT NULL AND nxt != l_partkey")
    outside = F.col("l_discount") >= 0.1
    return raw.select(
        (F.col("l_partkey") + 1).alias("caller_id"), F.when(~outside, F.col("nxt") + 1).alias("callee_id"),
        F.concat(F.lit("part_"), F.col("nxt").cast("string")).alias("callee_name"), F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("file_path"),
        F.col("l_linenumber").cast("int").alias("line"), F.when(outside, "unresolved").otherwise(F.element_at(_map(MARKERS), F.col("flag"))).alias("resolution"),
    )


def _case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


SYM = f"""sym AS (
  SELECT p_partkey + 1 AS id, p_name AS name, p_brand || '/' || p_type AS file_path, p_size AS start_line, p_size + 10 AS end_line,
    {_case("p_type", KINDS)} AS kind, (['go', 'python', 'typescript', 'rust'])[p_size % 4 + 1] AS language, p_brand AS package FROM part)"""
EDGE = f"""raw AS (
  SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nxt FROM lineitem),
edge AS (
  SELECT l_partkey + 1 AS caller_id, CASE WHEN l_discount < 0.1 THEN nxt + 1 END AS callee_id, 'part_' || nxt AS callee_name,
    'order/' || l_orderkey AS file_path, l_linenumber::INT AS line,
    CASE WHEN l_discount >= 0.1 THEN 'unresolved' ELSE {_case("l_returnflag || l_linestatus", MARKERS)} END AS resolution
  FROM raw WHERE nxt IS NOT NULL AND nxt != l_partkey)"""
