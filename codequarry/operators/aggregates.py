"""Keyed aggregates and picks that the resolver and the reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codequarry.functions.text import top_level_dir


def sole_value(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value of each key that has exactly one distinct one; the bounds of the values tell, so no set is built."""
    lo, hi = F.min(value), F.max(value)
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.when(lo == hi, lo).alias(value)).where(F.col(value).isNotNull())


def first_nonempty(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return df.where((F.col(value) != "") & F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, order).alias(value))


def unique_match(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with exactly one definition, and its id and file."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("file_path").alias("file_path"))
    return n.where("n = 1").drop("n")


def first_definition(df: DataFrame) -> DataFrame:
    return df.groupBy("name").agg(F.min("id").alias("id"))


def unique_best(df: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """The row of least order for each key, if no other ties with it."""
    w = W.partitionBy(*keys)
    ranked = df.withColumn("_r", F.rank().over(w.orderBy(order)))
    best = ranked.where("_r = 1").withColumn("_n", F.count("*").over(w))
    return best.where("_n = 1").drop("_r", "_n")


def keep_last(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The last row of each key (upsert by key)."""
    w = W.partitionBy(*keys).orderBy(*[F.col(o).desc() if isinstance(o, str) else o.desc() for o in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def language_counts(functions: DataFrame) -> DataFrame:
    return functions.groupBy("language").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("files"))


def directory_map(functions: DataFrame) -> DataFrame:
    """Functions and files below each top-level folder."""
    return functions.groupBy(top_level_dir(F.col("file_path")).alias("dir")).agg(F.count("*").alias("functions"), F.count_distinct("file_path").alias("files"))


def symbols_in_file(functions: DataFrame, path: str) -> DataFrame:
    return functions.where(F.col("file_path") == path).orderBy("start_line", "name", "id")


def file_summaries(functions: DataFrame, types: DataFrame, imports: DataFrame) -> DataFrame:
    """file_path, language, and how many functions, types and imports a file has; one aggregate over all three."""
    none = F.lit(None).cast("string")
    marked = [functions.select("file_path", "language", F.lit("f").alias("t")), types.select("file_path", none.alias("language"), F.lit("t").alias("t")), imports.select("file_path", none.alias("language"), F.lit("i").alias("t"))]
    counts = (F.count_if(F.col("t") == k).alias(f"{n}_count") for k, n in (("f", "function"), ("t", "type"), ("i", "import")))
    return marked[0].unionByName(marked[1]).unionByName(marked[2]).groupBy("file_path").agg(F.min("language").alias("language"), *counts)


def innermost(points: DataFrame, spans: DataFrame, file: str = "file_path") -> DataFrame:
    """The narrowest span around each point (point_id, file, line) among spans (id, file, start_line, end_line); ties go to the smallest id.

    Joined on the file and a block of lines; a span is written once for each block it touches, so a file with many of both
    never pairs all points with all spans.
    """
    block = 64
    cells = spans.select(F.col("id"), F.col(file), "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / block), F.floor(F.col("end_line") / block))).alias("_b"))
    at = points.select("point_id", F.col(file), "line", F.floor(F.col("line") / block).alias("_b"))
    inside = at.join(cells, [file, "_b"]).where("start_line <= line AND end_line >= line")
    pick = F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), F.col("id")))
    return inside.groupBy("point_id").agg(pick.alias("m")).select("point_id", F.col("m.id").alias("span_id"), F.col("m.span").alias("span"))
