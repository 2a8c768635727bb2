"""Evaluation inputs: question files, protocols, run logs and scenarios, by explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTIONS = "id string, text string, category string, mc_tool string, baseline_terms array<string>, mc_args string"
PROTOCOL = (
    "version string, repos array<struct<name:string,clone_url:string,sha:string,lang:string>>, "
    "tasks array<struct<id:string,repo:string,type:string,intent:string,paraphrases:array<string>,planted_grep_win:boolean,"
    "rubric:array<struct<id:string,criterion:string,max_points:int>>>>, "
    "keys array<struct<task_id:string,expected_files:array<string>,expected_symbols:array<string>,oracle:string,human_verified:boolean>>"
)
RUNS = (
    "manifest string, runs array<struct<task_id:string,repo:string,arm:string,replicate:int,phrasing:string,status:string,final_answer:string,"
    "input_tokens:long,output_tokens:long,tool_calls:int,turns_to_answer:int,wall_clock_ms:long,retries:int,"
    "retrieval:struct<precision:double,recall:double,f1:double,lead_correct:boolean>,rubric:struct<points:double,max_points:double>>>"
)
SCENARIOS = (
    "id string, task_category string, difficulty string, title string, description string, context_files array<string>, context_length long, "
    "task_prompt string, ground_truth string, evaluation_criteria array<string>, metadata map<string,string>"
)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def questions(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, QUESTIONS)


def protocol_tasks(spark: SparkSession, path: str) -> DataFrame:
    """task columns with the expected files and symbols of its key; tasks without a key keep nulls."""
    p = _json(spark, path, PROTOCOL)
    tasks = p.select(F.explode("tasks").alias("t")).select("t.*")
    keys = p.select(F.explode("keys").alias("k")).select("k.*")
    return tasks.join(keys, tasks["id"] == keys["task_id"], "left").drop("task_id")


def protocol_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 of the protocol in a canonical form (known fields in schema order)."""
    p = _json(spark, path, PROTOCOL)
    return p.select(F.sha2(F.to_json(F.struct(*p.columns)), 256)).first()[0]


def runs(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, RUNS).select(F.explode("runs").alias("r")).select("r.*")


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Fields that hold text, lists or objects come as text: a list joined by line ends, an object as JSON."""
    raw = _json(spark, path, SCENARIOS)
    flat = raw
    for c in ("task_prompt", "ground_truth", "description"):
        as_list = F.from_json(c, "array<string>")
        flat = flat.withColumn(c, F.when(F.col(c).startswith("["), F.coalesce(F.array_join(as_list, "\n"), F.col(c))).otherwise(F.col(c)))
    return flat
