"""Response size against two text-search baselines, over a question file."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.operators import evaluate


def texts(files: DataFrame) -> DataFrame:
    """path, text of the files (path, content) that aren't binary."""
    return files.where(~evaluate.is_binary(F.col("content"))).select("path", F.col("content").cast("string").alias("text"))


def run(files: DataFrame, questions: list[dict], call: Callable[[str, dict], object], repo: str = "") -> dict:
    """Tokens of the tool's answer, of whole files with a hit, and of windows around hits, for each question.

    A question whose terms match nothing, or whose answer is empty, fails the run: neither side may score what it did not answer.
    """
    plain = texts(files).cache()
    try:
        out = []
        for q in sorted(questions, key=lambda q: q["id"]):
            terms = q["baseline_terms"]
            naive = evaluate.naive_tokens(plain, terms).agg(F.sum("tokens")).first()[0] or 0
            skilled = evaluate.skilled_windows(evaluate.skip_noise(plain), terms).agg(F.sum("tokens")).first()[0] or 0
            if not naive or not skilled:
                raise ValueError(f"{q['id']}: {terms} match nothing")
            args = q.get("mc_args") or {}
            answer = call(q["mc_tool"], json.loads(args) if isinstance(args, str) else args)
            text = answer if isinstance(answer, str) else json.dumps(answer, default=str)
            own = -(-len(text) // 4)
            if not answer:
                raise ValueError(f"{q['id']}: {q['mc_tool']} gave an empty answer")
            out.append({
                "id": q["id"], "text": q["text"], "category": q["category"], "answer_tokens": own, "naive_tokens": naive, "skilled_tokens": skilled,
                "naive_ratio": naive // own, "skilled_ratio": skilled // own,
            })
    finally:
        plain.unpersist()
    n = len(out) or 1
    mean = {k: sum(q[f"{k}_tokens"] for q in out) / n for k in ("answer", "naive", "skilled")}
    ratio = {f"{k}_savings_x": mean[k] / mean["answer"] if mean["answer"] else 0.0 for k in ("naive", "skilled")}
    return {"repo": repo, "questions": out, "summary": {"question_count": len(out)} | {f"avg_{k}": v for k, v in mean.items()} | ratio}


def markdown(result: dict) -> str:
    s = result["summary"]
    lines = [f"# Benchmark: {result['repo']}", "", f"{s['question_count']} questions; {s['naive_savings_x']:.1f}x fewer tokens than whole files, {s['skilled_savings_x']:.1f}x than windows.", ""]
    lines += ["| id | category | answer | whole files | windows |", "| --- | --- | --- | --- | --- |"]
    lines += [f"| {q['id']} | {q['category']} | {q['answer_tokens']} | {q['naive_tokens']} | {q['skilled_tokens']} |" for q in result["questions"]]
    return "\n".join(lines) + "\n"


def write(result: dict, folder: str) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    (Path(folder) / "results.json").write_text(json.dumps(result, indent=2))
    (Path(folder) / "benchmark.md").write_text(markdown(result))
