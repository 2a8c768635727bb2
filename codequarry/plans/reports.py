"""Evaluation runs and their Markdown reports: probes of what each kind of search surfaces, and paired comparisons of arms."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.operators import evaluate

ONE_SHOT, CHAINED, INDEX = "text search", "text search, aliases followed", "index"
SCORES = "task_id string, arm string, predicted array<string>, expected array<string>, calls int, bytes long"


def _search(plain: DataFrame, patterns: list[str]) -> tuple[list[str], int, DataFrame]:
    """Functions around the lines that match, the bytes of those lines, and the lines."""
    hits = evaluate.grep(plain, patterns, regex=True)
    lines = plain.select("path", F.posexplode(F.split("text", "\n")).alias("i", "text")).select("path", (F.col("i") + 1).alias("line"), "text")
    size = hits.agg(F.coalesce(F.sum(F.octet_length(evaluate.hit_text(hits)) + 1), F.lit(0))).first()[0]
    names = evaluate.enclosing_function(lines, hits.select("path", "line", "text")).select("name").distinct()
    return [r[0] for r in names.collect()], size, hits


def run_probes(plain: DataFrame, probes: list[dict], call: Callable[[str, str], str]) -> DataFrame:
    """Scores (see ``evaluate.arm_scores``) of three arms on probes (task_id, symbol, expected): one text search, text searches that
    follow renamed imports, and the index's answer (``call``: tool and symbol to JSON).  ``plain``: path, text."""
    rows, spark = [], plain.sparkSession
    for p in probes:
        symbol, expected = p["symbol"], p["expected"]
        patterns = p.get("patterns") or [re.escape(symbol)]
        names, size, hits = _search(plain, patterns)
        rows.append((p["task_id"], ONE_SHOT, names, expected, len(patterns), size))
        aliases = [r[0] for r in evaluate.import_aliases(hits).where(F.col("name") == symbol).select("alias").distinct().orderBy("alias").collect()]
        more, extra = [], 0
        if aliases:
            more, extra, _ = _search(plain, [re.escape(a) + r"\s*\(" for a in aliases])
        rows.append((p["task_id"], CHAINED, names + more, expected, len(patterns) + len(aliases), size + extra))
        answer = call("get_call_chain", symbol)
        rows.append((p["task_id"], INDEX, re.findall(r'"name"\s*:\s*"((?:[^"\\]|\\.)*)"', answer), expected, 1, len(answer.encode())))
    return evaluate.arm_scores(spark.createDataFrame(rows, SCORES))


def probe_report(scores: DataFrame) -> str:
    """One table for each task; scores are a few rows for each probe."""
    out, last = ["# What each arm can surface", ""], None
    for r in scores.orderBy("task_id", "arm").collect():
        if r["task_id"] != last:
            last = r["task_id"]
            out += ["", f"## {last}", "", f"Expected: {', '.join(sorted(r['expected']))}", "", "| arm | recall | precision | calls | bytes | missed |", "| --- | --- | --- | --- | --- | --- |"]
        missed = ", ".join(r["missed"]) or "none"
        out.append(f"| {r['arm']} | {len(r['found'])}/{len(r['expected'])} | {r['precision']:.2f} | {r['calls']} | {r['bytes']} | {missed} |")
    return "\n".join(out) + "\n"


def arms_report(runs: DataFrame, arms: tuple[str, str]) -> str:
    """Paired comparison of runs (task_id, arm, status, quality, tokens, millis); tasks that an arm did not complete don't count.

    Replicates are averaged for each task and arm, so what comes to the driver is one row for each task.
    """
    spark = runs.sparkSession
    done = runs.where("status = 'completed'")
    lines = [f"# {arms[1]} against {arms[0]}", "", "| measure | tasks | median delta | 95 % interval | wins | losses | p (Wilcoxon) | Cliff's delta |", "| --- | --- | --- | --- | --- | --- | --- | --- |"]
    for measure in ("quality", "tokens", "millis"):
        mean = done.groupBy("task_id", "arm").agg(F.avg(measure).alias("v"))
        pairs = evaluate.paired(mean, "task_id", "arm", "v", arms)
        deltas = [r["delta"] for r in pairs.orderBy("task_id").select("delta").collect()]  # one row for each task
        if not deltas:
            lines.append(f"| {measure} | 0 | | | | | | |")
            continue
        low, high = evaluate.bootstrap_ci(deltas, spark=spark).first()
        wins, losses, _ = evaluate.sign_test(pairs).first()
        median, p, cliff = evaluate.median_delta(pairs).first()[0], evaluate.wilcoxon(pairs).first()["p"], evaluate.cliffs_delta(pairs).first()[0]
        lines.append(f"| {measure} | {len(deltas)} | {median:+.2f} | {low:+.2f} to {high:+.2f} | {wins} | {losses} | {p:.3f} | {cliff:+.2f} |")
    lines += ["", "| arm | status | runs |", "| --- | --- | --- |"]
    lines += [f"| {r['arm']} | {r['status']} | {r['n']} |" for r in runs.groupBy("arm", "status").agg(F.count("*").alias("n")).orderBy("arm", "status").collect()]
    return "\n".join(lines) + "\n"


def write(text: str, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text)
