"""Evaluation: text-search baselines, set scores and paired statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codequarry.functions.text import approx_tokens, paths_match
from codequarry.session import cut

# ------------------------------------------------------------------------------------------ text-search baselines

NOISE_DIRS = ["node_modules", "vendor", "dist", "build", "target", "testdata", "__pycache__"]


def is_binary(content: Column) -> Column:
    """A NUL byte within the first 8000 bytes."""
    return F.position(F.unhex(F.lit("00")), F.substring(content, 1, 8000)) > 0


def grep(files: DataFrame, terms: list[str], regex: bool = False, path: str = "path", text: str = "text") -> DataFrame:
    """(term, path, line, text): every line that holds a term; one scan for all terms (a few literals of one query)."""
    lines = files.select(path, F.posexplode(F.split(text, "\n")).alias("i", "line_text"))
    hit = (lambda t: F.rlike(F.col("line_text"), t)) if regex else (lambda t: F.contains(F.col("line_text"), t))
    held = lines.withColumn("term", F.explode(F.filter(F.array(*map(F.lit, terms)), hit)))
    return held.select("term", path, (F.col("i") + 1).alias("line"), F.col("line_text").alias("text"))


def skip_noise(files: DataFrame, path: str = "path") -> DataFrame:
    parts = F.split(path, "/")
    return files.where(~F.arrays_overlap(parts, F.array(*map(F.lit, NOISE_DIRS))) & ~F.exists(parts, lambda p: p.startswith(".")))


def hit_text(hits: DataFrame, path: str = "path") -> Column:
    return F.concat_ws(":", hits[path].cast("string"), hits["line"].cast("string"), hits["text"])


def naive_tokens(files: DataFrame, terms: list[str], path: str = "path", text: str = "text") -> DataFrame:
    """term, tokens: all hit lines, and every file with a hit in full, once per term."""
    hits = grep(files, terms, path=path, text=text)
    lines = hits.withColumn("tokens", approx_tokens(hit_text(hits, path))).groupBy("term", path).agg(F.sum("tokens").alias("lines"))
    full = files.select(path, approx_tokens(F.col(text)).alias("whole"))
    return lines.join(full, path).groupBy("term").agg(F.sum(F.col("lines") + F.col("whole")).alias("tokens"))


def skilled_windows(files: DataFrame, terms: list[str], radius: int = 20, path: str = "path", text: str = "text") -> DataFrame:
    """One window of lines around the first hit in each stretch of 2*radius lines; path, bucket, line, window, tokens."""
    hits = grep(files, terms, path=path, text=text)
    first = hits.groupBy(path, F.floor(F.col("line") / (2 * radius)).alias("bucket")).agg(F.min("line").alias("line"))
    lines = files.select(path, F.split(text, "\n").alias("all"))
    lo = F.greatest(F.col("line") - radius, F.lit(1))
    window = F.array_join(F.slice("all", lo, F.col("line") + radius - lo + 1), "\n")
    return first.join(lines, path).select(path, "bucket", "line", window.alias("window")).withColumn("tokens", approx_tokens(F.col("window")))


def enclosing_function(lines: DataFrame, hits: DataFrame) -> DataFrame:
    """The nearest ``def`` line above each hit that is indented less than it: (path, line) -> name.

    One walk down each file over its ``def`` lines and hits; a ``def`` that a later one of the same or less indentation
    follows can enclose nothing more and leaves the stack.
    """
    indent = F.length(F.regexp_extract("text", r"^(\s*)", 1)).alias("indent")
    is_def = F.col("text").rlike(r"^\s*(async\s+)?def\s+\w+")
    defs = lines.where(is_def).select("path", "line", indent, F.regexp_extract("text", r"def\s+(\w+)", 1).alias("name"))
    both = hits.select("path", "line", indent, F.lit(None).cast("string").alias("name")).distinct().unionByName(defs)

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        stack: list[tuple[int, str]] = []
        out = []
        # hits of a line come before its own definition
        rows = rows.assign(is_def=rows["name"].notna()).sort_values(["line", "is_def"])
        for line, depth, name, defines in zip(rows["line"], rows["indent"], rows["name"], rows["is_def"], strict=True):
            if defines:
                while stack and stack[-1][0] >= depth:
                    stack.pop()
                stack.append((depth, name))
            else:
                found = next((n for d, n in reversed(stack) if d < depth), None)
                if found is not None:
                    out.append((rows["path"].iloc[0], line, found))
        return pd.DataFrame(out, columns=["path", "line", "name"])

    kind = dict(hits.dtypes)["line"]
    return both.groupBy("path").applyInPandas(walk, f"path string, line {kind}, name string")


# ------------------------------------------------------------------------------------------------------ scoring


def prf1(found: Column, expected: Column) -> Column:
    """Precision, recall and F1 of two arrays taken as sets."""
    f, e = F.array_distinct(found), F.array_distinct(expected)
    both = F.size(F.array_intersect(f, e)).cast("double")
    p = F.when(F.size(f) > 0, both / F.size(f)).otherwise(0.0)
    r = F.when(F.size(e) > 0, both / F.size(e)).otherwise(0.0)
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def quality(lead_correct: Column, f1: Column, rubric: Column, rubric_max: Column) -> Column:
    return F.when(lead_correct, 1.0).when(f1.isNotNull(), f1).when(rubric_max > 0, rubric / rubric_max).otherwise(0.0)


def wilcoxon(pairs: DataFrame, delta: str = "delta") -> DataFrame:
    """One row: n, w_plus, z, p of the signed-rank test; zeros dropped, ties take their average rank.

    Ranks come from counts by magnitude, so no window runs over all rows.
    """
    by = pairs.where((F.col(delta) != 0) & F.col(delta).isNotNull()).groupBy(F.abs(delta).alias("a")).agg(
        F.count("*").alias("c"), F.count_if(F.col(delta) > 0).alias("up")
    )
    ranked = _running(by, "a", "c")
    rank = F.col("before") + (F.col("c") + 1) / 2
    out = ranked.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("up") * rank), F.lit(0.0)).alias("w_plus"))
    n = F.col("n").cast("double")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return out.withColumn("z", F.when(sd > 0, (F.col("w_plus") - n * (n + 1) / 4) / sd).otherwise(0.0)).withColumn("p", _two_sided(F.col("z")))


def _running(df: DataFrame, order: str, value: str, parts: int = 64) -> DataFrame:
    """Adds ``before``: the sum of value over smaller orders; range parts first, so that each window runs over one part.

    Range bounds are sampled, so the parted rows are written once: parts and their sums must come from the same bounds.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    parted = cut(df.repartitionByRange(min(parts, max(1, n)), order).withColumn("_part", F.spark_partition_id()), "running")
    sums = parted.groupBy("_part").agg(F.sum(value).alias("s"))
    ahead = sums.withColumn("ahead", F.coalesce(F.sum("s").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a few rows
    inside = F.coalesce(F.sum(value).over(W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return parted.withColumn("inside", inside).join(F.broadcast(ahead.select("_part", "ahead")), "_part").withColumn("before", F.col("inside") + F.col("ahead"))


def _two_sided(z: Column) -> Column:
    """2 * (1 - Phi(|z|)) by a rational approximation of erfc (error below 1.2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    # fixed values: coefficients of the public approximation, highest power first
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: b01, b10, chi2 (with continuity correction), p."""
    out = pairs.agg(F.count_if(~F.col(a) & F.col(b)).alias("b01"), F.count_if(F.col(a) & ~F.col(b)).alias("b10"))
    n, d = F.col("b01") + F.col("b10"), F.greatest(F.abs(F.col("b01") - F.col("b10")) - 1, F.lit(0))
    out = out.withColumn("chi2", F.when(n > 0, d * d / n).otherwise(0.0))
    return out.withColumn("p", _two_sided(F.sqrt("chi2")))  # one degree of freedom


def cliffs_delta(pairs: DataFrame, delta: str = "delta") -> DataFrame:
    return pairs.agg(F.avg(F.signum(delta)).alias("cliffs_delta"))


def median_delta(pairs: DataFrame, delta: str = "delta") -> DataFrame:
    """The exact median (of an even number the middle two's mean), by running counts of values: no task holds them all."""
    by = pairs.where(F.col(delta).isNotNull()).groupBy(F.col(delta).cast("double").alias("v")).agg(F.count("*").alias("c"))
    ranked = _running(by, "v", "c")
    total = by.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))  # one row
    lo, hi = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    holds = lambda k: F.col("before").cast("long").between(k - F.col("c") + 1, k)  # noqa: E731  the k-th value (from 0) is this one
    middle = ranked.crossJoin(F.broadcast(total)).where(holds(lo) | holds(hi))
    return middle.agg(((F.min("v") + F.max("v")) / 2).alias("median_delta"))


def sign_test(pairs: DataFrame, delta: str = "delta") -> DataFrame:
    return pairs.agg(F.count_if(F.col(delta) > 0).alias("wins"), F.count_if(F.col(delta) < 0).alias("losses"), F.count_if(F.col(delta) == 0).alias("ties"))


_PCG = 6364136223846793005  # fixed value: the generator's multiplier


def _pcg_jump(state: int, inc: int, steps: int) -> int:
    """The generator's state ``steps`` further on."""
    power = pow(_PCG, steps, (_PCG - 1) << 64)
    return (state * power + inc * ((power - 1) // (_PCG - 1))) % (1 << 64)


def pcg_draws(seed: int, skip: int, n: int) -> np.ndarray:
    """Outputs ``skip`` to ``skip + n`` of the published 32-bit permuted congruential generator."""
    inc = (seed << 1 | 1) % (1 << 64)
    start = _pcg_jump((_pcg_jump(0, inc, 1) + seed) % (1 << 64), inc, 1 + skip)
    powers = np.full(n, _PCG, dtype=np.uint64)
    powers[:1] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    sums = np.cumsum(powers, dtype=np.uint64) - powers
    s = np.uint64(start) * powers + np.uint64(inc) * sums
    x = (((s >> np.uint64(18)) ^ s) >> np.uint64(27)).astype(np.uint32)
    rot = (s >> np.uint64(59)).astype(np.uint32)
    return (x >> rot) | (x << ((np.uint32(32) - rot) & np.uint32(31)))


def bootstrap_ci(deltas: list[float], iterations: int = 10_000, level: float = 0.95, seed: int = 1, spark=None) -> DataFrame:  # noqa: ANN001
    """Percentile bootstrap interval of the median of a bounded list of paired deltas; one row, zeros for an empty list.

    All iterations draw from one stream of numbers; a task jumps to where its iterations begin.  The bounds are the sorted
    medians at positions iterations * (1 - level) / 2 and iterations * (1 + level) / 2, cut to whole numbers.
    """
    n = len(deltas)
    if not n:
        return spark.createDataFrame([(0.0, 0.0)], "low double, high double")

    def run(batches):  # noqa: ANN001, ANN202
        x = np.asarray(deltas, dtype=float)
        for b in batches:
            yield pd.DataFrame({"m": [float(np.median(x[pcg_draws(seed, int(i) * n, n) % np.uint32(n)])) for i in b["id"]]})

    alpha = 1 - level
    lo, hi = int(alpha / 2 * iterations), min(int((1 - alpha / 2) * iterations), iterations - 1)
    medians = spark.range(iterations).mapInPandas(run, "m double").agg(F.sort_array(F.collect_list("m")).alias("m"))  # one number for each iteration
    return medians.select(F.element_at("m", lo + 1).alias("low"), F.element_at("m", hi + 1).alias("high"))


# ------------------------------------------------------------------------------------------------------ grading


def retrieval_score(answers: DataFrame) -> DataFrame:
    """Adds lead_file, lead_correct, matched, precision, recall, f1 to answers (paths: files in the order they are named; expected: files).

    Paths match if one is a suffix of the other at a folder boundary.  Precision counts named files that match some expected
    one, recall expected files that some named one matches; without expected files all are 0.
    """
    named, gold = F.coalesce("paths", F.array().cast("array<string>")), F.coalesce("expected", F.array().cast("array<string>"))
    some = F.size(gold) > 0
    hits = F.filter(named, lambda p: F.exists(gold, lambda g: paths_match(p, g)))
    matched = F.filter(gold, lambda g: F.exists(named, lambda p: paths_match(p, g)))
    out = answers.withColumn("lead_file", F.when(some & (F.size(named) > 0), F.element_at(named, 1)))
    out = out.withColumn("lead_correct", F.coalesce(F.exists(gold, lambda g: paths_match(F.col("lead_file"), g)), F.lit(False))).withColumn("matched", matched)
    out = out.withColumn("precision", F.when(some & (F.size(named) > 0), F.size(hits) / F.size(named)).otherwise(0.0))
    out = out.withColumn("recall", F.when(some, F.size("matched") / F.size(gold)).otherwise(0.0))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def symbol_recall(answers: DataFrame) -> DataFrame:
    """Adds matched, missed, recall to answers (answer, expected: symbols): which symbols the text names, letter case aside."""
    words = F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)), F.lower))
    named = F.coalesce(words, F.array().cast("array<string>"))
    gold = F.coalesce("expected", F.array().cast("array<string>"))
    out = answers.withColumn("matched", F.filter(gold, lambda g: F.array_contains(named, F.lower(g))))
    out = out.withColumn("missed", F.filter(gold, lambda g: ~F.array_contains(named, F.lower(g))))
    return out.withColumn("recall", F.when(F.size(gold) > 0, F.size("matched") / F.size(gold)).otherwise(0.0))


def arm_scores(results: DataFrame) -> DataFrame:
    """Adds found, missed (sorted), recall, precision to results (task_id, arm, predicted, expected): names match exactly, blank ones don't count."""
    clean = F.array_sort(F.array_distinct(F.filter(F.transform("predicted", lambda x: F.trim(x)), lambda x: x != "")))
    out = results.withColumn("predicted", F.coalesce(clean, F.array().cast("array<string>")))
    out = out.withColumn("found", F.array_sort(F.filter("expected", lambda g: F.array_contains("predicted", g))))
    out = out.withColumn("missed", F.array_sort(F.filter("expected", lambda g: ~F.array_contains("predicted", g))))
    hits = F.size(F.array_intersect("predicted", "expected"))
    out = out.withColumn("recall", F.when(F.size("expected") > 0, F.size("found") / F.size("expected")).otherwise(0.0))
    return out.withColumn("precision", F.when(F.size("predicted") > 0, hits / F.size("predicted")).otherwise(0.0))


def arm_totals(runs: DataFrame, arm: str, done: Column, value: str) -> DataFrame:
    """arm, runs, completed and the mean of a value."""
    return runs.groupBy(F.col(arm).alias("arm")).agg(F.count("*").alias("runs"), F.count_if(done).alias("completed"), F.avg(value).alias("mean"))


def paired(runs: DataFrame, key: str, arm: str, value: str, arms: tuple[str, str]) -> DataFrame:
    """key, both arms' values and their delta for keys that both arms completed; one aggregate instead of a self-join."""
    a, b = (F.max(F.when(F.col(arm) == x, F.col(value))).alias(n) for x, n in zip(arms, ("a", "b"), strict=True))
    return runs.groupBy(key).agg(a, b).where("a IS NOT NULL AND b IS NOT NULL").withColumn("delta", F.col("b") - F.col("a"))


def coverage(scenarios: DataFrame, extensions: dict[str, str]) -> DataFrame:
    """category, files, known (by extension), fully (scenarios with only known files)."""
    ok = F.forall("context_files", lambda p: F.lower(F.regexp_extract(p, r"\.([^./]+)$", 1)).isin(list(extensions)))
    known = F.size(F.filter("context_files", lambda p: F.lower(F.regexp_extract(p, r"\.([^./]+)$", 1)).isin(list(extensions))))
    return scenarios.groupBy("task_category").agg(
        F.count("*").alias("scenarios"), F.sum(F.size("context_files")).alias("files"), F.sum(known).alias("known"), F.count_if(ok).alias("fully")
    )


def key_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Tasks whose expected symbols differ between two tables (task_id, symbols), or that only one has."""
    a = expected.select("task_id", F.array_sort(F.array_distinct("symbols")).alias("a"))
    b = actual.select("task_id", F.array_sort(F.array_distinct("symbols")).alias("b"))
    return a.join(b, "task_id", "full").where(~F.col("a").eqNullSafe(F.col("b")))


def match_paths(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, want): paths that are equal or where one ends with the other at a folder boundary; joined on the file's name."""
    f = found.select("path", F.substring_index("path", "/", -1).alias("_n")).distinct()
    e = expected.select("want", F.substring_index("want", "/", -1).alias("_n")).distinct()
    return f.join(e, "_n").where(paths_match(F.col("path"), F.col("want"))).select("path", "want")


def import_aliases(lines: DataFrame) -> DataFrame:
    """(path, name, alias): names that a line of text (path, text) imports under another one."""
    rx = r"\bimport\s+(?:[\w.]+\s*,\s*)*([\w.]+)\s+as\s+(\w+)"
    found = lines.select("path", F.regexp_extract("text", rx, 1).alias("name"), F.regexp_extract("text", rx, 2).alias("alias"))
    return found.where("alias != '' AND alias != name")


def alias_hits(lines: DataFrame) -> DataFrame:
    """(path, line, name): lines that call an import by its alias, found through the import of the same file."""
    called = lines.select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w+)\s*\("), F.lit(1)))).alias("alias"))
    return called.join(import_aliases(lines).distinct(), ["path", "alias"]).select("path", "line", "name")
