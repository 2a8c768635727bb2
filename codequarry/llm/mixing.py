"""Mixing sources to target weights by the cube method.

Targets: the mix has ``share`` times all words; each source's part follows its weight, stops at ``most`` times the
source's own words, and what is cut off goes to the others by weight until none is above.

A source with target/size ratio r takes every document floor(r) times; the fractional part is an inclusion probability.
The *flight* moves these probabilities along vectors of the null space of two balancing constraints (documents and
words of the source), so that both totals stay exactly as they were, until at most two fractions are left.  It runs in
blocks: documents are dealt to (source, block) by hash, each block flies alone, and what it leaves (two documents)
flies again with the rest of its group of blocks, level by level, so no task ever holds more than ``BLOCK_ROWS`` or
``2 * FAN_IN`` units in expectation.  Repeated rows fly as units of 1, 2, 4, ... copies, each of which weighs as many
documents and words as it has copies; so they keep both totals too, and a hot row is a few units.  The *landing* takes of
the last two units of a source as many copies as bring its words nearest to the target.

Defined results: null text has no words; null source is a source and comes last; a document without words is carried
along (taken 0); repeated rows are documents of their own, any of which may be the ones that are taken once more; the size
counts whole texts, however long they are; draws depend on the rows alone, so reruns agree, and of landings that are
equally near the one nearest in documents, then the one of fewer copies of the smaller key, is taken; an empty table gives
no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import KEY, NUMBER, join_checked, materialize, numbered, read_table, row_key

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BLOCK_ROWS = 20_000
FAN_IN = 2_000
#: A mix is over a curated list of sources; their totals (not their rows) come to the driver.
MAX_SOURCES = 100_000
_EPS = 1e-9


def source_targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Target words of each source; sources in code point order, null last, take the weights in turn."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target: dict[str | None, float] = {}
    left, open_ = share * sum(sizes.values()), list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        part = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if part[s] > most * sizes[s]]
        if not over:
            target.update(part)
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ = [s for s in open_ if s not in target]
    return target


def flight(p: np.ndarray, copies: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Fast flight phase: keeps sum(p * copies) and sum(p * copies * size), leaves at most two entries strictly between 0 and 1."""
    p, copies, words = p.astype(float).copy(), copies.astype(float), copies * size.astype(float)
    todo = [i for i in range(len(p)) if _EPS < p[i] < 1 - _EPS]
    draws = rng.random(len(todo) + 1)
    live: list[int] = []
    at = 0
    for i in todo:
        live.append(i)
        if len(live) < 3:
            continue
        a, b, c = live
        # null space of [copies, words]: their cross product; of equal sizes a plain exchange
        u = (
            copies[b] * words[c] - copies[c] * words[b],
            copies[c] * words[a] - copies[a] * words[c],
            copies[a] * words[b] - copies[b] * words[a],
        )
        if not any(u):
            u = (1.0 / copies[a], -1.0 / copies[b], 0.0)
        up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(live, u, strict=True) if x)
        down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(live, u, strict=True) if x)
        step = up if draws[at] * (up + down) < down else -down
        at += 1
        for k, x in zip(live, u, strict=True):
            p[k] = min(1.0, max(0.0, p[k] + step * x))
        live = [k for k in live if _EPS < p[k] < 1 - _EPS]
    p[p < _EPS] = 0.0
    p[p > 1 - _EPS] = 1.0
    return p


def landing(p: np.ndarray, copies: np.ndarray, size: np.ndarray, goal: float) -> np.ndarray:
    """Copies to take of the one or two units left, so that their words come nearest to ``goal``, then their number."""
    near = [sorted({0, math.floor(x * n), math.ceil(x * n), int(n)}) for x, n in zip(p.tolist(), copies.tolist(), strict=True)]
    tries = list(itertools.product(*near))
    for i in range(len(p)):  # one unit makes up for what the rounding of the other leaves
        for t in itertools.product(*near):
            rest = (goal - sum(m * s for j, (m, s) in enumerate(zip(t, size.tolist(), strict=True)) if j != i)) / size[i]
            tries += [(*t[:i], min(int(copies[i]), max(0, m)), *t[i + 1 :]) for m in (math.floor(rest), math.ceil(rest))]
    number = float(p @ copies)
    return np.array(min(tries, key=lambda t: (abs(float(np.dot(t, size)) - goal), abs(sum(t) - number), t)), dtype=np.int64)


#: ``extra``: copies taken once more, null while the unit still flies.
_FLY = "id long, hash long, source string, size long, copies long, p double, extra long, block long"
_FLY_ARROW = pa.schema([(c.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]]) for c in _FLY.split(", ")])


def _fly(rows: DataFrame, last: bool) -> DataFrame:
    """Flight over each (source, block); with ``last`` also the landing."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("hash", "id", "copies")])
        size, copies, p = (table[c].to_numpy() for c in ("size", "copies", "p"))
        goal = float(p @ (size * copies.astype(float)))
        seed = [int(table["block"][0].as_py()) & 0xFFFFFFFF, int(np.bitwise_xor.reduce(table["hash"].to_numpy())) & 0xFFFFFFFFFFFFFFFF]
        out = flight(p, copies, size, np.random.default_rng(seed))
        open_ = (out > 0) & (out < 1)
        extra = np.where(open_, 0, out * copies).round().astype(np.int64)
        if last and open_.any():
            rest = np.flatnonzero(open_)
            extra[rest] = landing(out[rest], copies[rest], size[rest], goal - float(extra @ size.astype(float)))
            open_[:] = False
        columns = {"p": pa.array(out), "extra": pa.array(extra, mask=open_)}
        return pa.table({c: columns[c] if c in columns else table[c] for c in _FLY_ARROW.names}, schema=_FLY_ARROW)

    return rows.groupBy("source", "block").applyInArrow(run, _FLY)


def _drawn(known: DataFrame, blocks: int) -> DataFrame:
    """key, n, extra: rows of each key that flew, and how many of them are taken once more."""
    fly = known.where((F.col("p") > _EPS) & (F.col("size") > 0)).groupBy("key", "source", "size", "p").agg(F.count("*").alias("n"))
    powers = F.filter(F.transform(F.sequence(F.lit(0), F.lit(62)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)), lambda x: F.col("n").bitwiseAND(x) > 0)
    fly = fly.withColumn("copies", F.explode(F.when(F.col("n") == 1, F.array(F.col("n"))).otherwise(powers)))
    block = F.pmod(F.xxhash64("key", "copies", F.lit(5)), F.lit(blocks))
    fly = fly.select(F.col("key.id").alias("id"), F.col("key.hash").alias("hash"), "source", "size", "copies", "p", block.alias("block"))
    done: list[DataFrame] = []
    while True:
        fly = materialize(_fly(fly, last=blocks == 1), "mix-flight")
        done.append(fly.where("extra IS NOT NULL").select(F.struct("id", "hash").alias("key"), "copies", "extra"))
        if blocks == 1:
            break
        blocks = -(-blocks // FAN_IN)
        fly = fly.where("extra IS NULL").drop("extra").withColumn("block", F.pmod("block", F.lit(blocks)))
    drawn = done[0]
    for d in done[1:]:
        drawn = drawn.unionByName(d)
    return drawn.groupBy("key").agg(F.sum("copies").alias("n"), F.sum("extra").alias("extra"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """key, doc_id, size, source, source_size, target, copies, taken for every document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        row_key(F.col("doc_id"), F.col("source"), text).alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
    )
    rows = materialize(rows, "mix-sizes")
    spark = rows.sparkSession
    totals = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: name the sources of the mix")
    sizes = {r["source"]: r["size"] for r in totals}
    target = source_targets(sizes, weights, share, most)
    table = spark.createDataFrame(
        [(s, sizes[s], float(target[s]), target[s] / sizes[s] if sizes[s] else 0.0) for s in sizes],
        "s string, source_size long, target double, ratio double",
    )
    known = rows.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    known = known.withColumn("floor", F.floor("ratio")).withColumn("p", F.col("ratio") - F.col("floor"))

    most_rows = max([r["n"] for r in totals], default=0)
    drawn = _drawn(known, max(1, -(-most_rows // BLOCK_ROWS)))
    split = F.col("extra").between(1, F.col("n") - 1)
    some = materialize(drawn.where(split).select("key", "extra"), "mix-some")
    whole = known.join(drawn.where(~split), "key", "left").withColumn("more", F.coalesce((F.col("extra") > 0).cast("long"), F.lit(0).cast("long"))).drop("n", "extra")
    if not some.isEmpty():
        # of these repeated rows only some are taken once more
        each = numbered(join_checked(known, some, "key", "inner"), ["key"], "mix-repeats")
        each = each.withColumn("more", (F.col(NUMBER) < F.col("extra")).cast("long")).drop(NUMBER, "extra")
        whole = join_checked(whole, some.select("key"), "key", "left_anti").unionByName(each)
    out = whole.withColumn("copies", F.col("floor") + F.col("more"))
    return out.select("key", "doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix with repeats, in the columns of ``docs``."""
    names = ("__quarry_least", "__quarry_most", "__quarry_n")
    least, most, n = (F.col(c) for c in names)
    taken = mix(docs).groupBy(F.col("key").alias(KEY)).agg(F.min("copies").alias(names[0]), F.max("copies").alias(names[1]), F.sum("copies").alias("_sum"), F.count("*").alias("_rows"))
    taken = materialize(taken.where(most > 0).select(KEY, least, most, (F.col("_sum") - least * F.col("_rows")).alias(names[2])), "mix-taken")
    keyed = docs.withColumn(KEY, row_key(F.col("doc_id"), F.col("source"), F.coalesce("text", F.lit(""))))
    # the table of the mix grows with the documents: it is never broadcast, also where it happens to be small
    out = keyed.join(taken.where(least == most).hint("merge"), KEY).withColumn("__quarry_copies", most)
    some = taken.where(least < most)
    if not some.isEmpty():
        each = numbered(join_checked(keyed, some, KEY, "inner"), [KEY], "mix-repeats")
        out = out.unionByName(each.withColumn("__quarry_copies", F.when(F.col(NUMBER) < n, most).otherwise(least)).drop(NUMBER))
    out = out.where("__quarry_copies > 0").withColumn("__quarry_copy", F.explode(F.sequence(F.lit(1), F.col("__quarry_copies").cast("int"))))
    return out.select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source", "source_size", "target", "taken", "copies")
