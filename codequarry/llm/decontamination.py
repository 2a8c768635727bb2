"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The test items are dealt to blocks of bounded items and bytes; the items of one block, and their word trigrams, go to every
task, and the blocks run one after the other over all documents.  For each block a first pass counts in how many documents
each of its trigrams stands (one vector per task).  Each item's rarest trigrams over the corpus become its seeds, ranked
within the item, so that an item that leaked into a third of all rows keeps its seeds.  A second pass finds the seeds in
each document, groups them by item and diagonal, and aligns the item with the passage around each group.  The score is the
alignment's share of a perfect one, so edited and paraphrased copies score below 1.

An item of fewer than ``ITEM_WORDS`` words is no passage that could be told from common prose.  It is matched by the exact
whole-text rule: only a document that holds these words and no other ones matches it, with score 1.

Defined results: null or empty text and items without words match nothing; repeated rows of documents give equal rows, those
of items count once; items of equal text and different ids both match; of passages that score alike the first one is given;
texts are searched whole, in time that grows with their words and seeds; an empty table on either side gives no rows; further
columns are ignored, whatever their names.  A document gets one row for each item that it holds, with the best passage.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import KEY, KEY_ARROW, KEY_TYPE, folded_words, join_checked, materialize, mix64, read_table, row_key

N = 3
#: Items and bytes of their texts in one block; each task holds one block at a time, and there is no limit on blocks.
BLOCK_ITEMS = 50_000
BLOCK_BYTES = 32 << 20
#: Words of the shortest item that is searched for inside documents.
ITEM_WORDS = 5
#: Share of an item's trigrams that are seeds.  An edit every five words still leaves two of five trigrams whole; with this
#: many seeds, one of them is among the seeds wherever the edits are, while the commonest trigrams start no alignment.
SEED_SHARE = 0.6
SEED_LEAST = 12
MIN_SEEDS = 2
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1

SCHEMA = f"key {KEY_TYPE}, doc_id long, item_id long, score double, first_word long, last_word long, n_seeds long"
_ARROW = pa.schema([("key", KEY_ARROW)] + [(c, pa.float64() if c == "score" else pa.int64()) for c in ("doc_id", "item_id", "score", "first_word", "last_word", "n_seeds")])


def gram_codes(w: np.ndarray) -> np.ndarray:
    """64-bit hash of the trigram of word ids at each position; -1 where a word is no item word (id 0).

    Two trigrams that met in a hash would only cost an alignment.
    """
    n = len(w) - N + 1
    if n < 1:
        return np.empty(0, dtype=np.int64)
    code, known = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    for j in range(N):
        code = mix64(code ^ w[j : j + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        known &= w[j : j + n] > 0
    return np.where(known, (code >> np.uint64(1)).astype(np.int64), -1)


class Items:
    """Word ids and trigram codes of one block of test items."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.word: dict[bytes, int] = {}
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        #: whole text -> items that are too short to be searched for
        self.short: dict[tuple[bytes, ...], list[int]] = defaultdict(list)
        for item_id, text in rows:
            words = folded_words((text or "").encode())
            if len(words) >= ITEM_WORDS:
                self.ids.append(item_id)
                self.words.append(np.array([self.word.setdefault(w, len(self.word) + 1) for w in words], dtype=np.int64))
            elif words:
                self.short[tuple(words)].append(item_id)
        codes = [gram_codes(w) for w in self.words]
        self.all = np.unique(np.concatenate(codes)) if codes else np.empty(0, dtype=np.int64)
        self.of = [np.searchsorted(self.all, c) for c in codes]

    def document(self, words: list[bytes]) -> np.ndarray:
        get = self.word.get
        return np.array([get(w, 0) for w in words], dtype=np.int64)

    def grams(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the document of item trigrams, and their indices in ``all``."""
        code = gram_codes(w)
        at = np.flatnonzero(code >= 0)
        if not len(at) or not len(self.all):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        slot = np.minimum(np.searchsorted(self.all, code[at]), len(self.all) - 1)
        hit = self.all[slot] == code[at]
        return at[hit], slot[hit]


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local score of ``a`` in ``b`` and the first and last index in ``b`` of that alignment.

    Row by row over ``a``; the gap along ``b`` is a running maximum, so each row is a few vector operations.
    """
    n = len(b)
    ramp = np.arange(n + 1) * -GAP
    score = np.zeros(n + 1, dtype=np.int64)
    start = np.arange(n + 1)
    best, lo, hi = 0, 0, -1
    for x in a:
        diagonal = score[:-1] + np.where(b == x, MATCH, MISMATCH)
        up = score[1:] + GAP
        row = np.zeros(n + 1, dtype=np.int64)
        came = np.arange(n + 1)
        row[1:] = np.maximum(np.maximum(diagonal, up), 0)
        came[1:] = np.where(row[1:] == 0, came[1:], np.where(row[1:] == diagonal, start[:-1], start[1:]))
        lifted = np.maximum.accumulate(row + ramp)
        source = np.maximum.accumulate(np.where(row + ramp == lifted, np.arange(n + 1), 0))
        better = lifted - ramp > row
        row = np.where(better, lifted - ramp, row)
        came = np.where(better, came[source], came)
        score, start = row, came
        k = int(np.argmax(row))
        if row[k] > best:
            best, lo, hi = int(row[k]), int(came[k]), k - 1
    return best, lo, hi


def gram_frequencies(docs: DataFrame, items: Items) -> np.ndarray:
    """Documents that hold each item n-gram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(items.all), dtype=np.int64)
        for b in batches:
            for raw in b.column(0):
                n[np.unique(items.grams(items.document(folded_words(raw.as_py())))[1])] += 1
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"gram": held, "n": n[held]})

    total = np.zeros(len(items.all), dtype=np.int64)
    rows = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(count, "gram long, n long")
    for r in rows.groupBy("gram").agg(F.sum("n").alias("n")).collect():  # at most the items' n-grams
        total[r["gram"]] = r["n"]
    return total


def choose_seeds(items: Items, frequency: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """n-gram index -> (item, position) of the rarest n-grams of each item."""
    seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for k, grams in enumerate(items.of):
        order = sorted(range(len(grams)), key=lambda i: (frequency[grams[i]], i))
        for i in order[: max(SEED_LEAST, round(SEED_SHARE * len(grams)))]:
            seeds[int(grams[i])].append((k, i))
    return dict(seeds)


def find_items(words: np.ndarray, items: Items, seeds: dict[int, list[tuple[int, int]]], threshold: float) -> list[tuple[int, float, int, int, int]]:
    """(item, score, first word, last word, seeds) of every item found in a document."""
    at, gram = items.grams(words)
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for pos, g in zip(at.tolist(), gram.tolist(), strict=True):
        for k, i in seeds.get(g, ()):
            hits[k].append((pos - i, i))
    found = []
    for k, places in hits.items():
        item = items.words[k]
        n = len(item)
        need = min(MIN_SEEDS, len(set(items.of[k].tolist())))
        if len({i for _, i in places}) < need:
            continue
        places.sort()
        # a text may begin inside an item: offsets go down to 1 - n
        best, lo, done = (0.0, 0, 0, 0), 0, -n
        inside: dict[int, int] = defaultdict(int)
        for off, i in places:
            inside[i] += 1
            while places[lo][0] < off - n:
                j = places[lo][1]
                inside[j] -= 1
                if not inside[j]:
                    del inside[j]
                lo += 1
            if len(inside) >= need and off > done:
                first = max(0, places[lo][0] - n // 2)
                last = min(len(words), off + n + n // 2 + 1)
                score, s, e = smith_waterman(item, words[first:last])
                done = off + n // 4
                best = max(best, (score / (MATCH * n), first + s, first + e, len(inside)), key=lambda x: (x[0], -x[1]))
        if best[0] >= threshold:
            found.append((k, *best))
    return found


def _match_block(docs: DataFrame, items: Items, threshold: float) -> DataFrame:
    seeds = choose_seeds(items, gram_frequencies(docs, items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in _ARROW.names}
            for key, doc_id, raw in zip(*(b.column(i) for i in range(3)), strict=True):
                words = folded_words(raw.as_py())
                found = [(items.ids[k], *rest) for k, *rest in find_items(items.document(words), items, seeds, threshold)]
                if len(words) < ITEM_WORDS:
                    found += [(item, 1.0, 0, len(words) - 1, 0) for item in items.short.get(tuple(words), ())]
                for values in found:
                    for c, v in zip(_ARROW.names, (key.as_py(), doc_id.as_py(), *values), strict=True):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_ARROW)

    text = F.coalesce("text", F.lit(""))
    return docs.select(
        row_key(F.col("doc_id"), text).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text")
    ).mapInArrow(run, SCHEMA)


def match_benchmark(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """key, doc_id, item_id, score, first_word, last_word, n_seeds for every item that a document holds."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES), 1)
    if blocks > 1:
        items = materialize(items, "items")
    out: DataFrame | None = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about one block's items
        found = _match_block(docs, Items(sorted(((r[0], r[1]) for r in rows), key=repr)), threshold)
        if blocks > 1:
            found = materialize(found, "item-matches")
        out = found if out is None else out.unionByName(found)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item."""
    hit = materialize(match_benchmark(docs, benchmark).select(F.col("key").alias(KEY)).distinct(), "leaks")
    keyed = docs.withColumn(KEY, row_key(F.col("doc_id"), F.coalesce("text", F.lit(""))))
    return join_checked(keyed, hit, KEY, "left_anti").select(*docs.columns)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_benchmark(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("key")
