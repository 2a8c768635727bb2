"""Substring dedup by sliding sentence spans.

Each text is cut into sentences.  A sentence above ``PIECE`` words counts as several, cut after the word of
least hash in every ``PIECE`` consecutive words, so that no piece is longer and equal stretches are cut alike but for some
words at either end.  So any stretch of 50 words holds a run, wherever in its sentences it begins and ends; stretches under
``RUN_WORDS`` words never do and stay.  From every sentence starts one run: the shortest one of at least ``RUN_SENTENCES``
sentences and ``RUN_WORDS`` words; one more ends with the text.  Runs are hashed over their words (white space and ASCII letter
case don't matter) and joined over the whole corpus: the document of smallest id (of different texts of one id the one of smallest
hash) keeps a run, at its first place there; in all others, and at later places, the sentences that the run covers go.

Counting: run hashes are summed before they move (count and smallest id), and the repeated ones are joined back on the
hash, where Spark can split a run that a third of all rows hold.  Texts move once, to meet their own marks.

Defined results: null text is empty and stays null; a null id is replaced by a hash of the text; repeated rows of one id and
text are one document and keep or lose the same sentences; different texts of one id are different documents; texts are cut and
hashed whole, however long they are; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import join_checked, materialize, mix64, power_table, read_table, row_key, word_hashes

RUN_SENTENCES = 2
#: Half of the 50 words that are always found, so that a shared phrase or licence line is left alone.
RUN_WORDS = 25
#: 3 PIECE + RUN_WORDS is at most 52: of 50 shared words the first PIECE hold a cut that both texts have, all cuts but for the last
#: PIECE - 1 words' are the same, and the first cut after the run's words comes within PIECE words.
PIECE = 9

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_STOP = re.compile(rb"(?:[.!?]+[\"')\]]*|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)[\x20\x09-\x0d]+|\n[\x20\x09-\x0d]*")
_ORDER_BASE = 0xD1342543DE82EF95
_ORDER_INVERSE = pow(_ORDER_BASE, -1, 1 << 64)

RUNS = "key long, ord long, hash long, first int, last int, again boolean"
_ARROW = pa.schema([("key", pa.int64()), ("ord", pa.int64()), ("hash", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("again", pa.bool_())])


def least_words(h: np.ndarray) -> np.ndarray:
    """For each window of PIECE words the place of the least hash (of equal ones the last)."""
    n = len(h) - PIECE + 1
    low, at = h[:n], np.zeros(n, dtype=np.int64)
    for j in range(1, PIECE):
        less = h[j : j + n] <= low
        low = np.where(less, h[j : j + n], low)
        at[less] = j
    return np.arange(n) + at


def sentences(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start of every sentence, index of its first word, and the hashes of all words."""
    h, starts, _ = word_hashes(raw.translate(_FOLD), spans=True)
    cuts = np.array([0] + [m.end() for m in _STOP.finditer(raw)], dtype=np.int64)
    first = np.unique(np.searchsorted(starts, cuts))
    first = first[first < len(h)]
    sizes = np.diff(np.append(first, len(h)))
    if len(sizes) and sizes.max() > PIECE:
        of = np.repeat(np.arange(len(sizes)), sizes)
        within = (of[: 1 - PIECE] == of[PIECE - 1 :]) & (sizes > PIECE)[of[: 1 - PIECE]]
        first = np.unique(np.concatenate([first, least_words(h)[within] + 1]))
        first = first[first < len(h)]
    return starts[first] if len(first) else first, first, h


def runs(first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last sentence of every run."""
    m, n = len(first), len(h)
    i = np.arange(m)
    end_words = np.append(first, n)
    # smallest end (exclusive, in sentences) with enough words and sentences
    end = np.maximum(np.searchsorted(end_words, first + RUN_WORDS), i + RUN_SENTENCES)
    ok = end <= m
    i, end = i[ok], end[ok]
    # the text's last sentences too: the shortest run that ends with it
    tail = min(m - RUN_SENTENCES, int(np.searchsorted(first, n - RUN_WORDS, side="right")) - 1)
    if tail >= 0 and not (len(i) and i[-1] == tail and end[-1] == m):
        i, end = np.append(i, tail), np.append(end, m)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(h * power_table(_ORDER_BASE, n)[:n], out=total[1:])
    s, e = end_words[i], end_words[end]
    value = (total[e] - total[s]) * power_table(_ORDER_INVERSE, n)[s]
    return mix64(value + (e - s).astype(np.uint64)).astype(np.int64), i, end - 1


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the two halves of the document's key."""
    key = row_key(F.col("doc_id"), F.coalesce("text", F.lit("")))
    return docs.select("doc_id", "text", key.alias("k")).select("doc_id", "text", F.col("k.id").alias("ord"), F.col("k.hash").alias("key"))


def sentence_runs(docs: DataFrame) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts: list[list[np.ndarray]] = [[] for _ in _ARROW]
            for key, ord_, raw in zip(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2), strict=True):
                _, first, h = sentences(raw.as_py())
                value, lo, hi = runs(first, h)
                again = np.ones(len(value), dtype=bool)
                again[np.unique(value, return_index=True)[1]] = False
                for p, x in zip(parts, (np.full(len(value), key), np.full(len(value), ord_), value, lo, hi, again), strict=True):
                    p.append(x)
            if parts[0]:
                arrays = [pa.array(np.concatenate(p), t) for p, t in zip(parts, _ARROW.types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=_ARROW)

    return _keyed(docs).select("key", "ord", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(emit, RUNS)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """ord, key and, for each document that loses sentences, the list of spans (first and last sentence)."""
    rows = materialize(sentence_runs(docs), "sentence-runs")
    common = materialize(rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("ord").alias("owner")).where("n > 1").drop("n"), "repeated-runs")
    held = rows.join(common, "hash")
    later = F.col("again") | (F.col("ord") != F.col("owner"))
    # ids that several texts share: there the run stays in the text of smallest hash
    texts = _keyed(docs).groupBy("ord").agg(F.min("key").alias("a"), F.max("key").alias("b"))
    shared = materialize(texts.where("a != b").select("ord"), "shared-ids")
    if not shared.isEmpty():
        own = join_checked(held.where("ord = owner"), shared, "ord", "left_semi")
        least = materialize(own.groupBy("hash").agg(F.min("key").alias("least")), "shared-owners")
        held = held.join(least, "hash", "left")
        later = later | F.coalesce(F.col("key") != F.col("least"), F.lit(False))
    return held.where(later).groupBy("ord", "key").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


OUT = "doc_id long, n_sentences long, n_removed long, n_words long, n_words_left long, text string"
_OUT_ARROW = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in ("n_sentences", "n_removed", "n_words", "n_words_left")] + [("text", pa.string())])


def remove_spans(raw: bytes, spans: list[dict[str, int]]) -> tuple[int, int, int, int, bytes]:
    """Sentences, sentences removed, words, words left, and the text without the sentences in ``spans``."""
    starts, first, h = sentences(raw)
    m = len(first)
    if not spans:
        return m, 0, len(h), len(h), raw
    gone = np.zeros(m, dtype=bool)
    for s in spans:
        gone[s["first"] : s["last"] + 1] = True
    sizes = np.diff(np.append(first, len(h)))
    ends = np.append(starts[1:], len(raw))
    # what stands before the first sentence is white space and stays with it
    begin = starts.copy()
    begin[0] = 0
    kept = b"".join(raw[a:b] for a, b, g in zip(begin.tolist(), ends.tolist(), gone.tolist(), strict=True) if not g)
    return m, int(gone.sum()), len(h), int(sizes[~gone].sum()), kept


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """One row per document with its text without the repeated sentences."""
    marks = materialize(repeated_spans(docs), "sentence-marks")
    rows = _keyed(docs).join(marks, ["ord", "key"], "left")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in _OUT_ARROW.names}
            for doc_id, raw, spans in zip(*(b.column(i) for i in range(3)), strict=True):
                raw = raw.as_py()
                m, gone, n, left, text = remove_spans(raw or b"", spans.as_py() or [])
                for c, v in zip(_OUT_ARROW.names, (doc_id.as_py(), m, gone, n, left, None if raw is None else text.decode()), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_OUT_ARROW)

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), "spans").mapInArrow(strip, OUT)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read_table(spark, sf_dir, "documents"))
