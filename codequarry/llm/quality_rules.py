"""Quality rules with cross-document line frequency.

Per-document statistics come first (words, symbols, repeated lines, repeated 8-word windows).  Then every line is
normalised (outer white space and letter case) and hashed, and its distinct documents are counted per host.  A line
above its host's limit is boilerplate: it is removed, and a document that has too little left is rejected.

Line hashes are over the line's words, so runs of white space count as one.  The limit of a host is ``LINE_SHARE`` of its
documents, ``LINE_LEAST`` at least and ``LINE_MOST`` at most, so that on a large host a line can't stand in a share of all
documents.  Documents of equal text count once, so copies alone make no line frequent.

Counting: (host, line, text) is made distinct before it is summed by line, so that a frequent line arrives as partial
counts; the frequent lines are joined back on (host, line), where Spark can split a frequent one.  Lines are taken out where
the texts are, by a table of frequent lines that each task holds, if it has at most ``TABLE_ROWS`` rows; beyond that
each document that loses lines is joined with its own list of them.

Defined results: null text has no words and fails; a null host is a host of its own; repeated rows give equal results
and count once; a line exactly at the limit stays; texts are taken whole, however long they are or their lines; an empty table
gives no rows; further columns are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import KEY, KEY_ARROW, KEY_TYPE, join_checked, materialize, mix64, read_table, row_key, windows, word_hashes

WINDOW = 8
LEAST_WORDS = 20
REPEAT_SHARE = 0.3
LINE_SHARE = 0.1
LINE_LEAST = 20
LINE_MOST = 1000
#: Frequent lines (host and 64-bit hash) up to which every task holds them all: some 10 MB.
TABLE_ROWS = 100_000
LEFT_WORDS = 10
LEFT_SHARE = 0.2
SYMBOLS = b"#*$%&|<>"

_NOT_SYMBOL = bytes(set(range(256)) - set(SYMBOLS))
_CONTINUATION = bytes(range(0x80, 0xC0))
_BLANKS = bytes([0x20, *range(0x09, 0x0E)])
#: A-Z folded; other code points stay, so that SQL engines agree.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

_LOST = "__quarry_lost_lines"

STATS = f"key {KEY_TYPE}, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<hash:long,words:long>>"
_ARROW = pa.schema(
    [("key", KEY_ARROW), ("doc_id", pa.int64()), ("host", pa.string())]
    + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("lines", pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int64())])))]
)


def repeated_words(h: np.ndarray, k: int = WINDOW) -> int:
    """Words inside windows of k words that stand twice or more in the text."""
    if len(h) <= k:
        return 0
    _, which, counts = np.unique(windows(h, k), return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[which] > 1)
    edge = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + k, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def line_sums(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each line from its words' hashes and places; ``first``: index of each line's first word."""
    place = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return np.add.reduceat(mix64(h ^ (place.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))), first).astype(np.int64)


def hashed_lines(raw: bytes, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines with a word: number of the line, signed 64-bit hash and words; ``h``, ``starts``: of the text's words."""
    ends = np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10)
    of = np.searchsorted(ends, starts)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    return of[first], line_sums(word_hashes(raw.translate(_FOLD)), first), np.diff(np.append(first, len(h)))


def text_stats(raw: bytes) -> tuple[int, int, int, int, int, list[dict[str, int]]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and hash and words of every line with a word."""
    h, starts, _ = word_hashes(raw, spans=True)
    if not len(h):
        return 0, 0, len(raw.translate(None, _NOT_SYMBOL)), 0, 0, []
    at, sums, sizes = hashed_lines(raw, h, starts)
    lines = raw.split(b"\n")
    held = [lines[i] for i in at.tolist()]
    chars = len(raw.translate(None, _BLANKS + _CONTINUATION))
    parts = [{"hash": x, "words": n} for x, n in zip(sums.tolist(), sizes.tolist(), strict=True)]
    return len(h), chars, len(raw.translate(None, _NOT_SYMBOL)), len(held) - len(set(held)), repeated_words(h), parts


def without_lines(text: str, gone: np.ndarray) -> str:
    """The text without the lines whose hash is in ``gone``."""
    raw = text.encode()
    h, starts, _ = word_hashes(raw, spans=True)
    if not len(h) or not len(gone):
        return text
    at, sums, _ = hashed_lines(raw, h, starts)
    drop = set(at[np.isin(sums, gone)].tolist())
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in drop) if drop else text


def document_stats(docs: DataFrame, host: str = "source") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_stats(t.as_py()) for t in b.column(3)]
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
            lines = pa.array([r[5] for r in rows], _ARROW.field("lines").type)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *columns, lines], schema=_ARROW)

    text = F.coalesce("text", F.lit(""))
    return docs.select(
        row_key(F.col("doc_id"), F.col(host), text).alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col(host).cast("string").alias("host"), text.cast("binary").alias("text"),
    ).mapInArrow(run, STATS)


def frequent_lines(stats: DataFrame, share: float = LINE_SHARE, least: int = LINE_LEAST, most: int = LINE_MOST) -> DataFrame:
    """host, hash of the lines in more distinct texts of their host than its limit."""
    # texts are told apart by all their lines
    lines = stats.select("host", F.xxhash64("lines").alias("text"), "lines")
    size = lines.groupBy("host", "text").agg(F.count("*").alias("n")).groupBy("host").agg(F.count("*").alias("texts"))
    each = lines.select("host", "text", F.explode(F.array_distinct("lines.hash")).alias("hash")).groupBy("host", "text", "hash").agg(F.count("*").alias("n"))
    counts = each.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") > least)
    limit = F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), F.col("texts") * share))
    return counts.join(size.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > limit).select("host", "hash")


def judge(stats: DataFrame, frequent: DataFrame) -> DataFrame:
    """Adds base_failed, n_boilerplate_words, n_left_words and kept to *materialized* statistics."""
    frequent = frequent.select(F.col("host").alias("h"), F.col("hash").alias("x"))
    lines = stats.where(F.size("lines") > 0).select("key", "host", F.posexplode("lines").alias("i", "line"))
    lines = lines.select("key", "host", "i", "line.hash", "line.words").distinct()
    gone = (
        lines.join(frequent, F.col("hash").eqNullSafe(F.col("x")) & F.col("host").eqNullSafe(F.col("h")))
        .groupBy("key").agg(F.sum("words").alias("n_boilerplate_words"))
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * int(100 * REPEAT_SHARE))
    left = F.col("n_words") - F.col("n_boilerplate_words")
    depleted = (F.col("n_boilerplate_words") > 0) & ((left < LEFT_WORDS) | (left < LEFT_SHARE * F.col("n_words")))
    return (
        stats.join(gone, "key", "left")
        .withColumn("n_boilerplate_words", F.coalesce("n_boilerplate_words", F.lit(0)).cast("long"))
        .withColumn("base_failed", failed)
        .withColumn("n_left_words", left)
        .withColumn("kept", ~failed & ~depleted)
    )


def verdicts(docs: DataFrame, host: str = "source") -> tuple[DataFrame, DataFrame]:
    """Statistics and verdict of every document, and the frequent lines (written)."""
    stats = materialize(document_stats(docs, host), "quality")
    frequent = materialize(frequent_lines(stats), "frequent-lines")
    return judge(stats, frequent), frequent


def apply_quality_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document: its statistics and whether it is kept."""
    return verdicts(docs, host)[0]


def _keyed(docs: DataFrame, host: str) -> DataFrame:
    return docs.withColumn(KEY, row_key(F.col("doc_id"), F.col(host), F.coalesce("text", F.lit(""))))


def strip_lines(keyed: DataFrame, judged: DataFrame, frequent: DataFrame, host: str, rows: int = TABLE_ROWS) -> DataFrame:
    """Documents (with ``KEY``) without the frequent lines of their host."""
    few = frequent.count() <= rows
    if few:
        table: dict[str | None, list[int]] = {}
        for r in frequent.collect():  # counted just now
            table.setdefault(r["host"], []).append(r["hash"])
        held = keyed.sparkSession.sparkContext.broadcast({h: np.array(v, dtype=np.int64) for h, v in table.items()})
        wide = keyed.withColumn(_LOST, F.col(host).cast("string"))
    else:
        stats = judged.where("n_boilerplate_words > 0").select("key", "host", F.explode(F.array_distinct("lines.hash")).alias("hash")).distinct()
        lost = stats.join(frequent.withColumnRenamed("host", "h"), "hash").where(F.col("host").eqNullSafe(F.col("h")))
        wide = keyed.join(lost.groupBy(F.col("key").alias(KEY)).agg(F.collect_set("hash").alias(_LOST)), KEY, "left")
    names, none = keyed.columns, np.empty(0, dtype=np.int64)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, lost in zip(b.column("text"), b.column(_LOST), strict=True):
                t, gone = text.as_py(), lost.as_py()
                gone = held.value.get(gone, none) if few else np.array(gone or [], dtype=np.int64)
                texts.append(without_lines(t, gone) if t and len(gone) else t)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else b.column(n) for n in names], names=names)

    return wide.mapInArrow(strip, keyed.schema)


def clean_documents(docs: DataFrame, host: str = "source", rows: int = TABLE_ROWS) -> DataFrame:
    """The kept documents, without the lines above their host's limit."""
    judged, frequent = verdicts(docs, host)
    rejected = materialize(judged.where("NOT kept").select(F.col("key").alias(KEY)).distinct(), "rejected")
    kept = join_checked(_keyed(docs, host), rejected, KEY, "left_anti")
    return (kept if frequent.isEmpty() else strip_lines(kept, judged, frequent, host, rows)).select(*docs.columns)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdicts, and the SHA-256 of what is left of each kept document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    judged, frequent = verdicts(docs)
    judged = materialize(judged, "judged")
    # only documents that lose lines are read again
    lossy = materialize(judged.where("kept AND n_boilerplate_words > 0").select(F.col("key").alias(KEY)).distinct(), "lossy")
    left = strip_lines(join_checked(_keyed(docs, "source"), lossy, KEY, "left_semi"), judged, frequent, "source")
    digest = left.groupBy(F.col(KEY).alias("key")).agg(F.max(F.sha2(F.col("text").cast("binary"), 256)).alias("left_sha256"))
    return judged.join(digest, "key", "left").drop("key", "host", "lines")


OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
tok AS (SELECT k, generate_subscripts(ws, 1) AS i, ws FROM w WHERE len(ws) > 0),
win AS (SELECT k, i, array_to_string(ws[i : i + {WINDOW - 1}], chr(1)) AS g FROM tok WHERE i + {WINDOW - 1} <= len(ws)),
rep AS (SELECT k, i FROM win QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
cov AS (SELECT k, count(DISTINCT i + j) AS n FROM rep, range({WINDOW}) r(j) GROUP BY k),
ln AS (SELECT k, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM w),
lw AS (
  SELECT k, host, i, line, array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS norm,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
dup AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY k),
body AS (SELECT d.k, d.host, coalesce(string_agg(norm, chr(10) ORDER BY i), '') AS t FROM d LEFT JOIN lw USING (k) GROUP BY ALL),
hosts AS (SELECT host, count(DISTINCT t) AS texts FROM body GROUP BY host),
freq AS (
  SELECT l.host, norm FROM lw l JOIN body b USING (k) JOIN hosts h ON h.host IS NOT DISTINCT FROM l.host
  GROUP BY l.host, norm, texts HAVING count(DISTINCT t) > least({LINE_MOST}, greatest({LINE_LEAST}, texts * {LINE_SHARE}))
),
lost AS (SELECT k, i, n FROM lw l JOIN freq f ON f.norm = l.norm AND f.host IS NOT DISTINCT FROM l.host),
gone AS (SELECT k, sum(n) AS n FROM lost GROUP BY k),
rest AS (SELECT k, sha256(coalesce(string_agg(line, chr(10) ORDER BY i), '')) AS digest FROM ln ANTI JOIN lost USING (k, i) WHERE k IN (SELECT k FROM gone) GROUP BY k),
s AS (
  SELECT rest.digest, doc_id, len(ws) AS n_words, coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_boilerplate_words
  FROM w LEFT JOIN dup USING (k) LEFT JOIN cov USING (k) LEFT JOIN gone USING (k) LEFT JOIN rest USING (k)
), v AS (
SELECT *, (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {int(100 * REPEAT_SHARE)} * n_words) AS base_failed,
  n_words - n_boilerplate_words AS n_left_words,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {int(100 * REPEAT_SHARE)} * n_words)
  AND NOT (n_boilerplate_words > 0 AND (n_words - n_boilerplate_words < {LEFT_WORDS} OR n_words - n_boilerplate_words < {LEFT_SHARE} * n_words)) AS kept
FROM s
)
SELECT * EXCLUDE (digest), CASE WHEN kept AND n_boilerplate_words > 0 THEN digest END AS left_sha256 FROM v
"""
