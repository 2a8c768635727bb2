"""Licence scan by a positional index of rare words.

The words of the licence templates (whole licence texts, opening sentences, short notices) form a fixed vocabulary.  A first
pass counts in how many files each of them stands (one small vector per task), which gives their IDF over the whole corpus.
The index holds each vocabulary word's positions in every template.  A second pass looks up, for each file and template, the
``RARE_WORDS`` words of highest IDF that the file holds, intersects their postings by relative position (file position minus
template position, with a little slack), checks that the template's mandatory phrases stand there, and scores the passage by
its local alignment with the template, so names that were filled in and small edits cost little.

The base phrases are found on the same word sequence by plain comparison.

Defined results: null text is empty and has no words, places or labels (score 0, first and last null); labels are empty
strings where there are none; of words of equal IDF the smaller one comes first; where several templates score alike all their
labels count; texts are scanned whole, and work and memory grow with their words; repeated rows are scanned each; an empty
table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import folded_words, read_table
from codequarry.llm.decontamination import MATCH, smith_waterman
from codequarry.llm.license_texts import TEMPLATES

# Phrases and the labels they give.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

RARE_WORDS = 12
SLACK = 3
MIN_AGREE = 3
MIN_SCORE = 0.6

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
)


class Template:
    def __init__(self, label: str, text: str, phrases: list[str]):
        self.label = label
        self.words = folded_words(text.encode())
        self.phrases = [folded_words(p.encode()) for p in phrases]
        self.needs = frozenset(w for p in self.phrases for w in p)
        self.number = {w: i + 1 for i, w in enumerate(dict.fromkeys(self.words))}
        self.coded = np.array([self.number[w] for w in self.words], dtype=np.int64)
        self.at: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(self.words):
            self.at[w].append(i)


def holds_phrase(words: list[bytes], phrase: list[bytes]) -> bool:
    at = -1
    for _ in range(words.count(phrase[0])):
        at = words.index(phrase[0], at + 1)
        if words[at : at + len(phrase)] == phrase:
            return True
    return False


class RareWordIndex:
    """Positions of the vocabulary words in the templates, with each template's words by falling IDF."""

    def __init__(self, templates: list[Template], frequency: dict[bytes, int], n: int):
        self.templates = templates
        self.vocabulary = frozenset(w for t in templates for w in t.words)
        idf = {w: math.log((n + 1) / (frequency.get(w, 0) + 1)) for w in self.vocabulary}
        self.rarest = [sorted(t.at, key=lambda w: (-idf[w], w)) for t in templates]

    def chosen(self, held: frozenset[bytes] | set[bytes]) -> dict[bytes, list[int]]:
        """word -> templates that it is looked up in: for each template the rarest of its words that a file holds."""
        wanted: dict[bytes, list[int]] = defaultdict(list)
        for k, t in enumerate(self.templates):
            if t.needs <= held:
                own = [w for w in self.rarest[k] if w in held][:RARE_WORDS]
                if len(own) >= min(MIN_AGREE, len(t.at)):
                    for w in own:
                        wanted[w].append(k)
        return wanted

    def scan(self, words: list[bytes]) -> list[tuple[str, int, float]]:
        """(label, first word, score) of every verified passage."""
        wanted = self.chosen(self.vocabulary.intersection(words))
        if not wanted:
            return []
        offsets: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for at, w in enumerate(words):
            if w in wanted:
                for k in wanted[w]:
                    offsets[k] += [(at - i, w) for i in self.templates[k].at[w]]
        found = []
        for k, hits in offsets.items():
            t, hits = self.templates[k], sorted(hits)
            need, n = min(MIN_AGREE, len(t.at)), len(t.words)
            lo, inside, tried = 0, defaultdict(int), -2 * n
            for off, w in hits:
                inside[w] += 1
                while hits[lo][0] < off - SLACK:
                    inside[hits[lo][1]] -= 1
                    if not inside[hits[lo][1]]:
                        del inside[hits[lo][1]]
                    lo += 1
                # one alignment covers the offsets around it
                if len(inside) >= need and off - tried > n // 4:
                    tried = off
                    if (passage := self.verify(words, t, off)) is not None:
                        found.append((t.label, *passage))
        return found

    @staticmethod
    def verify(words: list[bytes], t: Template, off: int) -> tuple[int, float] | None:
        """First word and score of the passage around an offset, if it holds the phrases and scores enough."""
        n = len(t.words)
        lo = max(0, off - n // 2 - SLACK)
        near = words[lo : max(0, off + n + n // 2 + SLACK)]
        if not all(holds_phrase(near, p) for p in t.phrases):
            return None
        score, first, _ = smith_waterman(t.coded, np.array([t.number.get(w, 0) for w in near], dtype=np.int64))
        return (lo + first, score / (MATCH * n)) if score >= MIN_SCORE * MATCH * n else None


def templates() -> list[Template]:
    return [Template(*t) for t in TEMPLATES]


def word_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """Files that hold each vocabulary word, and files in all; each task sends one row per word."""
    vocab = frozenset(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = defaultdict(int)
        n = 0
        for batch in batches:
            for raw in batch.column(0):
                n += 1
                for w in vocab.intersection(folded_words(raw.as_py())):
                    seen[w] += 1
        seen[b""] = n
        yield pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())}, schema=pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    rows = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(count, "word binary, n long")
    total = {bytes(r[0]): r[1] for r in rows.groupBy("word").agg(F.sum("n")).collect()}  # at most the vocabulary
    n = total.pop(b"", 0)
    return total, n


def base_places(words: list[bytes]) -> tuple[list[int], set[str]]:
    """Starts of every place where a base phrase stands, and their labels."""
    places, labels = [], set()
    at = -1
    for _ in range(words.count(b"license")):
        at = words.index(b"license", at + 1)
        for phrase, label in _BASE:
            start = at - len(phrase) + 1
            if start >= 0 and words[start : at + 1] == phrase:
                places.append(start)
                labels.add(label)
    return places, labels


_BASE = [(p.encode().split(), label) for p, label in BASE_PHRASES.items()]  # each ends with "license"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: base places and labels, the index's labels, and its best score."""
    known = templates()
    frequency, n = word_frequencies(docs, {w for t in known for w in t.words})
    index = RareWordIndex(known, frequency, n)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
            for raw in batch.column(1):
                words = folded_words(raw.as_py())
                places, base = base_places(words)
                found = index.scan(words)
                out["n_words"].append(len(words))
                out["n_base"].append(len(places))
                out["first_word"].append(min(places) if places else None)
                out["last_word"].append(max(places) if places else None)
                out["base_labels"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted(base | {f[0] for f in found})))
                out["score"].append(max((f[2] for f in found), default=0.0))
            out["doc_id"] = batch.column(0)
            yield pa.RecordBatch.from_pydict(out, schema=_ARROW)

    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(scan, SCHEMA)


_TYPES = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
_ARROW = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in SCHEMA.split(", ")])


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))
