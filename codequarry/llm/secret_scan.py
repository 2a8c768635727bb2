"""Secret scan with corpus-wide ownership frequency.

Every text is matched against the base patterns and further credential formats.  Values are hashed (no secret leaves
its document) and counted over the whole corpus by distinct repository and owner: a value that several owners hold in
several repositories is a widely copied example, any other is its owner's live-looking credential.

A copied document brings its credentials along and says nothing of who else uses them.  So texts that are copies or
near copies of each other are one text, and for each value it counts once: for the owner and repository of its smallest
doc_id.  Near copies are found by MinHash: texts that share a band of coordinates and agree in ``ALIKE`` of
``COORDINATES`` are linked, and linked texts are one.  A text under ``COPY_WORDS`` words is a line that many may write
alike; it counts in each repository that has it.

Counting: (value, text, owner, repository) is made distinct first, so a value that a third of all rows hold is summed
before it moves; a band never emits its pairs, only a star of its least text and the others; the verdicts are joined back
on the hash, where Spark can split a frequent one.

Patterns have no upper length: private keys and credentials in addresses are found by scans that meet each character once or
twice, whatever the length of text or value.

Defined results: null text is empty; without spans the digests are of the empty string and the counts 0; null owner and
repository count as one value each; spans that begin at one place are ordered by kind as listed; of copies with equal ids the
one of smaller owner and repository speaks for all; repeated rows give equal results and count once in the frequencies; an
empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import KEY_TYPE, join_checked, materialize, mix64, read_table, row_key, windows, word_hashes
from codequarry.llm.ngram_join import WORDS, components, set_hashes, sketch

# Base patterns with their least length, then the further kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
FURTHER = {
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"),
    "slack": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "google": re.compile(r"AIza[A-Za-z0-9_-]{35}"),
    "bearer": re.compile(r"Bearer\x20+([A-Za-z0-9+/_.=-]{20,})"),
}
KINDS = ["assign", "access", "hex", *FURTHER, "pem", "url"]
#: A private key goes from a head to the next foot of the same label with no other head between; header lines may stand in it.
_PEM_HEAD = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----")
#: What follows the scheme of an address with user and password, and what a scheme is made of.
_URL_REST = re.compile(r"://[A-Za-z0-9_.-]+:([^\s:@/]{6,})@")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+")
_HINT = re.compile(r"(?:pass|secret|token|api)", re.A | re.I)

#: Owners, and repositories, from which on a value is a widely copied example.
EXAMPLE_OWNERS = 2
EXAMPLE_REPOS = 3
#: Words from which on a text can be told to be a copy.
COPY_WORDS = 8
#: At a similarity of 0.5, 99 % of pairs share a band of two coordinates, and 99 % agree in ALIKE or more; at 0.1, 15 % and 0.1 %.
COORDINATES, BAND, ALIKE = 32, 2, 10

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
SCHEMA = f"key {KEY_TYPE}, doc_id long, owner string, repo string, spans array<struct<kind:string,start:long,end:long,value:string>>, set long, sketch binary"


def private_keys(text: str) -> list[tuple[int, int]]:
    heads = list(_PEM_HEAD.finditer(text))
    found = []
    for i, m in enumerate(heads):
        foot = f"-----END {m[1]}PRIVATE KEY-----"
        stop = heads[i + 1].start() if i + 1 < len(heads) else len(text)
        if (at := text.find(foot, m.end(), stop)) >= 0:
            found.append((m.start(), at + len(foot)))
    return found


def url_passwords(text: str) -> list[tuple[int, int, str]]:
    """Start at the first letter of the scheme (two characters at least), end behind the ``@``."""
    found, last = [], 0
    for m in _URL_REST.finditer(text):
        at = m.start()
        while at > last and text[at - 1] in _SCHEME:
            at -= 1
        while at < m.start() and not text[at].isalpha():
            at += 1
        if m.start() - at >= 2:
            found.append((at, m.end(), m[1]))
        last = m.end()
    return found


def find_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, hash of the value) in code points, by start, then by kind as listed."""
    found: list[tuple[str, int, int, str]] = []
    if _HINT.search(text):
        found += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    for kind, pattern in FURTHER.items():
        if _LITERAL[kind] in text:
            found += [(kind, *m.span(), m[1] if pattern.groups else m[0]) for m in pattern.finditer(text)]
    if "-----BEGIN" in text:
        found += [("pem", start, end, text[start:end]) for start, end in private_keys(text)]
    if "://" in text:
        found += [("url", *u) for u in url_passwords(text)]
    found.sort(key=lambda f: (f[1], KINDS.index(f[0])))
    return [(k, s, e, hashlib.sha256(v.encode()).hexdigest()) for k, s, e, v in found]


_LITERAL = {"github": "gh", "slack": "xox", "jwt": "eyJ", "google": "AIza", "bearer": "Bearer"}


def text_print(text: str) -> tuple[int | None, bytes | None]:
    """Hash of the text's set of word n-grams and the set's sketch; nulls for a text too short to be told to be a copy."""
    h = word_hashes(text.encode())
    if len(h) < COPY_WORDS:
        return None, None
    s = np.unique(windows(h, WORDS))
    return set_hashes(s)[0], sketch(s)[:COORDINATES].tobytes()


def candidates(docs: DataFrame, owner: str, repo: str) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(4)]
            spans = [[{"kind": k, "start": s, "end": e, "value": v} for k, s, e, v in find_spans(t)] for t in texts]
            prints = [text_print(t) if found else (None, None) for t, found in zip(texts, spans, strict=True)]
            columns = [pa.array(spans, pa.list_(SPAN)), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *columns], names=["key", "doc_id", "owner", "repo", "spans", "set", "sketch"])

    text = F.coalesce("text", F.lit(""))
    owner_c, repo_c = F.col(owner).cast("string"), F.concat_ws("\x00", F.col(owner).cast("string"), F.col(repo).cast("string"))
    rows = docs.select(
        row_key(F.col("doc_id"), owner_c, repo_c, text).alias("key"), F.col("doc_id").cast("long").alias("doc_id"),
        owner_c.alias("owner"), repo_c.alias("repo"), text.alias("text"),
    )
    return rows.mapInArrow(scan, SCHEMA)


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)


def near_copies(found: DataFrame) -> DataFrame:
    """(set, text): the texts that have near copies, and what stands for each group of them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = COORDINATES // BAND
        for b in batches:
            parts = _sketches(b.column(1)).astype(np.uint64).reshape(-1, n, BAND)
            band = np.tile(mix64(np.arange(1, n + 1, dtype=np.uint64)), (len(parts), 1))
            for k in range(BAND):
                band = mix64(band ^ parts[:, :, k])
            at = pa.array(np.repeat(np.arange(len(parts)), n))
            yield pa.RecordBatch.from_arrays([pa.array(band.ravel().astype(np.int64)), b.column(0).take(at), b.column(1).take(at)], names=["band", "set", "sketch"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            alike = pa.array((_sketches(b.column(1)) == _sketches(b.column(3))).sum(axis=1) >= ALIKE)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(alike), b.column(2).filter(alike)], names=["a", "b"])

    sets = found.where("set IS NOT NULL").groupBy("set").agg(F.first("sketch").alias("sketch"))
    bands = materialize(sets.mapInArrow(cut, "band long, set long, sketch binary"), "secret-bands")
    least = bands.groupBy("band").agg(F.count("*").alias("n"), F.min(F.struct("set", "sketch")).alias("least")).where("n > 1").drop("n")
    pairs = bands.join(least, "band").where("set != least.set").select("set", "sketch", F.col("least.set").alias("b"), F.col("least.sketch").alias("other"))
    edges = pairs.mapInArrow(link, "a long, b long").distinct()
    return components(edges).select(F.col("node").alias("set"), F.col("root").alias("text"))


def ownership(found: DataFrame) -> DataFrame:
    """value, n_owners, n_repos over the whole corpus, each text counted once for a value."""
    values = found.select("doc_id", "owner", "repo", "set", F.explode(F.array_distinct("spans.value")).alias("value"))
    # null ids come last
    each = values.groupBy("value", "set", "owner", "repo").agg(F.coalesce(F.min("doc_id"), F.lit((1 << 63) - 1)).alias("doc_id"))
    named = join_checked(each, materialize(near_copies(found), "secret-texts"), "set", "left").withColumn("text", F.coalesce("text", "set"))
    short = F.col("text").isNull()
    texts = named.groupBy("value", "text", F.when(short, F.col("owner")).alias("o"), F.when(short, F.col("repo")).alias("r")).agg(
        F.min(F.struct("doc_id", "owner", "repo")).alias("first")
    )
    by_repo = texts.groupBy("value", F.col("first.owner").alias("owner"), F.col("first.repo").alias("repo")).agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))


def scan_secrets(
    docs: DataFrame, owner: str = "source", repo: str = "lang", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS
) -> DataFrame:
    """doc_id, key, spans and for each document the numbers of its live-looking and of its example values."""
    found = materialize(candidates(docs, owner, repo), "secrets")
    example = (F.col("n_owners") >= example_owners) & (F.col("n_repos") >= example_repos)
    verdict = ownership(found).select("value", example.alias("example"))
    held = found.where(F.size("spans") > 0).select("key", F.explode(F.array_distinct("spans.value")).alias("value")).distinct()
    counts = held.join(verdict, "value").groupBy("key").agg(
        F.count_if(~F.col("example")).alias("n_live"), F.count_if("example").alias("n_example")
    )
    return found.join(counts, "key", "left").select(
        "doc_id", "key", "spans", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_example"))
    )


def _joined(spans: Column) -> Column:
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_secrets(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), "n_live", "n_example",
    )
