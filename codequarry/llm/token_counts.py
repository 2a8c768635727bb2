"""Token counts as delta-maintained rollups.

A change carries its sign: an insert adds a document's counts, a delete takes them away, and a revised count is the old
one with -1 and the new one with +1.  Each batch is reduced to its additive totals by source, language and tokenizer
version, and committed under its id.  The rollup is the sum over committed batches.

Commit: the batch's totals are written to a folder of its own attempt; then a small file that names the attempt is written
under a temporary name and renamed to the batch id, which fails if that name is taken.  So a commit file is whole from the
moment it is there, a batch id that is committed already changes nothing, and an attempt that died before its rename is
never read.  Once ``FOLD`` commits have come together, they are folded: a numbered folder, renamed into place in the same
way, holds their totals and the ids that it covers, so a reader opens at most that many commits.

White-space runs above ``LONG_RUN`` characters are encoded as the one piece that the pre-tokenizer makes of them, without
its search, which can't hold them; the tokens are the same (tested).

Defined results: null text has no tokens and is a document; null source or language is a group of its own; repeated rows
are documents of their own; texts are encoded whole, however long they are; totals don't depend on the order of rows, so
ties do nothing; groups whose documents and tokens are all gone leave the rollup; an empty table gives no rows; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import read_table
from codequarry.session import scratch

#: Folder of the public vocabulary files; a parameter, read on the driver only.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")

# The pre-tokenizer pattern of the byte-level vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters of white space that the pre-tokenizer still gets in one run.
LONG_RUN = 10_000
# The code points of Unicode's White_Space.
_LONG_SPACE = re.compile(r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)

#: Commits from which on they are folded.
FOLD = 64

KEYS = ["source", "lang", "tokenizer"]
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
_ENCODERS: dict[str, object] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def token_count(encoding, text: str) -> int:
    """Number of tokens of a text.

    The pre-tokenizer takes a run of white space before a word as one piece without its last character, and a run at
    the end as one piece; long ones go to the merges directly.
    """
    n = at = 0
    for run in _LONG_SPACE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        n += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._core_bpe.encode_single_piece(text[run.start() : end].encode()))
        at = end
    return n + len(encoding.encode_ordinary(text[at:] if at else text))


def count_tokens(docs: DataFrame, version: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """Adds tokenizer and n_tokens to documents (source, lang); texts are tokenized whole, on the executors.

    The vocabulary (a fixed 50,000 entries) is broadcast from the driver, so executors need no local file.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(f"{folder}/{version}.tiktoken"))
    names = ["doc_id", "source", "lang"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        if version not in _ENCODERS:
            _ENCODERS[version] = tiktoken.Encoding(version, pat_str=BYTE_PATTERN, mergeable_ranks=ranks.value, special_tokens={})
        encoding = _ENCODERS[version]
        for b in batches:
            n = pa.array([token_count(encoding, t.as_py()) for t in b.column(3)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], n], names=[*names, "n_tokens"])

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"),
    )
    counted = rows.mapInArrow(run, "doc_id long, source string, lang string, n_tokens long")
    return counted.withColumn("tokenizer", F.lit(version))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(1))


def deletes(counts: DataFrame) -> DataFrame:
    """Changes that take away documents by the counts that they were inserted with."""
    return counts.withColumn("sign", F.lit(-1))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes from one state of the same documents (older text or tokenizer version) to another."""
    return deletes(old).unionByName(inserts(new))


def delta(changes: DataFrame) -> DataFrame:
    """Additive totals of signed changes; summed within each task before anything moves."""
    return changes.groupBy(*KEYS).agg(
        F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens")
    )


class TokenRollup:
    """A rollup in a shared folder.

    ``deltas/<attempt>/`` holds totals, ``commits/<batch>`` names the attempt that counts, ``folds/<n>/`` the totals of the
    batches listed in it; the highest fold and the commits that it doesn't list make the rollup.
    """

    def __init__(self, spark: SparkSession, path: str, fold: int = FOLD):
        self.spark, self.path, self.fold_at = spark, path, fold
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(path).toUri(), conf)
        self._no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        for d in ("deltas", "commits", "folds", "temp"):
            self._fs.mkdirs(self._path(f"{path}/{d}"))

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/{folder}"))]

    def _rename(self, temp: str, name: str) -> bool:
        """Give a finished file or folder its name; False if the name is taken."""
        try:
            self._context.rename(self._path(f"{self.path}/temp/{temp}"), self._path(f"{self.path}/{name}"), self._no_overwrite)
        except Exception as e:
            if self._fs.exists(self._path(f"{self.path}/{name}")):
                self._fs.delete(self._path(f"{self.path}/temp/{temp}"), True)
                return False
            raise e
        return True

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/commits/{batch}"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was applied before (also by a writer that was faster just now)."""
        if not batch or set(batch) & set("/\\: \n") or batch.startswith((".", "_")):
            raise ValueError(f"not a batch id: {batch!r}")
        if self.committed(batch):
            return False
        attempt = f"{batch}-{uuid.uuid4().hex}"
        delta(changes).coalesce(1).write.parquet(f"{self.path}/deltas/{attempt}")
        if not self._create(batch, attempt):
            return False
        if len(self._open()[1]) >= self.fold_at:
            self.fold()
        return True

    def _create(self, batch: str, attempt: str) -> bool:
        stream = self._fs.create(self._path(f"{self.path}/temp/{attempt}"), False)
        stream.write(bytearray(attempt.encode()))
        stream.close()
        return self._rename(attempt, f"commits/{batch}")

    def _open(self) -> tuple[int, list[str]]:
        """Number of the highest fold (0: none) and the batches that it doesn't cover."""
        last = max(map(int, self._names("folds")), default=0)
        done = {r[0] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/folds/{last}/batches").collect()} if last else set()
        return last, sorted(set(self._names("commits")) - done)

    def _attempts(self, batches: list[str]) -> list[str]:
        """The attempts of at most about ``FOLD`` batches."""
        found = []
        for batch in batches:
            stream = self._fs.open(self._path(f"{self.path}/commits/{batch}"))
            try:
                found.append(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        return found

    def _sum(self, last: int, batches: list[str]) -> DataFrame:
        folders = [f"{self.path}/deltas/{a}" for a in self._attempts(batches)] + ([f"{self.path}/folds/{last}/totals"] if last else [])
        if not folders:
            return self.spark.createDataFrame([], TOTALS)
        rows = self.spark.read.schema(TOTALS).parquet(*folders)
        summed = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where("n_docs != 0 OR n_tokens != 0")

    def fold(self) -> bool:
        """Bring the open commits into one; False if another writer has just made that fold."""
        last, batches = self._open()
        temp = f"fold-{uuid.uuid4().hex}"
        self._sum(last, batches).coalesce(1).write.parquet(f"{self.path}/temp/{temp}/totals")
        names = self.spark.createDataFrame([(b,) for b in batches], "batch string")
        if last:
            names = names.unionByName(self.spark.read.schema("batch string").parquet(f"{self.path}/folds/{last}/batches"))
        names.coalesce(1).write.parquet(f"{self.path}/temp/{temp}/batches")
        return self._rename(temp, f"folds/{last + 1}")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches."""
        return self._sum(*self._open())


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a batch that inserts all documents, sent twice: the replay changes nothing."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rollup = TokenRollup(spark, scratch(spark, "rollup"))
    changes = inserts(count_tokens(docs))
    for _ in range(2):
        rollup.commit("insert-all", changes)
    return rollup.totals()
