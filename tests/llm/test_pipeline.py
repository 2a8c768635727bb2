"""The pipeline's stages by their own inputs, against brute force where the stage's operator is not SQL."""

from __future__ import annotations

import random

import corpus_pipeline as cp

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(3000)]
    item = " ".join(rng.choices(vocab, k=40))
    rows = []
    for i in range(150):
        words = rng.choices(vocab, k=rng.choice([40, 120, 300]))
        rows.append([i, " ".join(words), "en", f"src{i % 4}"])
    for i in range(150, 170):
        rows.append([i, rows[i - 150][1], "en", "src1"])  # exact copies
    for i in range(170, 190):
        words = rows[i - 150][1].split()
        words[5] = "changed"
        rows.append([i, " ".join(words * 3), "en", "src2"])
        rows[i - 150][1] = " ".join(rows[i - 150][1].split() * 1)
    for i in range(190, 195):
        rows.append([i, f"{' '.join(rng.choices(vocab, k=50))} {item} {' '.join(rng.choices(vocab, k=50))}", "en", None])
    rows += [[195, "too short", "en", "src0"], [196, None, None, None]]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], item


def test_stages_keep_and_drop(spark, tmp_path):
    rows, item = corpus()
    sf = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "shard"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        if name != "shard":
            assert docs.columns == COLUMNS
    tripled = set(range(170, 190))  # each text three times: all words repeat
    assert set(kept["quality"]) == set(range(195)) - tripled
    assert set(kept["near_duplicates"]) == set(kept["quality"]) - set(range(150, 170))
    assert set(kept["decontaminate"]) == set(kept["near_duplicates"]) - set(range(190, 195))
    assert set(kept["mix"]) <= set(kept["decontaminate"]) and len(kept["mix"]) > len(set(kept["mix"]))
    assert sorted(kept["shard"]) == sorted(kept["mix"])
    # the shards hold the mix's documents, each in the folder that its row names
    folders = docs.select("folder").distinct().collect()
    base = folders[0].folder.rsplit("/", 1)[0]
    written = spark.read.parquet(base)
    before = spark.read.parquet(f"{sf}/mix")
    assert sorted(map(tuple, written.select(COLUMNS).collect())) == sorted(map(tuple, before.collect()))
    at = sorted((r.doc_id, f"{base}/{cp.sharding.FOLDER}={r[cp.sharding.FOLDER]}") for r in written.collect())
    assert at == sorted((r.doc_id, r.folder) for r in docs.collect())


def test_run_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_extra_and_clashing_columns(spark, tmp_path):
    """Columns named like the operators' own ones pass through."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30)), "en", "s", 1, 5, "c", "t", 2) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key int, set string, path string, hash int")
    spark.createDataFrame([(0, "a b c d")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert cp.shard(spark, docs, str(tmp_path)).count() == docs.count()


def test_equal_rows_become_one(spark):
    rows = [(1, "a b c d e f g h", "en", "s", 1)] * 3 + [(2, "x y z q r s t u", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in cp.near_duplicates(spark, docs, "").collect()) == [1, 2]


def test_one_document_of_each_group_stays_whatever_the_ids(spark):
    words = [f"w{i}" for i in range(200)]
    edit = lambda k: " ".join(words[:k] + [f"e{k}"] + words[k + 1 :])
    rows = [(1, edit(3)), (1, edit(50)), (2, edit(3)), (None, "p " + " ".join(words[::-1])), (None, "q " + " ".join(words[::-1])), (None, "alone here"), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = [(r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, "").collect()]
    # groups: both of id 1 with id 2, two without an id; and two rows that stand alone
    assert len(out) == 4 and sum(i == 1 for i, _ in out) == 1 and sum(i is None for i, _ in out) == 2 and (5, "") in out


def test_frequent_lines_leave_the_corpus(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30)) + "\nall rights reserved", "en", "s", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for r in cp.quality(spark, docs, "").collect():
        assert r.text == rows[r.doc_id][1].split("\n")[0] and r.n_chars == len(r.text)
