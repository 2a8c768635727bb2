from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

from codequarry.llm import sharding as sh


def bits(doc_id, text):
    inner = hashlib.md5((text or "").encode()).hexdigest()
    head = hashlib.md5(f"{'' if doc_id is None else doc_id}:{inner}".encode()).hexdigest()[:15]
    return f"{int(head, 16):060b}"


def brute(rows, limit):
    total = sum(len((t or "").encode()) for _, t in rows)
    base = max(0, math.ceil(math.log2(max(1, total / limit))))
    todo, out = defaultdict(list), {}
    for r in rows:
        todo[bits(*r)[:base]].append(r)
    while todo:
        prefix, own = todo.popitem()
        if len(own) == 1 or sum(len((t or "").encode()) for _, t in own) <= limit:
            for r in own:
                out[r[0]] = prefix
        else:
            for r in own:
                todo[bits(*r)[: len(prefix) + 1]].append(r)
    return out


def rows_of(seed, n):
    rng = random.Random(seed)
    return [(i, "x" * rng.choice([0, 10, 100, 100, 3000])) for i in range(n)]


def test_equals_brute_force(make_docs):
    for limit in (200, 4000, 10**6):
        rows = rows_of(limit, 500)
        got = {r.doc_id: r.shard for r in sh.shard_documents(make_docs([(i, t, "s", "en") for i, t in rows]), limit).collect()}
        assert got == brute(rows, limit)


def test_every_shard_fits_and_splits_past_the_first_directory(make_docs, monkeypatch):
    monkeypatch.setattr(sh, "FINE_BITS", 1)
    rows = rows_of(9, 400)
    found = sh.shard_documents(make_docs([(i, t, "s", "en") for i, t in rows]), 150).collect()
    assert {r.doc_id: r.shard for r in found} == brute(rows, 150)
    size = defaultdict(lambda: [0, 0])
    for r in found:
        size[r.shard][0] += r.bytes
        size[r.shard][1] += 1
    assert all(b <= 150 or n == 1 for b, n in size.values())
    assert all(size[r.shard] == [r.shard_bytes, r.shard_rows] for r in found)


def test_edge_cases(make_docs):
    rows = [(7, "y" * 60, "s", "en")] * 10 + [(None, None, None, None), (None, "z", None, None), (1, "é" * 40, "s", "en")]
    found = sh.shard_documents(make_docs(rows), 130).collect()
    assert len(found) == 13
    size = defaultdict(int)
    for r in found:
        size[r.shard] += r.bytes
    assert max(size.values()) <= 130 and sum("+" in r.shard for r in found) == 10
    assert sh.shard_documents(make_docs([])).collect() == []


def test_written_shards_fit(spark, make_docs, tmp_path):
    rows = [(i, t, "s", "en") for i, t in rows_of(4, 60)] + [(99, "y" * 60, "s", "en")] * 10
    docs = make_docs(rows)
    sh.write_shards(docs, sh.assign_shards(sh.slim_rows(docs), 500), f"{tmp_path}/out", 500)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 70
    size = defaultdict(list)
    for r in back.collect():
        size[r[sh.FOLDER]].append(len(r.text))
    assert all(sum(b) <= 500 or len([x for x in b if x]) == 1 for b in size.values())


def test_written_shards_are_the_assigned_ones_and_columns_may_clash(spark, make_docs, tmp_path):
    rows = [(i, t, "s", "en", f"v{i}", 7) for i, t in rows_of(5, 120)] + [(500, "z" * 90, "s", "en", "c", 7)] * 30
    docs = make_docs(rows, ", shard string, bytes int")
    assigned = sh.assign_shards(sh.slim_rows(docs), 400)
    sh.write_shards(docs, assigned, f"{tmp_path}/out", 400)
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.doc_id, r.shard, r.bytes) for r in back) == sorted((i, v, b) for i, _, _, _, v, b in rows)
    assert sorted((r.doc_id, r[sh.FOLDER]) for r in back) == sorted((r.doc_id, "b" + r.shard) for r in assigned.collect())


def test_a_hot_record_is_numbered_over_many_parts(make_docs):
    docs = make_docs([(7, "y" * 10, "s", "en")] * 5000 + [(i, "x" * 10, "s", "en") for i in range(100, 200)]).repartition(23)
    found = sh.shard_documents(docs, 1000).collect()
    pages = defaultdict(int)
    for r in found:
        pages[r.shard] += r.bytes
    assert len(found) == 5100 and max(pages.values()) <= 1000 and sum("+" in s for s in pages) == 50
