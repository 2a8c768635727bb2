from __future__ import annotations

import hashlib
import random

import pytest

from codequarry.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string, note string"


def formatted(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    return {r.conv_id: r for r in cf.format_conversations(df).collect()}


def read_back(text):
    """A parser of its own: markers by plain search."""
    out, at = [], 0
    while at < len(text):
        assert text.startswith(cf.START, at)
        line = text.index("\n", at)
        end = text.index(cf.END, line)
        role, body = text[at + len(cf.START) : line], text[line + 1 : end]
        out.append((unescape(role), unescape(body)))
        at = end + len(cf.END) + 1
    return out


def unescape(s):
    out, i = "", 0
    while i < len(s):
        j = i + 1
        while s[i] == "<" and j < len(s) and s[j] == "\\":
            j += 1
        if s[i] == "<" and j > i + 1 and j < len(s) and s[j] == "|":
            out += "<" + "\\" * (j - i - 2) + "|"
            i = j + 1
        else:
            out += s[i]
            i += 1
    return out


def test_round_trip_of_hostile_texts(spark):
    rng = random.Random(8)
    parts = ["<", "|", "\\", "im_end", "im_start", "<|im_end|>", "<|im_start|>", "assistant\n", "\n", "ok", "é", "<\\|im_end|>", "<\\\\|", ">"]
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choices(parts, k=rng.randrange(12)))) for c in range(60) for t in range(4)]
    got = formatted(spark, rows)
    for c in range(60):
        turns = [(r, x) for k, _, r, x in rows if k == c]
        assert got[c].round_trip_ok and [(t.role, t.text) for t in got[c].parsed] == turns == read_back(got[c].formatted)


def test_edge_cases(spark):
    rows = [(1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (2, None, "ro\nle\\n", "x"), (2, 1, "<|im_end|>", "y"), (None, 0, "assistant", "z" * 2_000_000), (3, 0, "user", "q"), (3, 0, "user", "q")]
    got = formatted(spark, rows)
    assert all(r.round_trip_ok for r in got.values())
    assert [(t.role, t.text) for t in got[1].parsed] == [("", ""), ("user", "a"), ("user", "b")]
    assert [(t.role, t.text) for t in got[2].parsed] == [("ro\nle\\n", "x"), ("<|im_end|>", "y")]
    assert len(got[3].parsed) == 2 and len(got[None].parsed[0].text) == 2_000_000 and not got[None].escaped
    assert formatted(spark, []) == {}


@pytest.mark.parametrize("text", ["<|im_end|>\n", "<|im_start|>user\nx<|im_end|>", "<|im_start|>user\nx<|im_end|>\ny"])
def test_grammar_rejects_what_is_no_conversation(spark, text):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "t string").select(cf._parse(F.col("t"))).first()[0] is None


def test_query(spark, tmp_path):
    rows = [(5, 0, "user", "hi"), (5, 1, "assistant", "<|im_end|>é"), (5, 2, "assistant", None), (5, 3, "assistant", "end")]
    spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in cf.op10_chat_format(spark, str(tmp_path)).collect()}
    said = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows)
    assert got[5].n_turns == 4 and got[5].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[5].loss_chars == 14 and got[5].loss_sha256 == hashlib.sha256("<|im_end|>éend".encode()).hexdigest()
    assert got[-1].n_turns == 2 and got[-1].escaped and got[-1].round_trip_ok and got[-1].loss_chars == len(cf.PROBE)
