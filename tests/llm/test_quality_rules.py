from __future__ import annotations

import random
import re

from codequarry.llm import quality_rules as qr

SPACE = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    words = re.findall(SPACE, text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_statistics_equal_brute_force():
    rng = random.Random(6)
    parts = ["a", "b", "é#", "日本", "<x>", "\n", "\n\n", "\t", " ", "\x0b", "\x1c", " ", "a b c d e f g h\n"]
    for _ in range(400):
        text = " ".join(rng.choices(parts, k=rng.randrange(60)))
        assert qr.text_stats(text.encode())[:5] == brute(text)


def judged(docs):
    return {r.doc_id: r for r in qr.apply_quality_rules(docs).collect()}


def test_frequent_lines_deplete_documents(make_docs):
    body = lambda i, n=40: " ".join(f"w{i}x{j}" for j in range(n))
    menu = "Home | About | Contact us for more of this and that today"
    rows = [(i, f"{body(i)}\n{menu}", "h", "en") for i in range(60)]
    rows += [(100, "\n".join(menu.upper() + f" {' ' * i}" for i in range(9)) + "\nonly four words here", "h", "en")]
    rows += [(200, body(1) + "\n" + menu, "other", "en"), (201, "too short", "other", "en")]
    # copies of one text make no line frequent
    rows += [(300 + i, body(7, 60), "h", "en") for i in range(80)]
    got = judged(make_docs(rows))
    assert got[0].kept and got[0].n_boilerplate_words == 13 and got[0].n_left_words == 40
    assert not got[100].kept and got[200].kept and got[200].n_boilerplate_words == 0 and not got[201].kept
    assert all(got[300 + i].kept for i in range(80))
    cleaned = {r.doc_id: r.text for r in qr.clean_documents(make_docs(rows)).collect()}
    listed = {r.doc_id: r.text for r in qr.clean_documents(make_docs(rows), rows=0).collect()}
    assert listed == cleaned
    assert cleaned[0] == body(0) and cleaned[200] == body(1) + "\n" + menu and 100 not in cleaned and 201 not in cleaned


def test_the_limit_has_an_upper_end(make_docs, monkeypatch):
    """A line in 60 of 1000 documents of a host is below 10 % of them, and above the upper end."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30)) + ("\nsubscribe to our newsletter" if i < 60 else ""), "h", "en") for i in range(1000)]
    assert judged(make_docs(rows))[0].n_boilerplate_words == 0
    assert next(r.text for r in qr.clean_documents(make_docs(rows)).collect() if r.doc_id == 0) == rows[0][1]
    frequent = lambda most: qr.frequent_lines(qr.document_stats(make_docs(rows)), most=most).count()
    assert (frequent(60), frequent(59)) == (0, 1)


def test_only_the_lines_themselves_go():
    gone = qr.text_stats("the  Menu\nfoot é".encode())[5]
    drop = __import__("numpy").array([x["hash"] for x in gone], dtype="int64")
    text = " THE menu\t\n\nbody of it\x0bThe menu\nfoot É\nfoot é\n \n"
    assert qr.without_lines(text, drop) == "\nbody of it\x0bThe menu\nfoot É\n \n" and qr.without_lines("", drop) == "" and qr.without_lines("\n\n", drop) == "\n\n"


def test_columns_may_clash(spark):
    docs = spark.createDataFrame([(i, "foot\n" + " ".join(f"w{i}x{j}" for j in range(30)), "h", 1, "k", 2) for i in range(40)], "doc_id long, text string, source string, hash int, key string, lines int")
    out = qr.clean_documents(docs)
    assert out.columns == docs.columns and all("foot" not in r.text and (r.hash, r.key, r.lines) == (1, "k", 2) for r in out.collect())


def test_edge_cases(make_docs):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(0, None, None, None), (1, "", "h", "en"), (None, text, None, None), (3, text, "h", "en"), (3, text, "h", "en"), (4, "x y " * 100_000, "h", "en"), (5, " \n \n", "h", "en")]
    got = judged(make_docs(rows))
    assert not got[0].kept and not got[1].kept and got[None].kept and got[3].kept and not got[5].kept
    assert got[4].n_repeat_words == 200_000 and not got[4].kept
    assert len(qr.apply_quality_rules(make_docs(rows)).collect()) == 7 and judged(make_docs([])) == {}
