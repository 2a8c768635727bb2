from __future__ import annotations

import random
import re

from codequarry.llm import license_scan as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MIT, BSD, ZLIB, GPL = (next(t[1] for t in ls.TEMPLATES if t[0] == x) for x in ("mit", "bsd", "zlib", "gpl"))


def base(text):
    words = WORD.findall((text or "").translate(LOWER))
    at, labels = [], set()
    for phrase, label in ls.BASE_PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def scan(docs):
    return {r.doc_id: r for r in ls.scan_licenses(docs).collect()}


def test_base_columns_equal_brute_force(make_docs):
    rng = random.Random(1)
    parts = ["MIT License", "mit-license", "Apache\nLICENSE", "general public license", "license", "é MİT", "x", "İ license", "MIT  (license)", "K mit"]
    rows = [(i, " ".join(rng.choices(parts, k=rng.randrange(12))), "s", "en") for i in range(200)]
    got = scan(make_docs(rows))
    for i, text, *_ in rows:
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_templates_are_found_where_edited(make_docs):
    rng = random.Random(2)
    filler = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    edited = MIT.replace("obtaining", "getting").replace("without limitation ", "")
    rows = [
        (0, filler(50) + " " + MIT + " " + filler(50), "s", "en"), (1, filler(30) + " " + edited, "s", "en"), (2, filler(100), "s", "en"),
        (3, "Licensed under CC BY-NC 4.0.", "s", "en"), (4, "the software is hereby granted to any person free of charge without limitation the rights", "s", "en"),
        (5, "Released under the MIT License.", "s", "en"), (6, BSD, "s", "en"),
    ]
    got = {i: r.labels for i, r in scan(make_docs(rows)).items()}
    assert got == {0: "mit", 1: "mit", 2: "", 3: "cc-by-nc", 4: "", 5: "mit", 6: "bsd"}


def best_by_brute_force(words, template):
    """Best plain local alignment of a template with the whole text, if the text holds its phrases."""
    for p in template.phrases:
        if not any(words[i : i + len(p)] == p for i in range(len(words))):
            return 0.0
    a, b = template.words, words
    row = [0] * (len(b) + 1)
    best = 0
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            new[j + 1] = max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1)
        best = max(best, max(new))
        row = new
    return best / (2 * len(a))


def test_index_equals_brute_force_over_every_template():
    """All templates aligned with all of each text, without any index: the same labels, and the same best score."""
    rng = random.Random(6)
    filler = lambda n: [f"w{rng.randrange(99)}" for _ in range(n)]
    known = ls.templates()
    index = ls.RareWordIndex(known, {b"software": 50, b"the": 90, b"license": 20}, 100)
    found_some = 0
    for i in range(24):
        t = known[i % len(known)]
        own = [w.decode() for w in t.words]
        for _ in range(rng.choice([0, 1, len(own) // 20])):
            own[rng.randrange(len(own))] = "edited"
        if i % 3 == 0:  # a holder's name in the middle
            own[len(own) // 2 : len(own) // 2] = ["acme", "widgets", "and", "sons"]
        words = [w.encode() for w in filler(rng.randrange(30)) + own + filler(rng.randrange(30))]
        got = index.scan(words)
        want = [(x.label, s) for x in known if (s := best_by_brute_force(words, x)) >= ls.MIN_SCORE]
        assert {g[0] for g in got} == {w[0] for w in want} and max((g[2] for g in got), default=0) == max((w[1] for w in want), default=0)
        found_some += bool(got)
    assert found_some >= 18


def test_words_are_chosen_by_what_the_file_holds():
    """The second half of a licence has none of the template's overall rarest words, and is looked up by its own."""
    mit = ls.Template("mit", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon", ["rho sigma"])
    frequency = {w: i for i, w in enumerate(mit.words)}
    index = ls.RareWordIndex([mit], frequency, 100)
    tail = mit.words[8:]
    assert set(index.chosen(set(tail))) == set(tail) and index.rarest[0][: ls.RARE_WORDS] == mit.words[: ls.RARE_WORDS]
    assert index.scan(tail) == [("mit", 0, 12 / 20)]


def test_whole_texts_with_a_name_in_between(make_docs):
    named = BSD.replace("COPYRIGHT HOLDER OR", "ACME WIDGETS AND SONS INCORPORATED OR")
    rows = [(0, f"x {named} y", "s", "en"), (1, ZLIB + "\n" + GPL, "s", "en"), (2, MIT * 3, "s", "en")]
    got = scan(make_docs([(*r, 1, 2.0) for r in rows], ", n_words int, score double"))
    index = ls.RareWordIndex(ls.templates(), {}, 1)
    assert any(0.95 < s < 1 for _, _, s in index.scan(named.lower().replace(",", " ").replace("\"", " ").encode().split()))
    assert got[0].labels == "bsd" and got[1].labels == "gpl,zlib" and got[2].labels == "mit" and got[2].score == 1


def test_edge_cases(make_docs):
    rows = [(0, None, None, None), (1, "", "s", "en"), (None, "MIT License", "s", None), (3, "mit license " * 50_000, "s", "en"), (4, "a\x00b", "s", "en")]
    got = scan(make_docs(rows))
    assert (got[0].n_words, got[0].first_word, got[0].labels, got[0].score) == (0, None, "", 0.0)
    assert got[None].n_base == 1 and got[3].n_base == 50_000 and got[3].last_word == 99_998 and got[4].n_words == 2
    assert scan(make_docs([])) == {}
    assert len(ls.scan_licenses(make_docs([(7, "x", "s", "en")] * 3)).collect()) == 3
