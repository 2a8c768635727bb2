from __future__ import annotations

import random

from codequarry.llm import substring_dedup as sd


def sentence_list(text):
    raw = text.encode()
    starts, first, h = sd.sentences(raw)
    words = text.split()
    if not words:
        return []
    ends = [*first.tolist()[1:], len(h)]
    return [tuple(w.lower() for w in words[a:b]) for a, b in zip(first.tolist(), ends, strict=True)]


def brute(rows):
    """Sentences that go, by document: runs as tuples of words, owner by smallest id."""
    runs, owner = {}, {}
    for doc, text in rows:
        s = sentence_list(text or "")
        own = []
        for i in range(len(s)):
            j = i + 1
            while j <= len(s) and (j - i < sd.RUN_SENTENCES or sum(map(len, s[i:j])) < sd.RUN_WORDS):
                j += 1
            if j <= len(s):
                run = tuple(w for x in s[i:j] for w in x)
                own.append((i, j, run))
        tails = [i for i in range(len(s) - sd.RUN_SENTENCES + 1) if sum(map(len, s[i:])) >= sd.RUN_WORDS]
        if tails and (tails[-1], len(s)) not in [x[:2] for x in own]:
            own.append((tails[-1], len(s), tuple(w for x in s[tails[-1] :] for w in x)))
        for i, _, run in own:
            owner[run] = min(owner.get(run, (doc, i)), (doc, i))
        runs[doc] = (len(s), own)
    return {d: (n, len({k for i, j, r in own if owner[r] != (d, i) for k in range(i, j)})) for d, (n, own) in runs.items()}


def make_text(rng, n):
    return " ".join(" ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(1, 40))).capitalize() + rng.choice([".", "!", "?", ".\n"]) for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    shared = [make_text(rng, 8) for _ in range(3)]
    rows = []
    for i in range(60):
        parts = [make_text(rng, rng.randrange(1, 10))]
        if i % 4 == 0:
            parts.insert(rng.randrange(2), shared[i % 3])
        if i % 16 == 0:
            parts.append(shared[i % 3])
        rows.append((i, " ".join(parts)))
    return rows, shared


def result(make_docs, rows):
    return {r.doc_id: r for r in sd.dedup_substrings(make_docs([(i, t, "s", "en") for i, t in rows])).collect()}


def test_equals_brute_force(make_docs):
    rows, shared = corpus(3)
    got = result(make_docs, rows)
    assert {i: (r.n_sentences, r.n_removed) for i, r in got.items()} == brute(rows)
    for r in got.values():
        assert len(r.text.split()) == r.n_words_left
    texts = [r.text for r in got.values()]
    for s in shared:
        middle = " ".join(s.split()[40:48])
        assert sum(" ".join(t.split()).count(middle) for t in texts) == 1
    clean = [i for i, _ in rows if i % 4]
    assert all(got[i].text == dict(rows)[i] for i in clean)


def test_later_documents_lose_whole_copies(make_docs):
    rng = random.Random(9)
    text = make_text(rng, 12)
    got = result(make_docs, [(5, text), (2, text), (9, text.upper())])
    assert got[2].n_removed == 0 and got[2].text == text and got[5].n_removed == got[5].n_sentences and got[5].text == "" and got[9].n_words_left == 0


def test_long_sentences_are_cut(make_docs):
    rng = random.Random(10)
    passage = " ".join(f"p{rng.randrange(9999)}" for _ in range(60))
    got = result(make_docs, [(1, f"First one here. {passage}. Tail."), (2, f"Another start of it. {passage}. End.")])
    assert got[1].n_removed == 0 and got[2].n_words_left <= 10


def test_any_stretch_of_50_words_holds_a_run():
    rng = random.Random(11)
    words = lambda n: " ".join(f"w{rng.randrange(99_999)}" for _ in range(n))

    def hashes(text):
        _, first, h = sd.sentences(text.encode())
        return set(sd.runs(first, h)[0].tolist())

    for k in range(600):
        # no stop at all, three sentences of which one is whole, or sentences of any length
        size = [[50], [20, 15, 15], [rng.randrange(1, 30) for _ in range(12)]][k % 3]
        stretch = " ".join(". ".join(words(n) for n in size).split()[:50])
        one, other = (f"{words(rng.randrange(1, 40))} {stretch} {words(rng.randrange(1, 40))}." for _ in range(2))
        assert len(stretch.split()) == 50 and hashes(one) & hashes(other), (k, size)


def test_a_stretch_that_begins_and_ends_in_a_sentence_goes(make_docs):
    rng = random.Random(12)
    words = lambda n: " ".join(f"w{rng.randrange(99_999)}" for _ in range(n))
    stretch = f"{words(20)}. {words(15)}. {words(20)}"
    got = result(make_docs, [(i, f"{words(4)} {stretch} {words(4)}.") for i in (1, 2)])
    assert got[1].n_removed == 0 and got[2].n_words - got[2].n_words_left >= 12


def test_a_shared_phrase_stays(make_docs):
    rng = random.Random(15)
    words = lambda n: " ".join(f"w{rng.randrange(99_999)}" for _ in range(n))
    phrase = f"{words(sd.RUN_WORDS // 2)}. {words(sd.RUN_WORDS - 1 - sd.RUN_WORDS // 2)}."
    rows = [(i, f"{words(30)}. {phrase} {words(30)}.") for i in range(20)]
    got = result(make_docs, rows)
    assert all(got[i].n_removed == 0 and got[i].text == t for i, t in rows)


def test_edge_cases(make_docs):
    rows = [(0, None), (1, ""), (None, "a b. c d."), (3, "x y z. " * 30_000), (4, "short."), (4, "short."), (6, "...\n\n!!")]
    found = sd.dedup_substrings(make_docs([(i, t, "s", "en") for i, t in rows], "")).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == 7 and got[0].text is None and got[1].text == "" and got[None].text == "a b. c d." and got[4].text == "short."
    assert got[3].n_removed == 30_000 - 1  # a later start covers sentences of the first run too
    assert sd.dedup_substrings(make_docs([])).collect() == []


def test_different_texts_of_one_id_are_different_documents(make_docs):
    rng = random.Random(13)
    passage, tails = make_text(rng, 6), [make_text(rng, 3) for _ in range(4)]
    rows = [(1, f"{passage} {tails[0]}"), (1, f"{passage} {tails[1]}"), (2, f"{passage} {tails[2]}"), (None, f"{passage} {tails[3]}"), (None, f"{passage} {tails[3]} x y z.")]
    docs = make_docs([(i, t, "s", "en", 1, "c") for i, t in rows], ", ord int, key string")
    found = sd.dedup_substrings(docs).collect()
    middle = " ".join(passage.split()[20:28])
    kept = [r.doc_id for r in found if middle in " ".join(r.text.split())]
    # a null id stands for a hash, which may be the smallest
    assert len(found) == 5 and len(kept) == 1 and kept[0] in (1, None)
    pair = sd.dedup_substrings(make_docs([(i, t, "s", "en") for i, t in rows[:3]])).collect()
    assert sorted(r.doc_id for r in pair if r.n_removed == 0) == [1] and [r.n_removed > 0 for r in pair if r.doc_id == 2] == [True]


def plain_sentences(text):
    """Byte-free splitter of its own: stops, then the cuts after the word of least hash in every window of a long sentence."""
    import re

    from codequarry.llm.common import word_hashes

    out = []
    for part in re.split(r"(?:(?<=[.!?])|(?<=[.!?][\"')\]]))[ \t\r\x0b\x0c]+|\n\s*", text):
        words = part.split()
        if not words:
            continue
        hashes = [int(word_hashes(w.lower().encode())[0]) for w in words]
        cuts = set()
        if len(words) > sd.PIECE:
            for i in range(len(words) - sd.PIECE + 1):
                window = hashes[i : i + sd.PIECE]
                cuts.add(i + max(k for k in range(sd.PIECE) if window[k] == min(window)) + 1)
        last = 0
        for c in sorted(cuts | {len(words)}):
            if c > last:
                out.append(tuple(w.lower() for w in words[last:c]))
                last = c
    return out


def test_splitter_equals_a_plain_one():
    rng = random.Random(14)
    for _ in range(300):
        words = [f"w{rng.randrange(40)}" + rng.choice(["", "", "", ".", "!", "?", '."']) for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\n"]) for w in words)
        assert sentence_list(text) == plain_sentences(text), repr(text)
