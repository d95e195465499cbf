import random
import re

import pytest
from helpers import corpus, empty, words

from quillstream.llm import sentences as S


def split(text):
    """(match of each word and the white space after it, number of the first word of each sentence)."""
    found = list(re.finditer(r"([^ \t\n\r\x0b\x0c]+)([ \t\n\r\x0b\x0c]*)", text or ""))
    begins = [k for k in range(len(found)) if not k or found[k - 1][1][-1] in ".!?" or "\n" in found[k - 1][2]]
    return found, begins


def brute(rows, size):
    """doc_id -> (sentences, sentences that lost a word, words lost, text left)."""
    parts = {i: split(t) for i, t in sorted(rows)}
    plain = {i: [re.sub("[A-Z]", lambda c: c[0].lower(), m[1]) for m in found] for i, (found, _) in parts.items()}
    first, gone = {}, {i: set() for i in parts}
    for i, (found, begins) in parts.items():
        w, stops = plain[i], [*begins[1:], len(found)]
        for k in range(max(1, len(begins) - size + 1) if begins else 0):
            a, b = begins[k], stops[min(len(begins), k + size) - 1]
            span = tuple(tuple(w[x:y]) for x, y in zip(begins[k : k + size], stops[k : k + size], strict=True))
            if span in first:
                gone[i] |= set(range(a, b))
            first.setdefault(span, (i, a))
        for a in range(len(w) - S.PASSAGE + 1):
            where = first.setdefault(" ".join(w[a : a + S.PASSAGE]), (i, a))
            if where[0] != i or a - where[1] >= S.PASSAGE:
                gone[i] |= set(range(a, a + S.PASSAGE))
    out = {}
    for i, t in rows:
        found, begins = parts[i]
        lost = sum(any(x in gone[i] for x in range(a, b)) for a, b in zip(begins, [*begins[1:], len(found)], strict=False))
        head = (t or "")[: found[0].start()] if found else t or ""
        out[i] = (len(begins), lost, len(gone[i]), head + "".join(m[0] for k, m in enumerate(found) if k not in gone[i]))
    return out


def done(docs):
    return {x.doc_id: (x.n_sentences, x.n_removed, x.n_words_removed, x.text) for x in S.without_repeated_runs(docs).collect()}


def test_against_brute_force(spark):
    r = random.Random(2)
    said = [" ".join(words(r, r.randrange(1, 9))) + r.choice([". ", "! ", "? ", "\n"]) for _ in range(30)]
    rows = [(k, "".join(r.choice(said) if r.random() < 0.7 else " ".join(words(r, 5)) + ". " for _ in range(r.randrange(12)))) for k in range(60)]
    run = "".join(said[:5])
    rows += [(100 + k, " ".join(words(r, 8)) + ". " + run + " ".join(words(r, 3))) for k in range(5)] + [(200, run), (201, run + run)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert done(docs) == brute(rows, S.SENTENCES)


@pytest.mark.parametrize("seed", range(3))
def test_passages_against_brute_force(spark, seed):
    """Copies of stretches of one another, of any length and place, with and without marks, within and across documents."""
    r = random.Random(seed)
    pool = words(r, 900, 5000)
    rows = []
    for k in range(40):
        w = words(r, r.randrange(0, 90), 5000)
        for _ in range(r.randrange(4)):
            a = r.randrange(700)
            at = r.randrange(len(w) + 1)
            w[at:at] = pool[a : a + r.randrange(20, 160)]
        if k % 3 == 0:
            w = [x + "." if r.random() < 0.05 else x for x in w]
        rows.append((k, (" " * (k % 2)) + " ".join(w) + "\n" * (k % 2)))
    rows += [(100, "na " * 300), (101, "la li " * 90), (102, " ".join(pool[:200] + pool[:200])), (103, "na " * 120)]
    assert done(spark.createDataFrame(rows, "doc_id bigint, text string")) == brute(rows, S.SENTENCES)


def test_what_is_left(spark):
    a = "Alpha one two three four. Beta five six seven. Gamma eight nine ten."
    docs = spark.createDataFrame([(1, a), (2, "Before it all. " + a.upper() + " After it all."), (3, "alone here.")], "doc_id bigint, text string")
    got = {x.doc_id: x.text for x in S.without_repeated_runs(docs).collect()}
    assert got == {1: a, 2: "Before it all. After it all.", 3: "alone here."}


def test_corpus_of_odd_texts(spark):
    docs = corpus(spark)
    assert done(docs) == brute([(r.doc_id, r.text) for r in docs.collect()], S.SENTENCES)


def test_equal_rows_are_one_document_and_empty_table(spark):
    t = "One two three four five. Six seven eight nine. Ten eleven twelve."
    docs = spark.createDataFrame([(1, t), (1, t), (None, t)], "doc_id bigint, text string")
    got = sorted(((x.doc_id, x.n_removed) for x in S.without_repeated_runs(docs).collect()), key=str)
    assert got == [(1, 3), (1, 3), (None, 0)]
    assert S.without_repeated_runs(empty(spark)).count() == 0


def test_a_passage_without_marks_is_found(spark):
    r = random.Random(8)
    passage = " ".join(words(r, 60, 5000))
    rows = [(k, " ".join([*words(r, 30 + k, 5000), passage, *words(r, 25, 5000)])) for k in range(4)]
    got = {x.doc_id: (x.n_removed, x.n_words_removed) for x in S.without_repeated_runs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {0: (0, 0), 1: (1, 60), 2: (1, 60), 3: (1, 60)}


def test_a_passage_of_very_short_sentences_is_found(spark):
    r = random.Random(9)
    for end in ("!! ", ".\n"):
        passage = "".join(w + end for w in words(r, 30, 5000))
        docs = spark.createDataFrame([(1, passage), (2, "Before it all. " + passage), (3, passage)], "doc_id bigint, text string")
        got = {x.doc_id: (x.n_removed, x.text) for x in S.without_repeated_runs(docs).collect()}
        assert got == {1: (0, passage), 2: (30, "Before it all. "), 3: (30, "")}


def test_a_passage_of_51_words_is_found_wherever_it_starts(spark):
    r = random.Random(10)
    rows, left = [], {}
    for k in range(0, 400, 4):
        w = words(r, 51, 5000)
        for at in range(r.randrange(15, 25), 51, 20):
            w[at] += "."
        passage = " ".join(w)
        for copy in range(2):
            before, after = (" ".join(words(r, r.randrange(1, 40), 5000)) for _ in range(2))
            rows.append((k + copy, f"{before} {passage.upper() if copy else passage} {after}"))
            left[k + copy] = f"{before} {after}" if copy else rows[-1][1]
    got = {x.doc_id: x.text for x in S.without_repeated_runs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == left


def test_an_overlapping_repeat_leaves_its_first_occurrence(spark):
    docs = spark.createDataFrame([(1, "na " * 500), (2, "la " * 101), (3, "a b " * 20)], "doc_id bigint, text string")
    got = {x.doc_id: x.text for x in S.without_repeated_runs(docs).collect()}
    assert got == {1: "na " * 51, 2: "la " * 101, 3: "a b " * 20}
