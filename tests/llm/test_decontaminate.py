import random
import re

import numpy as np
import pytest
from helpers import corpus, empty, words

from quillstream.llm import decontaminate as D


def brute_align(item, passage):
    h = np.zeros((len(item) + 1, len(passage) + 1), int)
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (D.MATCH if a == b else D.MISMATCH), h[i - 1, j] + D.GAP, h[i, j - 1] + D.GAP)
    return int(h.max())


@pytest.mark.parametrize("seed", range(20))
def test_alignment(seed):
    r = np.random.default_rng(seed)
    item, passage = r.integers(0, 5, 12).astype(np.uint64), r.integers(0, 5, 30).astype(np.uint64)
    assert D.align(item, passage)[0] == brute_align(item, passage)


ITEMS = "item_id bigint, text string, `score` int"


def planted(spark):
    r = random.Random(7)
    items = [" ".join(words(r, 25, 3000)) for _ in range(6)]
    rows = [(k, " ".join(words(r, 150, 3000))) for k in range(60)]
    rows += [(100, " ".join(words(r, 40)) + " " + items[0].upper().replace(" ", ", ") + " end")]
    edited = items[1].split()
    for k in (3, 9, 15, 21):
        edited[k] = "changed"
    rows += [(101, "start " + " ".join(edited)), (102, " ".join(items[2].split()[:11] + ["inserted", "words"] + items[2].split()[11:]))]
    rows += [(103, " ".join(items[3].split()[:6])), (104, None), (105, "")]
    rows += [(200 + k, " ".join(words(r, 10)) + " " + items[4]) for k in range(40)]  # very many copies stay findable
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return docs, spark.createDataFrame([(k, t, 0) for k, t in enumerate(items)] + [(50, None, 0), (51, "", 0)], ITEMS)


WANT = {(100, 0), (101, 1), (102, 2), *((200 + k, 4) for k in range(40))}


@pytest.mark.parametrize("block", [1_000_000, 30])
def test_copies_are_found_and_clean_rows_are_not(spark, monkeypatch, block):
    monkeypatch.setattr(D, "ITEM_WORDS", block)
    docs, items = planted(spark)
    got = D.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == WANT
    exact = next(r for r in got if r.doc_id == 100)
    assert exact.likeness == 1.0 and exact.end_word - exact.first_word == 25
    clean = {r.doc_id for r in D.uncontaminated(docs, items).collect()}
    assert clean == {r.doc_id for r in docs.collect()} - {d for d, _ in WANT}


def listed(text):
    return ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", text or "")]


def brute(docs, items):
    """(document, item) of all pairs whose alignment scores enough."""
    names = {}
    code = lambda t: np.array([names.setdefault(w, len(names)) for w in listed(t)], np.uint64)
    out = set()
    for i, item in items:
        own = code(item)
        for d, text in docs:
            if len(own) and D.align(own, code(text))[0] >= D.LIKENESS * D.MATCH * len(own):
                out.add((d, i))
    return out


def found(spark, docs, items):
    got = D.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    return {(r.doc_id, r.item_id) for r in got.collect()}


def test_exact_copies_of_short_and_common_items(spark):
    r = random.Random(3)
    common = "what is the best way to do it and how is that in the end of the day".split()
    items = [(0, "what is the best"), (1, "the end"), (2, "day"), (3, "quetzal"), (4, "it is what it is"), (5, "is that the way to do it"), (6, "the the the the")]
    docs = [(k, " ".join(r.choice(common) for _ in range(60))) for k in range(40)]
    docs += [(100 + k, f"{' '.join(r.choice(common) for _ in range(20))}, {t.upper()}! {' '.join(r.choice(common) for _ in range(20))}") for k, t in items]
    docs += [(200, "it is what it is"), (201, "What is the best?"), (202, "end"), (203, "the")]
    want, got = brute(docs, items), found(spark, docs, items)
    assert got <= want and {(100 + k, k) for k, _ in items} | {(200, 4), (201, 0)} <= got
    for k, t in items:  # verbatim, wherever it stands
        assert {d for d, text in docs if f" {' '.join(listed(t))} " in f" {' '.join(listed(text))} "} <= {d for d, i in got if i == k}


def test_one_document_that_is_the_item(spark):
    assert found(spark, [(1, "one two three four five")], [(7, "One, two, three, four, five.")]) == {(1, 7)}


@pytest.mark.parametrize("length", [6, 12, 25, 60])
def test_recall_of_edited_copies_against_all_pairs(spark, length):
    r = random.Random(length)
    rank = [1 / (k + 3) for k in range(3000)]
    spoken = lambda n: r.choices([f"w{k}" for k in range(3000)], rank, k=n)
    items = [(k, " ".join(spoken(length))) for k in range(25)]
    docs = [(k, " ".join(spoken(120))) for k in range(50)]
    for k, t in items:
        for e in range(6):  # a tenth to a third of the words are replaced, dropped or put in
            w = t.split()
            for _ in range(max(1, round(length * (e + 1) / 18))):
                at = r.randrange(len(w))
                w[at : at + r.choice([0, 1, 1])] = r.choice([[], spoken(1)]) or spoken(1)
            docs.append((1000 + 10 * k + e, " ".join([*spoken(30), *w, *spoken(30)])))
    want, got = brute(docs, items), found(spark, docs, items)
    assert got <= want and len(want) > 100
    assert len(got) >= 0.9 * len(want)


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a", "some words of a test item here"), (None, "nothing of it")], "doc_id string, text string")
    items = spark.createDataFrame([("x-1", "words of a test item"), (None, "some words of a test")], "item_id string, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()}
    assert got == {("a", "x-1"), ("a", None)}


@pytest.mark.parametrize("block", [1_000_000, 3])
def test_any_column_names_and_null_ids(spark, monkeypatch, block):
    monkeypatch.setattr(D, "ITEM_WORDS", block)
    docs = spark.createDataFrame([(None, "the first test item of all", 1, 2, 3), (5, "clean", 4, 5, 6), (6, "and another test item here", 7, 8, 9)], "doc_id bigint, text string, `row` int, gone int, may int")
    items = spark.createDataFrame([(1, "first test item of all"), (2, "another test item here"), (3, "not to be found anywhere")], "item_id int, text string")
    kept = D.uncontaminated(docs, items)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(5, "clean", 4, 5, 6)]


def test_odd_texts_and_empty_tables(spark):
    docs, (_, items) = corpus(spark), planted(spark)
    assert D.contaminated(docs, items).count() == 0
    kept = D.uncontaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    none = spark.createDataFrame([], ITEMS)
    assert D.contaminated(docs, none).count() == 0 and D.contaminated(empty(spark), items).count() == 0
    assert D.uncontaminated(docs, none).count() == docs.count()


def test_repeated_rows_and_items(spark):
    docs, items = planted(spark)
    one = docs.where("doc_id = 100")
    got = D.contaminated(one.unionByName(one), items.where("item_id = 0").unionByName(items.where("item_id = 0").selectExpr("9 AS item_id", "text", "score"))).collect()
    assert sorted(r.item_id for r in got) == [0, 0, 9, 9]
