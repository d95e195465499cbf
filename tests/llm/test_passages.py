import random

import pytest
from helpers import brute_repeats, corpus, empty

from quillstream.llm import passages


def check(spark, rows, schema="doc_id bigint, text string"):
    docs = spark.createDataFrame(rows, schema)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in passages.without_repeats(docs).collect()}
    assert got == brute_repeats([r[:2] for r in rows], passages.LENGTH)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    docs = corpus(spark, seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in passages.without_repeats(docs).collect()}
    assert got == brute_repeats([(r.doc_id, r.text) for r in docs.collect()], passages.LENGTH)


@pytest.mark.parametrize("together", [1, 20_000])
@pytest.mark.parametrize("crowd", [20_000, 1])
def test_periods_cuts_and_overlaps(spark, monkeypatch, crowd, together):
    monkeypatch.setattr(passages, "TOGETHER", together)
    monkeypatch.setattr(passages, "ENTRIES_IN_TASK", crowd)
    r = random.Random(4)
    noise = lambda n: "".join(r.choice("abcdefgé ") for _ in range(n))
    p, q = noise(260), noise(230)
    rows = [(1, "a" * 450), (2, "ab" * 300), (3, "abc" * 70 + noise(50)), (4, "é" * 130)]
    rows += [(10 + k, noise(80) + p[k * 7 :] + noise(60)) for k in range(8)]
    rows += [(30 + k, q[: 200 + k] + noise(30) + p[: 199 + k] + noise(r.randrange(300))) for k in range(6)]
    rows += [(50, noise(20) + q + q + noise(20)), (51, None), (52, "")]
    check(spark, rows)


@pytest.mark.parametrize("seed", range(4))
def test_order_of_the_parse_is_that_of_the_bytes(seed):
    r = random.Random(seed)
    pool = [bytes(r.choice(b"ab") for _ in range(r.randrange(40))) for _ in range(30)]
    parts = [b"".join(r.choices(pool, k=r.randrange(5))) for _ in range(300)]
    order = passages.parse_order(parts)
    assert sorted(order) == list(range(300)) and [parts[k] for k in order] == sorted(parts)
    assert [b"".join(x) for x in passages.parsed(parts)] == parts and max(map(len, passages.parsed(parts))) > 2


def test_periodic_text_has_few_records(spark):
    rows = spark.createDataFrame([(1, "a" * 300_000), (2, "ab" * 100_000), (3, "abcdefg" * 30_000)], "row bigint, text string")
    assert passages._parsed(rows).count() < 200
    docs = spark.createDataFrame([(1, "a" * 300_000), (2, "x" * 150 + "ab" * 100_000), (3, "a" * 199)], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in passages.without_repeats(docs).collect()}
    assert got == {1: (300_000, 1), 2: (200_000, 1), 3: (0, 0)}


def test_a_long_text_is_taken_whole(spark):
    """Over the size of a step, with copies far apart."""
    r = random.Random(11)
    text = "".join(r.choices("abcdefghij ", k=3_000_000))
    copy = text[100_000:140_000]
    docs = spark.createDataFrame([(1, text + copy), (2, text[2_999_000:] + "|")], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in passages.without_repeats(docs).collect()}
    assert got == {1: (3_040_000, 81_000, 2), 2: (1001, 1000, 1)}


def test_equal_rows_count_as_repeats(spark):
    docs = spark.createDataFrame([(1, "q" + "xyzw" * 60), (1, "q" + "xyzw" * 60), (None, "short")], "doc_id bigint, text string")
    got = [(r.doc_id, r.n_removed) for r in passages.without_repeats(docs).collect()]
    assert sorted(got, key=str) == [(1, 241), (1, 241), (None, 0)]


def test_empty_table(spark):
    assert passages.without_repeats(empty(spark)).count() == 0
