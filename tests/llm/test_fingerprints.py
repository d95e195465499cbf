import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import corpus, empty, shingles, texts

from quillstream.llm import fingerprints as P
from quillstream.llm.text import mixed, text_bytes
from quillstream.llm.text import shingles as hashed_shingles


def by_hand(text):
    """The bins of one text, one shingle and one bin at a time."""
    hashes = [int(h) for h in hashed_shingles(*text_bytes(pa.array([text], pa.string())), P.WORDS)[0]]
    scrambled = [int(x) for x in mixed(np.array(hashes, np.uint64))]
    bins = {}
    for h, x in zip(hashes, scrambled, strict=True):
        k = h >> 56
        bins[k] = min(x, bins.get(k, 1 << 64))
    if not bins:
        return None
    rank = mixed(np.arange(1, P.BINS * P.BINS + 1, dtype=np.uint64)).reshape(P.BINS, P.BINS)
    out = []
    for k in range(P.BINS):
        source = k if k in bins else min(bins, key=lambda j: int(rank[k, j]))
        out.append(bins[source] & 255)
    return bytes(out).hex()


def test_fingerprints_against_one_shingle_at_a_time():
    every = [*texts(3), "a b c d e f g", "one two three four five six " * 40]
    bins, some = P.fingerprints(pa.array(every, pa.large_string()))
    assert [b.tobytes().hex() if s else None for b, s in zip(bins, some, strict=True)] == [by_hand(t) for t in every]


def test_likeness_is_corrected_for_chance():
    r = np.random.default_rng(1)
    a = r.integers(0, 256, (400, P.BINS)).astype(np.uint8)
    yes = np.ones(400, bool)
    for share in (0.0, 0.3, 0.8):  # equal bins by right, and by chance among the others
        b = np.where(r.random(a.shape) < share, a, r.integers(0, 256, a.shape)).astype(np.uint8)
        assert abs(P.likeness(a, yes, b, yes).mean() - share) < 0.01


def expected(rows):
    """Rows in order -> id, edited text, next text."""
    rows = sorted(rows, key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.text or ""))
    own = [r.text or "" for r in rows]
    return [(rows[k].doc_id, own[k], own[(k + 1) % len(own)]) for k in range(len(own))]


@pytest.mark.parametrize("runs", [1, 3, 1000])
def test_edited_texts_and_likeness(spark, monkeypatch, runs):
    docs = corpus(spark)
    monkeypatch.setattr(P, "DOCS_IN_RUN", max(1, docs.count() // runs))
    got = {r.doc_id: r for r in P.document_fingerprints(docs).collect()}
    want = expected(docs.collect())
    assert len(got) == len(want)
    for i, own, following in want:
        r = got[i]
        edited = P.edited(own, following)
        assert r.n_chars == len(own)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.near_next == 1.0) or own != following
        a, b = shingles(own, P.WORDS), shingles(edited, P.WORDS)
        true = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r.near_edited - true) < 0.17


def test_likeness_follows_jaccard_on_average(spark):
    docs = corpus(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    gaps = []
    for r, (_, own, following) in zip(sorted(P.document_fingerprints(docs).collect(), key=lambda r: r.doc_id), expected(docs.collect()), strict=True):
        a, b = shingles(own, P.WORDS), shingles(P.edited(own, following), P.WORDS)
        if a | b:
            gaps.append(r.near_edited - len(a & b) / len(a | b))
    assert abs(sum(gaps) / len(gaps)) < 0.02
    assert texts


def test_equal_texts_have_equal_fingerprints(spark):
    docs = corpus(spark)
    by_text = {}
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in P.document_fingerprints(docs).collect():
        assert by_text.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
    assert by_text[None] == by_text[""] == by_text[" "] == ""
    assert len(set(by_text.values())) > 50


def test_repeated_rows_null_ids_and_one_row(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "g h"), (9, None)], "doc_id bigint, text string")
    got = P.document_fingerprints(docs).collect()
    assert len(got) == 4
    one = P.document_fingerprints(docs.where("doc_id = 9")).collect()
    assert one[0].near_next == 1.0 and one[0].edited_fingerprint == ""


def test_empty_table(spark):
    assert P.document_fingerprints(empty(spark)).count() == 0


def test_ids_beyond_doubles_lose_no_row(spark):
    ids = [int.from_bytes(hashlib.sha256(b"%d" % k).digest()[:8], "big", signed=True) for k in range(6000)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id bigint, text string")
    got = {r.doc_id: r.edited_sha256 for r in P.document_fingerprints(docs).collect()}
    assert got == {i: hashlib.sha256(P.edited(own, following).encode()).hexdigest() for i, own, following in expected(docs.collect())}


def test_rows_that_share_an_id_are_cut_into_runs(spark, monkeypatch):
    monkeypatch.setattr(P, "DOCS_IN_RUN", 5)
    r = random.Random(2)
    rows = [(i, " ".join(str(r.random()) for _ in range(9))) for i in [None] * 60 + [7] * 80 + [8, 9]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = P.document_fingerprints(docs).collect()
    assert sorted((x.doc_id or -1 for x in got)) == sorted(i or -1 for i, _ in rows)
    order = docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").orderBy("doc_id", "h").collect()
    want = {P.edited(a.text, b.text) for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    assert {x.edited_sha256 for x in got} == {hashlib.sha256(t.encode()).hexdigest() for t in want}


def test_runs_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(P, "SOME_RUNS", 0)
    monkeypatch.setattr(P, "RUN_BYTES", 2000)
    docs = corpus(spark)
    got = {x.doc_id: x.edited_sha256 for x in P.document_fingerprints(docs).collect()}
    assert got == {i: hashlib.sha256(P.edited(own, following).encode()).hexdigest() for i, own, following in expected(docs.collect())}
