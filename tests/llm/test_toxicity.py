import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import corpus, empty, words

from quillstream.llm import toxicity as T
from quillstream.llm.text import text_bytes

LABELS = "doc_id bigint, quality int, toxic int"


def made(spark, n=900, seed=1):
    r = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        w, bad = words(r, r.randrange(20, 80)), r.random() < 0.2
        if bad:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["vileness", "vilest", "hatespew", "grotty"])
        rows.append((k, " ".join(w), "en", "s", 0))
        if r.random() < 0.6:
            labels.append((k, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), spark.createDataFrame(labels, LABELS), labels


def test_held_out_accuracy(spark):
    docs, labels, truth = made(spark)
    got = {r.doc_id: r for r in T.scored(docs, labels).collect()}
    assert len(got) == 900
    held = [(got[i], y) for i, _, y in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(r.held_out for r, _ in held) and len(held) > 100
    assert sum(r.predicted == y for r, y in held) / len(held) > 0.97
    for i, r in got.items():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_held_out_labels_are_not_read(spark):
    docs, labels, truth = made(spark)
    flipped = spark.createDataFrame([(i, q, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, q, y in truth], LABELS)
    a = {r.doc_id: r.score for r in T.scored(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in T.scored(docs, flipped).collect()}


def test_risk_on_negatives_stays_non_negative():
    r = np.random.default_rng(1)
    rows = lambda m: T.Rows(np.flatnonzero(m.ravel()) % m.shape[1], np.concatenate([[0], np.cumsum(m.sum(1))]))
    p = np.c_[r.random((50, 1)) < 0.95, r.random((50, 40)) < 0.3]
    u = np.r_[np.c_[r.random((100, 1)) < 0.95, r.random((100, 40)) < 0.3], np.c_[r.random((400, 1)) < 0.02, r.random((400, 40)) < 0.3]]
    w, b = T.nonnegative_pu(rows(p), rows(u), 0.2, 41)
    z = rows(u).dot(w) + b
    assert w.min() >= 0 and z[:100].mean() > z[100:].mean() + 1
    assert w[0] > w[1:].max()


@pytest.mark.parametrize("prior,below", [(0.1, False), (0.9, True)])
def test_gradient_against_finite_differences(prior, below):
    r = np.random.default_rng(3)
    rows = lambda m: T.Rows(np.flatnonzero(m.ravel()) % m.shape[1], np.concatenate([[0], np.cumsum(m.sum(1))]))
    p, u = rows(r.random((30, 7)) < 0.6), rows(r.random((80, 7)) < 0.3)
    w = np.append(np.abs(r.normal(size=7)), -0.5)
    _, g, under = T.risk(w, p, u, prior)
    assert under == below

    def value(x):  # what the gradient is of
        sp, su = T._sigmoid(p.dot(x[:-1]) + x[-1]), T._sigmoid(u.dot(x[:-1]) + x[-1])
        negative = su.mean() - prior * sp.mean()
        return -negative if below else prior * (1 - sp).mean() + negative

    numeric = [(value(w + 1e-6 * e) - value(w - 1e-6 * e)) / 2e-6 for e in np.eye(8)]
    assert np.allclose(g, numeric, atol=1e-8)


def test_odd_texts_and_no_labels(spark):
    docs = corpus(spark)
    for labels in (spark.createDataFrame([], LABELS), spark.createDataFrame([(0, 1, 0), (1, 1, None), (None, 1, 1), (99999, 0, 1)], LABELS)):
        got = T.scored(docs, labels).collect()
        assert len(got) == docs.count() and {r.predicted for r in got} == {0}
    assert T.scored(empty(spark), spark.createDataFrame([], LABELS)).count() == 0


def test_texts_without_features_score_lowest(spark):
    docs, labels, _ = made(spark)
    more = docs.unionByName(spark.createDataFrame([(5000, None, "", "", 0), (5001, "", "", "", 0), (5002, "!!", "", "", 0)], docs.schema))
    got = {r.doc_id: r.score for r in T.scored(more, labels).collect()}
    assert got[5000] == got[5001] == got[5002] == min(got.values())


def test_accepted_keeps_columns_and_clean_rows(spark):
    docs, labels, _ = made(spark)
    wide = docs.selectExpr("*", "1 AS score", "2 AS predicted")
    kept = T.accepted(wide, labels)
    assert kept.columns == wide.columns
    want = {r.doc_id for r in T.scored(docs, labels).collect() if not r.predicted}
    assert {r.doc_id for r in kept.collect()} == want


@pytest.mark.parametrize("text", ["", "one", "Vile VILE vileness", "é" * 9])
def test_features_are_distinct(text):
    owner, slot = T.features(*text_bytes(pa.array([text, text])))
    assert len(set(slot[owner == 0])) == (owner == 0).sum()
    assert sorted(slot[owner == 0]) == sorted(slot[owner == 1])


def test_samples_are_not_lowered_for_memory():
    assert T.UNLABELLED >= 5_000 and T.CALIBRATION >= 5_000
