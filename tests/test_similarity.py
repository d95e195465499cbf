"""Nearest neighbours: results, and how often a vector is sent."""

import numpy as np
import pytest

from quillstream.plans import similarity


def brute(ids, v, groups=None):
    u = v / (np.sqrt((v * v).sum(1, keepdims=True)) + 1e-6)
    s = np.round(u @ u.T, 6)
    s[ids[:, None] == ids[None, :]] = -2
    if groups is not None:
        s[groups[:, None] == groups[None, :]] = -2
    return {int(i): (int(ids[k]), round(float(row[k]), 6)) for i, row, k in zip(ids, s, s.argmax(1), strict=True) if row[k] > -2}


@pytest.fixture(scope="module")
def vectors(spark):
    v = np.random.default_rng(5).integers(-2, 3, (700, 4)).astype(float)  # many equal ones, and null vectors
    rows = [(i * 3, x.tolist(), i % 7) for i, x in enumerate(v)]
    return v, spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def test_blocks_of_a_table_with_itself(vectors, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 100)
    monkeypatch.setattr(similarity, "STRIP", 9)
    v, table = vectors
    found = {r.vec_id: (r.near_id, round(r.likeness, 6)) for r in similarity.nearest(table, table).collect()}
    assert found == brute(np.arange(700) * 3, v)


def test_blocks_of_queries_and_a_table(vectors, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 60)
    v, table = vectors
    want = brute(np.arange(700) * 3, v, np.arange(700) % 7)
    found = {r.vec_id: (r.near_id, round(r.likeness, 6)) for r in similarity.nearest(table.where("vec_id % 5 = 0"), table, "label").collect()}
    assert found == {k: x for k, x in want.items() if k % 5 == 0}


def test_vectors_are_sent_seldom():
    sent = lambda n: similarity.blocks_of(n, similarity.FEW)
    assert sent(2000) == 1 and sent(120_000) == 16 and sent(720_000) == 44
