import random

import numpy as np
import pytest
from helpers import brute_components, corpus, empty, words

from quillstream.llm import graph, neardup


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, size, percent, seed):
    docs = corpus(spark, seed)
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], size, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, words=size, percent=percent).collect()}
    assert got == want


def test_a_family_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    r = random.Random(3)
    base = words(r, 60, 5000)
    rows = []
    for k in range(60):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(docs, words=3, percent=85).collect()}
    assert got == brute_components(rows, 3, 85)


def test_keys_with_many_classes(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP", 2)
    docs = corpus(spark)
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert got == want


def test_a_family_whose_largest_group_is_small(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 5)
    r = random.Random(6)
    base, rows = words(r, 80, 5000), []
    for k in range(70):  # every text is changed at its own stretch, so that links hold some pairs and not others
        w = list(base)
        at = r.randrange(0, 60, 6)
        w[at : at + 6] = [f"new{at}x{i}" for i in range(6)] if r.random() < 0.8 else [f"own{k}x{i}" for i in range(6)]
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.near_duplicates(docs, words=3, percent=85).collect()}
    assert got == brute_components(rows, 3, 85)


@pytest.mark.parametrize("seed", range(5))
def test_links_of_signatures_within_the_bound(seed):
    r = np.random.default_rng(seed)
    base = r.integers(0, 9, (6, 64)).astype(np.uint16)
    x = base[r.integers(0, 6, 50)]
    x = np.where(r.random(x.shape) < 0.2, r.integers(0, 99, x.shape), x).astype(np.uint16)
    near = (x[:, None] != x[None, :]).sum(axis=2) <= 20
    up = list(range(50))
    for u, v in neardup.near_forest(x, 20):
        assert near[u, v]
        a, b = up[u], up[v]
        up = [a if y == b else y for y in up]
    reach = near.copy()
    for _ in range(6):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    assert all((up[a] == up[b]) == reach[a, b] for a in range(50) for b in range(50))


def test_chunks_cover_the_distance():
    for threshold in (0.8, 0.85, 0.95):
        parts = neardup.chunks(threshold)
        assert neardup.distance_bound(threshold) < len(parts) * (neardup.ERRORS + 1)
        assert sorted(x for p in parts for x in p) == list(range(neardup.SYMBOLS))


def test_shared_and_missing_ids(spark):
    t = " ".join(words(random.Random(1), 30))
    docs = spark.createDataFrame([(7, t), (7, "quite another text of some words"), (9, t), (None, t), (11, "quite another text of some words")], "doc_id bigint, text string")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in neardup.near_duplicates(docs, words=3, percent=85).collect())
    assert got == [(-1, None, True), (7, 7, True), (7, 7, True), (9, 7, False), (11, 7, False)]


def test_kept_documents_carry_all_columns(spark):
    docs = corpus(spark)
    kept = neardup.kept_documents(docs)
    assert kept.columns == docs.columns
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_kept_documents_with_any_names(spark):
    docs = corpus(spark).selectExpr("*", "5 AS gone_id", "6 AS _may", "7 AS may", "8 AS gone", "9 AS component_id", "true AS kept", "1 AS set_a")
    kept = neardup.kept_documents(docs)
    assert kept.columns == docs.columns
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    rows = kept.collect()
    assert {r.doc_id for r in rows} == {i for i, (_, c) in want.items() if i == c}
    assert {(r.gone_id, r._may, r.may, r.gone, r.component_id, r.kept, r.set_a) for r in rows} == {(5, 6, 7, 8, 9, True, 1)}


def test_ids_that_are_no_numbers(spark):
    with pytest.raises(TypeError):
        neardup.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    got = neardup.near_duplicates(spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id int, text string")).collect()
    assert {r.component_id for r in got} == {1}


def test_empty_table(spark):
    assert neardup.near_duplicates(empty(spark)).count() == 0
    assert neardup.kept_documents(empty(spark)).count() == 0


def test_components_of_hubs(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB_LEAST", 3)
    monkeypatch.setattr(graph, "HUB_SHARE", 0.01)
    r = random.Random(2)
    links = [(500, k) for k in range(0, 200)] + [(900, k) for k in range(200, 400)] + [(1000 + k, r.randrange(1000, 1300)) for k in range(200)] + [(399, 950), (950, 17)]
    up = {}
    find = lambda x: x if up.get(x, x) == x else find(up[x])
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    nodes = {x for a, b in links for x in (a, b)}
    got = {x.node: x.label for x in graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in nodes if find(x) != x}


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (50, 50)], "a bigint, b bigint")
    got = {r.node: r.label for r in graph.components(links).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 101: 100}
