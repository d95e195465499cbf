import collections

import pytest
from helpers import corpus, empty

from quillstream.llm import sharding as S


def brute(shards, size):
    """Shards take turns; each claims the first free slot in its order."""
    free, owner = set(range(size)), {}
    orders = []
    for s in shards:
        place, stride = S._number(f"offset:{s}") % size, S._number(f"stride:{s}") % (size - 1) + 1
        orders.append([(place + k * stride) % size for k in range(size)])
    while free:
        for k, order in enumerate(orders):
            if free:
                slot = next(x for x in order if x in free)
                free.remove(slot)
                owner[slot] = k
    return [owner[k] for k in range(size)]


@pytest.mark.parametrize("n,size", [(1, 7), (3, 101), (7, 251), (13, 13)])
def test_table_by_turns(n, size):
    shards = [f"s{k}" for k in range(n)]
    table = S.lookup_table(shards, size).tolist()
    assert table == brute(shards, size)
    loads = collections.Counter(table)
    assert max(loads.values()) - min(loads.values()) <= 1


def test_few_keys_move_when_a_shard_goes():
    shards = [f"s{k}" for k in range(20)]
    a, b = S.lookup_table(shards), S.lookup_table(shards[:-1])
    stayed = a != 19
    assert (a[stayed] != b[stayed]).mean() < 0.05


@pytest.mark.parametrize("shards,size", [([], 7), (["a"] * 8, 7), (["a"], 9)])
def test_bad_parameters(shards, size):
    with pytest.raises(ValueError):
        S.lookup_table(shards, size)


def test_placement(spark):
    docs = corpus(spark)
    docs = docs.unionByName(docs.limit(5)).unionByName(docs.limit(1).selectExpr("CAST(NULL AS bigint) AS doc_id", *docs.columns[1:]))
    shards = [f"s{k}" for k in range(5)]
    rows = S.placed(docs, shards).collect()
    assert len(rows) == docs.count()
    table = S.lookup_table(shards)
    by_id = collections.defaultdict(set)
    for r in rows:
        assert r.shard == shards[table[r.slot]] and r.shard_no == table[r.slot]
        by_id[r.doc_id].add(r.slot)
    assert {len(s) for s in by_id.values()} == {1}
    assert S.placed(empty(spark), shards).count() == 0
    assert S.loads(S.placed(docs, shards)).count() <= 5


def test_a_key_with_a_name_of_the_result(spark):
    shards = ["a", "b", "c"]
    for name in ("slot", "shard", "shard_no", "Slot"):
        df = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], f"`{name}` string, n int")
        want = {r.n: (r.slot, r.shard_no, r.shard) for r in S.placed(df.withColumnRenamed(name, "id"), shards, key_col="id").collect()}
        assert {r.n: (r.slot, r.shard_no, r.shard) for r in S.placed(df, shards, key_col=name).collect()} == want
