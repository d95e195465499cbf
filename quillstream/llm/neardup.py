"""Near-duplicate documents by a multi-index Hamming join over MinHash signatures (operator 7).

Each text becomes its set of word shingles; texts with equal sets are one class. A class has a signature of ``SYMBOLS``
b-bit MinHash symbols. Signatures that differ in at most r symbols are found by pigeonhole: the symbols are cut into
r // 2 + 1 chunks, so some chunk has at most one error, and a key is made for each chunk with each of its symbols left
out. Every pair within distance r therefore meets under some key. r is set five standard deviations above the expected
distance at the threshold, so links lost by chance are below one in a million.

Each key links its members to the least of them only, never pair by pair. Components of these candidate links hold all
pairs to be compared; within each, the full shingle sets are intersected by matrix products, in blocks of at most
``BLOCK`` classes, and only a spanning forest of the confirmed links leaves a task.

A null or empty text, or one without words, has no shingles and is linked with nothing. With fewer words than the
shingle size, the whole word sequence is the only shingle. Rows that share a doc_id are linked with one another; a row
without doc_id is not compared, has no component and is kept. Ids are whole numbers; with any other type a TypeError is raised.
An empty table gives no rows. Extra columns are ignored, or carried by ``kept_documents``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .graph import components
from .members import bitmap, held_in, may_be_in, without
from .runtime import cut
from .text import mixed, shingles, steps

SYMBOLS = 64
ERRORS = 1
#: Classes under one key that a task compares by signature.
GROUP = 4096
BLOCK = 1024
_COLUMNS = 4096


def distance_bound(threshold: float, symbols: int = SYMBOLS) -> int:
    return math.ceil(symbols * (1 - threshold) + 5 * math.sqrt(symbols * threshold * (1 - threshold)))


def chunks(threshold: float, symbols: int = SYMBOLS, errors: int = ERRORS) -> list[np.ndarray]:
    """The least number of chunks of which one has at most ``errors`` errors whenever the distance is within the bound."""
    return np.array_split(np.arange(symbols), distance_bound(threshold, symbols) // (errors + 1) + 1)


_factors = mixed(np.arange(1, 3 * SYMBOLS + 1, dtype=np.uint64)).astype(np.uint32).reshape(SYMBOLS, 3)


def sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, by_text = shingles(data, offsets, size)
    out = []
    for a, b in zip(by_text.tolist(), by_text[1:].tolist(), strict=False):
        x = np.sort(hashes[a:b])
        out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if b > a else x)
    return out


def signatures(found: list[np.ndarray]) -> np.ndarray:
    """(texts, SYMBOLS) low 16 bits of the minima, for non-empty sets."""
    flat = np.concatenate(found)
    at = np.cumsum([0, *map(len, found[:-1])])
    lo, hi = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(found), SYMBOLS), np.uint16)
    for k, (a, b, c) in enumerate(_factors):
        out[:, k] = np.minimum.reduceat(lo * (a | np.uint32(1)) + hi * (b | np.uint32(1)) + c, at)
    return out


def _set_hash(x: np.ndarray) -> tuple[int, int]:
    y = mixed(x ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return (int(np.sum(x).astype(np.int64)), int(np.sum(y).astype(np.int64))) if len(x) else (0, 0)


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches):
            found = sets(data, offsets, size)
            some = [x for x in found if len(x)]
            made = iter(signatures(some) if some else ())
            a, b = zip(*map(_set_hash, found), strict=True)
            signed = [next(made).tobytes() if len(x) else b"" for x in found]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(x) for x in found], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(signed, pa.binary())], names=["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, signature binary")


def chunk_keys(signature: np.ndarray, parts: list[np.ndarray], errors: int = ERRORS) -> np.ndarray:
    """(texts, keys): for each chunk and each choice of ``errors`` of its symbols, a hash of the others."""
    place = np.arange(signature.shape[1], dtype=np.uint64) << np.uint64(16)
    symbol = mixed(mixed(signature.astype(np.uint64) + place[None, :]))
    keys = []
    for k, part in enumerate(parts):
        whole = symbol[:, part].sum(axis=1, dtype=np.uint64)
        for left_out in combinations(range(len(part)), errors):
            rest = whole - symbol[:, part[list(left_out)]].sum(axis=1, dtype=np.uint64)
            keys.append(mixed(rest ^ np.uint64((k << 8) + sum(left_out) + 1)))
    return np.stack(keys, axis=1)


def near_forest(signature: np.ndarray, bound: int) -> list[tuple[int, int]]:
    """Spanning links among signatures that differ in at most ``bound`` symbols: each is compared with those that no link has reached yet."""
    out, todo = [], np.arange(len(signature))
    while len(todo) > 1:
        stack, todo = [int(todo[0])], todo[1:]
        while stack and len(todo):
            u = stack.pop()
            near = (signature[todo] != signature[u]).sum(axis=1) <= bound
            out += [(u, v) for v in todo[near].tolist()]
            stack += todo[near].tolist()
            todo = todo[~near]
    return out


def candidate_links(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links whose components hold every pair of signatures within the distance bound."""
    parts, bound = chunks(threshold), distance_bound(threshold)
    kind = classes.schema["rep"].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch], bits=None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signature = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            keys = chunk_keys(signature, parts)
            row = np.repeat(np.arange(len(keys)), keys.shape[1])
            key = keys.reshape(-1).view(np.int64)
            if bits is not None:
                use = held_in(bits, key)
                row, key = row[use], key[use]
            columns = [pa.array(key), batch.column("rep").take(pa.array(row))]
            if bits is not None:
                columns.append(batch.column("signature").take(pa.array(row)))
            yield pa.RecordBatch.from_arrays(columns, names=["key", "rep", "signature"][: len(columns)])

    signed = classes.select("rep", "signature")
    met = signed.mapInArrow(keyed, f"key bigint, rep {kind}").groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("n"))
    met = cut(met.where("n > 1").select("key", "a", (F.col("n") > GROUP).alias("crowded")))
    bits = bitmap(met, "key")
    again = signed.mapInArrow(lambda batches: keyed(batches, bits), f"key bigint, rep {kind}, signature binary").join(met, "key")
    crowded = again.where("crowded").select("a", F.col("rep").alias("b")).where("a <> b")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reps, signatures, found = None, [], [], ([], [])

        def done() -> None:
            for u, v in near_forest(np.frombuffer(b"".join(signatures), np.uint16).reshape(-1, SYMBOLS), bound) if len(reps) > 1 else ():
                found[0].append(reps[u])
                found[1].append(reps[v])

        for batch in batches:
            for key, rep, signature in zip(*(batch.column(c).to_pylist() for c in ("key", "rep", "signature")), strict=True):
                if key != now:
                    done()
                    now, reps, signatures = key, [], []
                reps.append(rep)
                signatures.append(signature)
            given, found = found, ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, batch.schema.field("rep").type) for x in given], names=["a", "b"])
        done()
        if found[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, batch.schema.field("rep").type) for x in found], names=["a", "b"])

    workers = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = again.where("NOT crowded").select("key", "rep", "signature").repartition(workers, "key").sortWithinPartitions("key", "rep")
    return grouped.mapInArrow(linked, f"a {kind}, b {kind}").unionByName(crowded).distinct()


def alike(found: list[np.ndarray], percent: int) -> np.ndarray:
    """(n, n): which sets have 100 * intersection >= percent * union; none with itself."""
    n = len(found)
    size = np.array([len(x) for x in found], np.int64)
    flat = np.concatenate(found)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    shared = (np.bincount(column) > 1)[column]
    column, owner = column[shared], owner[shared]
    column = np.cumsum(np.concatenate([[False], column[1:] != column[:-1]])) if len(column) else column
    both = np.zeros((n, n), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        lo, hi = np.searchsorted(column, (a, a + _COLUMNS))
        x = np.zeros((n, min(_COLUMNS, int(column[-1]) + 1 - a)), np.float32)
        x[owner[lo:hi], column[lo:hi] - a] = 1
        both += x @ x.T
    out = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(out, False)
    return out


def forest(linked: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(spanning links, the root of each node) of a symmetric matrix of links."""
    out, root = [], np.full(len(linked), -1)
    for start in range(len(linked)):
        if root[start] >= 0:
            continue
        root[start] = start
        stack = [start]
        while stack:
            u = stack.pop()
            for v in np.flatnonzero(linked[u] & (root < 0)).tolist():
                root[v] = start
                out.append((u, v))
                stack.append(v)
    return out, root


_TASK = "node bigint, label bigint, i int, j int, many boolean, second boolean, shingles binary"


def _true_links(tasks: DataFrame, percent: int) -> DataFrame:
    """(a, b): spanning links of the sets of each (label, i, j); where i and j differ, only of the first side with the second.

    Where they are equal and ``many`` is set, the second side holds the label's first block (in the first block's own task, the
    first side does): then also (a, null) for every node of the first side that is not linked to the largest group of the first
    block. That group is the same in every task, so the nodes not named so are all of one component.
    """
    parts = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f.split()[0] for f in _TASK.split(", ")]
    dealt = tasks.select(*names).repartition(parts, "label", "i", "j").sortWithinPartitions("label", "i", "j", "second", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, links = None, [], ([], [])

        def done() -> None:
            left = sum(not h[1] for h in held)
            cross = now[1] != now[2]
            if len(held) < 2 or cross and not 0 < left < len(held):
                return
            linked = alike([h[2] for h in held], percent)
            if cross:
                linked[:left, :left] = False
                linked[left:, left:] = False
            pairs, root = forest(linked)
            for u, v in pairs:
                links[0].append(held[u][0])
                links[1].append(held[v][0])
            if now[3]:
                lead = slice(left, None) if left < len(held) else slice(None)
                _, apart = forest(linked[lead, lead])
                most = int(np.argmax(np.bincount(apart))) + (lead.start or 0)
                for k in np.flatnonzero(root[:left] != root[most]).tolist():
                    links[0].append(held[k][0])
                    links[1].append(None)

        for batch in batches:
            for node, label, i, j, many, second, raw in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (label, i, j, many) != now:
                    if now:
                        done()
                    now, held = (label, i, j, many), []
                held.append((node, second, np.frombuffer(raw, np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], names=["a", "b"])
            links = ([], [])
        if now:
            done()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], names=["a", "b"])

    return dealt.mapInArrow(compare, "a bigint, b bigint")


def _blocks(rows: DataFrame, n: str, as_: str, block: str) -> DataFrame:
    """With the number of blocks that ``n`` nodes of a label make, and the node's block, by a hash."""
    return rows.withColumn(as_, F.ceil(F.col(n) / BLOCK).cast("int")).withColumn(block, F.pmod(F.xxhash64("node"), F.col(as_)).cast("int"))


def _confirmed(docs: DataFrame, near: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): links whose components are those of the true links. near: (node, label) of candidate components."""
    every = near.unionByName(near.select(F.col("label").alias("node"), "label").distinct())
    many = near.groupBy("label").agg((F.count("*") + 1).alias("n"))
    nodes = cut(_blocks(every.join(many, "label"), "n", "blocks", "block").select("node", "label", "blocks", "block"))
    texts = docs.select("doc_id", "text").where(may_be_in(bitmap(nodes, "node"), F.col("doc_id")))
    held = texts.join(nodes, F.col("doc_id") == F.col("node")).select("node", "label", "blocks", "block", "text")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches):
            found = sets(data, offsets, size)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("node", "label", "blocks", "block")), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "label", "blocks", "block", "shingles"])

    hashed = held.mapInArrow(to_sets, "node bigint, label bigint, blocks int, block int, shingles binary").where(F.length("shingles") > 0)
    # Every block within itself, and with the first: the first block is a guest in every other block's task.
    tasks = F.when((F.col("block") == 0) & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    own = hashed.withColumn("i", F.explode(tasks)).withColumn("j", F.col("i")).withColumn("many", F.col("blocks") > 1).withColumn("second", F.col("block") != F.col("i"))
    first = cut(_true_links(own, percent))
    outside = first.where("b IS NULL").select(F.col("a").alias("node")).distinct().join(nodes.select("node", "label"), "node")
    outside = cut(_blocks(outside.join(outside.groupBy("label").agg(F.count("*").alias("m")), "label"), "m", "rows", "row_block").select("node", "label", "rows", "row_block"))
    # Then those outside the largest group with all of their label. Only labels of several blocks have any, so few texts are hashed again.
    rest = hashed.where("blocks > 1").join(outside.select("label", "rows").distinct(), "label").join(outside.select("node", "row_block"), "node", "left")
    across = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda k: F.struct(k.alias("i"), (-1 - F.col("block")).alias("j"), F.lit(True).alias("second")))
    down = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.col("row_block").alias("i"), (-1 - k).alias("j"), F.lit(False).alias("second")))
    both = F.when(F.col("row_block").isNull(), across).otherwise(F.concat(across, down))
    crossed = rest.select("node", "label", "shingles", F.inline(both)).withColumn("many", F.lit(False))
    return first.where("b IS NOT NULL").unionByName(_true_links(crossed, percent))


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document, linked where 100 * intersection >= percent * union."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be a whole number: components are named by the least of them")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = _signed(docs, words)
    rows = cut(signed)
    classes = cut(rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("signature").alias("signature")))
    near = components(candidate_links(classes, percent / 100))
    linked = components(_confirmed(docs, near, words, percent).unionByName(_same_id(rows, classes)))
    by_rep = classes.select("set_a", "set_b", "n_shingles", "rep").join(linked, F.col("rep") == F.col("node"), "left").select("set_a", "set_b", "n_shingles", F.coalesce("label", "rep").alias("class_component"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    return (
        rows.select("doc_id", "n_shingles", "set_a", "set_b")
        .join(by_rep, ["set_a", "set_b", "n_shingles"], "left")
        .select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
    )


def kept_documents(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, less the documents of each group but the one of least id.

    Only ids that go are joined; where several rows share an id they stay or go together.
    """
    gone = cut(near_duplicates(docs, words=words, percent=percent).where("NOT kept").select("doc_id").distinct())
    return without(docs, gone, "doc_id")


def _same_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a doc_id."""
    twice = rows.where("n_shingles > 0").groupBy("doc_id").agg(F.min(F.struct("set_a", "set_b")).alias("x"), F.max(F.struct("set_a", "set_b")).alias("y")).where("x <> y").select("doc_id")
    held = rows.join(twice, "doc_id").join(classes.select("set_a", "set_b", "n_shingles", "rep"), ["set_a", "set_b", "n_shingles"])
    return held.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
