"""Benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment (operator 10).

Word counts over the whole corpus give each word of the test items its information in bits. The n-grams of ``WORDS`` words of
an item (of two, if it has fewer than ``SHORT``) are its seeds if their words carry ``RARE_BITS`` or more, and the
``LEAST_SEEDS`` rarest in any case; an item of up to three words is one n-gram, so it must stand there whole. Rarity is judged by words and not by how often the n-gram itself occurs, so
that an item copied into very many documents stays findable. Seeds join passages of training text to items: where the seeds
of one item in one passage carry ``JOIN_BITS``, or ``JOIN_SHARE`` of what all seeds of the item carry, the passage is aligned
with the item word by word. An exact copy holds all seeds, so it is always aligned, however common its words are. A document
is contaminated by an item if the alignment scores ``LIKENESS`` or more of what an exact copy would.

The items are taken in blocks of at most ``ITEM_WORDS`` words, so what each task holds of them is bounded; every block
is set against all documents. The words of all blocks are counted in one pass. Texts are shuffled only where documents are
to be left out by several blocks.

Words are runs of letters and digits, ASCII lower-cased. Null, empty and wordless texts contaminate nothing, nor do such
items. Repeated rows give repeated results; every row of the items is an item of its own, so those that share an item_id give
a row each. Ids may be of any type. Empty tables give no rows. Extra columns are ignored, or carried by ``uncontaminated``,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .lookup import Lookup
from .members import bitmap, fresh, held_in, without
from .runtime import cut
from .text import ALNUM, grams, lowered, prefix_sums, slice_hash, steps, text_bytes, words

WORDS, SHORT = 3, 16
RARE_BITS, LEAST_SEEDS = 24.0, 8
JOIN_BITS, JOIN_SHARE = 30.0, 0.25
LIKENESS = 0.5
#: Words of the test items that are held at a time: 8 MB of hashes.
ITEM_WORDS = 1_000_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
MATCH, MISMATCH, GAP = 2, -1, -1


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and n + 1 offsets by text."""
    low = lowered(data)
    starts, ends, by_text = words(low, offsets, ALNUM)
    return (slice_hash(prefix_sums(low), starts, ends) if len(starts) else np.zeros(0, np.uint64)), by_text


@dataclass
class Items:
    ids: list
    words: list[np.ndarray]
    bar: np.ndarray  # bits of seeds that a passage needs, by item
    sizes: list[int]  # of the seeds, in words
    seeds: Lookup
    seed_bits: np.ndarray
    uses: dict[int, list[int]]  # seed -> items


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local score, and the passage word at which it ends."""
    step = -GAP * np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        score = np.maximum(row + GAP, 0)
        score[1:] = np.maximum(score[1:], row[:-1] + np.where(passage == w, MATCH, MISMATCH))
        row = np.maximum.accumulate(score + step) - step
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


def matches(hashed: np.ndarray, by_text: np.ndarray, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, score, first word, last word + 1) of contaminated texts."""
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for size in items.sizes:
        gram, by_gram = grams(hashed, by_text, size)
        where, seed = items.seeds.find(gram)
        text = np.searchsorted(by_gram, where, "right") - 1
        for t, p, s in zip(text.tolist(), (where - by_gram[text]).tolist(), seed.tolist(), strict=True):
            for item in items.uses[s]:
                found.setdefault((t, item), []).append((p, s))
    out = []
    for (t, item), hits in found.items():
        own = items.words[item]
        doc = hashed[by_text[t] : by_text[t + 1]]
        best = None
        hits.sort()
        a = 0
        for b in range(1, len(hits) + 1):
            if b < len(hits) and hits[b][0] - hits[b - 1][0] <= 2 * len(own):
                continue
            if sum(items.seed_bits[s] for s in {s for _, s in hits[a:b]}) >= items.bar[item]:
                # An alignment that scores enough spans twice the item's words at most.
                lo, hi = max(0, hits[a][0] - 2 * len(own)), hits[b - 1][0] + WORDS + 2 * len(own)
                score, end = align(own, doc[lo:hi])
                if score >= LIKENESS * MATCH * len(own) and (best is None or score > best[0]):
                    _, back = align(own[::-1], doc[lo : lo + end][::-1])
                    best = (score, lo + end - back, lo + end)
            a = b
        if best:
            out.append((t, item, *best))
    return out


def word_counts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """word (null: all words together), n: how often the words of the items, and few others, occur in all texts."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in steps(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(plain_words(data, offsets)[0]).view(np.int64))], names=["word"])

    bits = bitmap(items.select("text").mapInArrow(listed, "word bigint"), "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, times, total = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen), pa.array(times)], names=["word", "n"])

        for _, data, offsets in steps(batches):
            word = plain_words(data, offsets)[0].view(np.int64)
            total += len(word)
            more, n = np.unique(word[held_in(bits, word)], return_counts=True)
            both, at = np.unique(np.concatenate([seen, more]), return_inverse=True)
            seen, times = both, np.bincount(at, np.concatenate([times, n]), len(both)).astype(np.int64)
            if len(seen) > COUNTED:
                yield given()
                seen, times = seen[:0], times[:0]
        yield given()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total])], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def prepared(counts: DataFrame, ids: list, texts: list[str]) -> Items:
    """counts: of at least these items' words, over the corpus."""
    hashed, by_item = plain_words(*text_bytes(pa.array(texts, pa.string())))
    vocabulary = np.unique(hashed)
    own = counts.sparkSession.createDataFrame(pa.table({"word": vocabulary.view(np.int64)}))
    found = counts.join(own, "word", "left_semi").toArrow()  # as many rows as the block has words, at most
    total = counts.where("word IS NULL").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    seen = np.zeros(len(vocabulary), np.int64)
    seen[np.searchsorted(vocabulary, found.column("word").to_numpy().view(np.uint64))] = found.column("n").to_numpy()
    bits = np.log2((total + 2) / (seen + 1))
    item_words = [hashed[a:b] for a, b in zip(by_item, by_item[1:], strict=False)]
    chosen: dict[int, tuple[float, set[int]]] = {}
    bar, sizes = np.full(len(ids), np.inf), set()
    for k, w in enumerate(item_words):
        size = len(w) if len(w) <= 3 else 2 if len(w) < SHORT else WORDS
        if not size:
            continue
        sizes.add(size)
        gram = grams(w, np.array([0, len(w)]), size)[0]
        weight = np.convolve(bits[np.searchsorted(vocabulary, w)], np.ones(size), "valid")
        keep = weight >= RARE_BITS
        keep[np.argsort(-weight, kind="stable")[:LEAST_SEEDS]] = True
        of_seed = dict(zip(gram[keep].tolist(), weight[keep].tolist(), strict=True))
        bar[k] = min(JOIN_BITS, JOIN_SHARE * sum(of_seed.values()))
        for g, x in of_seed.items():
            chosen.setdefault(g, (x, set()))[1].add(k)
    seeds = Lookup(np.array(list(chosen), np.uint64))
    by_seed = [chosen[int(s)] for s in seeds.values]
    return Items(ids, item_words, bar, sorted(sizes), seeds, np.array([b for b, _ in by_seed]), {k: sorted(u) for k, (_, u) in enumerate(by_seed)})


def _blocks(docs: DataFrame, items: DataFrame) -> Iterator[Items]:
    """The items read once, in blocks; a block's prepared form goes to every task."""
    known = items.where("text IS NOT NULL").select("item_id", "text")
    counts = cut(word_counts(docs, known))
    ids, texts, size = [], [], 0
    for r in known.toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += r[1].count(" ") + 1
        if size >= ITEM_WORDS:
            yield prepared(counts, ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield prepared(counts, ids, texts)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, likeness, first_word, end_word: the best passage of each contaminated document for each item."""
    spark = docs.sparkSession
    kinds = [docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()]
    item_type = to_arrow_type(items.schema["item_id"].dataType)
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score bigint, likeness double, first_word bigint, end_word bigint"
    out = None
    for block in _blocks(docs, items):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own = held.value
            for rows, data, offsets in steps(batches):
                found = matches(*plain_words(data, offsets), own)
                t, item, score, first, end = zip(*found, strict=True) if found else ((),) * 5
                whole = np.array([MATCH * len(own.words[i]) for i in item], np.float64)
                columns = [rows.column("doc_id").take(pa.array(t, pa.int64())), pa.array([own.ids[i] for i in item], item_type), pa.array(score, pa.int64()), pa.array(np.array(score) / whole if score else [], pa.float64()), pa.array(first, pa.int64()), pa.array(end, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "score", "likeness", "first_word", "end_word"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that no item contaminates.

    With one block of items this is decided where the rows are read. With several, each block names the contaminated texts by
    a 64-bit hash, and rows are left out by these: no task holds more than one block.
    """
    spark, gone = docs.sparkSession, []
    blocks = list(map(spark.sparkContext.broadcast, _blocks(docs, items)))
    if not blocks:
        return docs

    def filtered(batches: Iterator[pa.RecordBatch], held, clean: bool) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches):
            hit = np.zeros(rows.num_rows, bool)
            hit[[m[0] for m in matches(*plain_words(data, offsets), held.value)]] = True
            yield rows.filter(pa.array(~hit if clean else hit))

    if len(blocks) == 1:
        return docs.mapInArrow(lambda batches: filtered(batches, blocks[0], True), docs.schema)
    row = fresh("row", docs)
    hashed = docs.select(F.xxhash64("text").alias(row), "text")
    for held in blocks:
        gone.append(hashed.mapInArrow(lambda batches, held=held: filtered(batches, held, False), hashed.schema).select(row).distinct())
    out = gone[0]
    for part in gone[1:]:
        out = out.unionByName(part)
    return without(docs.withColumn(row, F.xxhash64("text")), cut(out.distinct()), row).drop(row)
