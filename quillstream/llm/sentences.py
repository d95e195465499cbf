"""Removal of repeated runs of sentences and of repeated passages (operator 9).

Every run of ``SENTENCES`` consecutive sentences is hashed (lower-cased words, white space ignored) and the runs are
joined over the whole corpus. The first occurrence of a run is the one in the least document (by id, then text) and
there the earliest; sentences that any other occurrence covers are removed. A sentence ends after a word that ends in ``.``,
``!`` or ``?``, and at a line's end, however long or short it is. A document with fewer sentences has its whole sequence as
one run.

A passage that starts or ends in mid-sentence, or has no such marks, may hold no whole run. So every run of ``PASSAGE`` words
is compared too, and the words that a later occurrence covers are removed, wherever sentences begin; in one document,
occurrences that overlap the first stay. The runs that share an anchor, the ``ANCHOR``-word run of least hash in them, lie
side by side and make one stretch; equal runs have their anchors at equal places, so only stretches of equal anchors can share
runs. A stretch is one key like a run of sentences: all its runs recur wherever it does. Only where an anchor has stretches
that differ are runs compared one by one, and then those of the first occurrence of each stretch, however many there are.

Keys are counted by hash, which each task pre-aggregates; only what occurs again is joined back, in joins that adaptive
execution can split, so a passage held by a third of all rows costs one narrow row for each of its stretches.

``n_removed`` counts the sentences that lost a word, ``n_words_removed`` the words. Null and empty texts have no sentences.
Rows equal in doc_id and text count as one document; null ids come first. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .members import bitmap, held_in, only, rows_in
from .runtime import cut
from .text import grams, lowered, mixed, prefix_sums, slice_hash, steps, words

SENTENCES = 3
#: Words of a passage that is found wherever it starts, and of the runs that name it.
PASSAGE, ANCHOR = 51, 25

_HIGH = np.uint64(0xFFFFFFFF00000000)
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True


class Words:
    """The words of texts end to end, lower-cased: places, hashes, and where sentences begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = lowered(data)
        self.starts, ends, self.by_text = words(low, offsets)
        n = len(self.starts)
        self.hashed = slice_hash(prefix_sums(low), self.starts, ends) if n else np.zeros(0, np.uint64)
        self.order = prefix_sums(self.hashed)  # the hash of a run of words is that of their hashes in order
        begins = np.ones(n, bool)
        if n:
            lines = np.concatenate([[0], np.cumsum(low == 10)])
            begins[1:] = _ENDS[low[ends[:-1] - 1]] | (lines[self.starts[1:]] > lines[ends[:-1]])
            begins[self.by_text[:-1][np.diff(self.by_text) > 0]] = True
        self.first = np.flatnonzero(begins)  # first word of each sentence
        self.sentences = np.searchsorted(self.first, self.by_text)  # n + 1 offsets by text

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return slice_hash(self.order, start, end)


def sentence_runs(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first word, words, hash) of each run of ``size`` sentences."""
    stop = np.append(w.first[1:], len(w.starts))[: len(w.first)]
    hashed, by_run = grams(w.run(w.first, stop), w.sentences, size)
    many = np.diff(by_run)
    text = np.repeat(np.arange(len(many)), many)
    at = w.sentences[text] + np.arange(len(hashed)) - by_run[text]
    last = np.minimum(at + size, w.sentences[text + 1]) - 1
    return text, w.first[at], stop[last] - w.first[at], hashed


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """Least of every ``size`` neighbours."""
    have = 1
    while have < size:
        step = min(have, size - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def stretches(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first word, words, hash of the anchor) of the runs of PASSAGE words that have one anchor, taken together."""
    many = np.maximum(np.diff(w.by_text) - PASSAGE + 1, 0)
    if not many.sum():
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    at = np.arange(len(w.starts) - ANCHOR + 1)
    hashed = w.run(at, at + ANCHOR)
    least = _least(hashed & _HIGH | at.astype(np.uint64), PASSAGE - ANCHOR + 1)
    text = np.repeat(np.arange(len(many)), many)
    start = w.by_text[text] + np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    anchor = (least[start] & ~_HIGH).astype(np.int64)
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(text)))
    return text[first], start[first], runs + PASSAGE - 1, hashed[anchor[first]]


#: Tells the keys of sentences from those of anchors.
_APART = np.uint64(0x5851F42D4C957F2D)


def _keyed(rows: DataFrame, size: int, bits=None) -> DataFrame:
    """key, part: of each run of sentences (part 0) and of each stretch (its anchor, and the hash of all of it).

    bits: only keys in this bitmap, with doc_id, row, at (first word in the text), n (words) and sure: whether the same stands
    earlier in the text, so that it is a later occurrence wherever the first one is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in steps(batches):
            w = Words(data, offsets)
            text, at, n, hashed = sentence_runs(w, size)
            text_s, at_s, n_s, anchor = stretches(w)
            key = np.concatenate([mixed(hashed ^ _APART), mixed(anchor)]).view(np.int64)
            part = np.concatenate([np.zeros(len(text), np.uint64), w.run(at_s, at_s + n_s) | np.uint64(1)]).view(np.int64)
            if bits is None:
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part)], names=["key", "part"])
                continue
            text, at, n = (np.concatenate(x) for x in ((text, text_s), (at, at_s), (n, n_s)))
            use = np.flatnonzero(held_in(bits, key))
            use = use[np.lexsort((at[use], part[use], key[use], text[use]))]
            text, at, n, key, part = text[use], at[use] - w.by_text[text[use]], n[use], key[use], part[use]
            new = np.ones(len(use), bool)
            new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(use)), 0)) if len(use) else use
            sure = ~new & ((part == 0) | (at - at[lead] >= PASSAGE))
            own = lambda c: batch.column(c).take(pa.array(text))  # noqa: E731, B023
            columns = [pa.array(key), pa.array(part), own("doc_id"), own("row"), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(sure)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "part", "doc_id", "row", "at", "n", "sure"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, "key bigint, part bigint" + (f", doc_id {kind}, row bigint, at int, n int, sure boolean" if bits is not None else ""))


def _single_runs(rows: DataFrame) -> DataFrame:
    """key, doc_id, row, at, n: the runs of PASSAGE words of the stretches listed in ``spans`` (at, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in steps(batches):
            w = Words(data, offsets)
            spans = batch.column("spans")
            flat = spans.flatten()
            begin, n = flat.field("at").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
            text = np.repeat(np.arange(batch.num_rows), spans.value_lengths().to_numpy())
            many = n - PASSAGE + 1
            own = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            text, at = np.repeat(text, many), np.repeat(begin, many) + own
            start = w.by_text[text] + at
            take = lambda c: batch.column(c).take(pa.array(text))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(w.run(start, start + PASSAGE).view(np.int64)), take("doc_id"), take("row"), pa.array(at.astype(np.int32)), pa.array(np.full(len(at), PASSAGE, np.int32))], names=["key", "doc_id", "row", "at", "n"])

    return rows.mapInArrow(run, f"key bigint, doc_id {rows.schema['doc_id'].dataType.simpleString()}, row bigint, at int, n int")


_ORDER = ("doc_id", "row", "at")


def _apart() -> Column:
    """Whether an occurrence does not overlap the first one."""
    return (F.col("row") != F.col("first.row")) | (F.col("at") - F.col("first.at") >= PASSAGE)


def _later(singles: DataFrame) -> DataFrame:
    """row, at, n: all occurrences of a run of PASSAGE words but the first, and those that overlap it."""
    order = F.struct(*_ORDER)
    first = singles.groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("times")).where("times > 1")
    return singles.join(first, "key").where((order != F.col("first")) & _apart()).select("row", "at", "n")


def _cleaned(rows: DataFrame, bits=None) -> DataFrame:
    """bits: rows in this bitmap are left out, and the others lose nothing."""
    changed = bits is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in steps(batches if changed else only(batches, bits, "row", False)):
            w = Words(data, offsets)
            total = len(w.starts)
            gone = np.zeros(total + 1, np.int64)
            if changed:
                spans = batch.column("gone")
                flat, text = spans.flatten(), np.repeat(np.arange(batch.num_rows), spans.value_lengths().fill_null(0).to_numpy())
                begin = w.by_text[text] + flat.field("at").to_numpy()
                np.add.at(gone, begin, 1)
                np.add.at(gone, begin + flat.field("n").to_numpy(), -1)
            gone = np.cumsum(gone)[:total] > 0
            # A word takes the bytes up to the next one, or to its text's end; white space before the first word stays.
            stop = np.append(w.starts[1:], len(data))[:total]
            ends = np.repeat(offsets[1:], np.diff(w.by_text))
            cuts = np.zeros(len(data) + 1, np.int64)
            np.add.at(cuts, w.starts[gone], 1)
            np.add.at(cuts, np.minimum(stop, ends)[gone], -1)
            keep = np.cumsum(cuts)[:-1] == 0
            left = np.concatenate([[0], np.cumsum(keep)])[offsets]
            kept = data[keep].tobytes()
            texts = [kept[a:b] for a, b in zip(left.tolist(), left[1:].tolist(), strict=False)]
            lost = np.concatenate([[0], np.cumsum(np.logical_or.reduceat(gone, w.first))]) if total else np.zeros(1, np.int64)
            lost_words = np.concatenate([[0], np.cumsum(gone)])
            columns = [
                batch.column("doc_id"),
                pa.array(np.diff(w.sentences), pa.int64()),
                pa.array(np.diff(lost[w.sentences]), pa.int64()),
                pa.array(np.diff(lost_words[w.by_text]), pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                pa.array([t.decode() for t in texts], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_sentences", "n_removed", "n_words_removed", "kept_sha256", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_sentences bigint, n_removed bigint, n_words_removed bigint, kept_sha256 string, text string")


def without_repeated_runs(docs: DataFrame, *, size: int = SENTENCES) -> DataFrame:
    """doc_id, n_sentences, n_removed, n_words_removed, kept_sha256, text (what is left).

    Texts are shuffled for documents that lose something or hold a stretch that is to be compared run by run, not for others.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    seen = _keyed(rows, size).groupBy("key").agg(F.count("*").alias("times"), F.min("part").alias("a"), F.max("part").alias("b")).where("times > 1")
    again = cut(seen.select("key", (F.col("a") != F.col("b")).alias("several")))
    found = cut(_keyed(rows, size, bitmap(again, "key")))
    held, order = found.where("NOT sure"), F.struct(*_ORDER)
    # The first occurrence of each key and part that occurs again; what one document holds many times is one row here.
    named = held.groupBy("key", "part").agg(F.min(order).alias("first")).join(again, "key")
    sentence = F.col("part") == 0
    later = (order != F.col("first")) & (sentence | _apart())
    single = F.col("several") & ~sentence & ~later
    marked = cut(held.join(named, ["key", "part"]).select("row", "at", "n", later.alias("later"), single.alias("single")).where("later OR single"))
    spans = cut(marked.where("single").groupBy("row").agg(F.collect_set(F.struct("at", "n")).alias("spans")))
    singles = _single_runs(rows_in(rows, bitmap(spans, "row"), "row").join(spans, "row").select("doc_id", "text", "row", "spans"))
    later = marked.where("later").select("row", "at", "n").unionByName(found.where("sure").select("row", "at", "n")).unionByName(_later(cut(singles)))
    gone = cut(later.groupBy("row").agg(F.collect_set(F.struct("at", "n")).alias("gone")))
    bits = bitmap(gone, "row")
    changed = rows_in(rows, bits, "row").join(gone, "row", "left").select("doc_id", "text", "gone")
    return _cleaned(changed).unionByName(_cleaned(rows, bits))
