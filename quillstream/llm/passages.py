"""Removal of byte strings of a fixed length that occur more than once (operator 8).

Prefix-free parsing: a rolling hash of 8-byte grams marks, in every window of ``TRIGGERS`` grams, the least gram as
trigger, so equal strings get equal triggers. A string of ``LENGTH`` bytes belongs to the first trigger in it; all
strings of one trigger lie side by side and make up one phrase, and a document's phrases in order are its parse. The bytes
that follow the trigger within each of its strings (``CONTEXT`` of them) are the phrase's key. Strings can be equal only if
their phrases' keys are equal, so:

* keys that occur once are done with after one pre-aggregated count, which covers nearly all text;
* if all phrases of a repeated key are equal (one dictionary entry), all their strings are repeated;
* else the dictionary entries of the key are compared string by string, one copy of each entry, however many
  documents hold it.

Two suffix arrays serve that comparison: one of the dictionary, of what precedes the trigger in each entry (read
backwards), and one of the parse, of what follows it, which is cut into phrases at grams whose hash says so and ordered by
the ranks of these. A string is a suffix of its phrase up to the trigger, then a prefix of what follows; so its place in corpus
order is given by its classes in the two arrays at the depths of its two parts, which adjacent common prefixes tell. Strings
are equal, byte by byte, if both classes are.

A key with more than ``ENTRIES_IN_TASK`` entries is divided by depth: strings that begin from lo to hi bytes before the
trigger agree in the lo bytes before it and in the LENGTH - hi bytes after it, and these are their new key; each half of a
range is divided on while it is crowded, down to one depth, where the key is the string itself and nothing is left to compare.

Occurrences of one entry that lie within LENGTH bytes of one another in a document, as in periodic text, are one record.
Null and empty texts, and texts under LENGTH bytes, keep everything. Equal rows count as separate documents. Rows may
share a doc_id; a null doc_id is carried. An empty table gives no rows. Extra columns are ignored.
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
from .text import mixed, prefix_sums, slice_hash, steps

LENGTH = 200
TRIGGERS = 128
CONTEXT = LENGTH - TRIGGERS + 1
GRAM = 8
#: Dictionary entries of one key that a task compares; keys with more are divided by depth.
ENTRIES_IN_TASK = 20_000
#: Entries that are sorted at a time, whatever their keys.
TOGETHER = 20_000
#: Of this many grams, one ends a phrase of what follows a trigger.
PHRASE_MASK = np.uint64(31)


def phrases(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, trigger, first string, last string) of each phrase, as positions in ``data``."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none
    gram = np.ndarray((len(data) - GRAM + 1,), "<u8", np.ascontiguousarray(data), strides=(1,))
    least = mixed(gram.astype(np.uint64)) & np.uint64(0xFFFFFFFF00000000) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while width < TRIGGERS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    count = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    start = np.repeat(offsets[:-1] - np.cumsum(count) + count, count) + np.arange(count.sum())
    if not len(start):
        return none, none, none, none
    trigger = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (text[1:] != text[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    return text[first], trigger[first], start[first], start[last]


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _parsed(rows: DataFrame, bits=None) -> DataFrame:
    """row, at and last (triggers of the first and the last of n occurrences), n, back and ahead (bytes from the first and the last string to the trigger), key, entry.

    bits: only keys in this bitmap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in steps(batches):
            text, trigger, first, last = phrases(data, offsets)
            if not len(text):
                continue
            sums = prefix_sums(data)
            key = slice_hash(sums, trigger, trigger + CONTEXT).view(np.int64)
            if bits is not None:
                use = held_in(bits, key)
                text, trigger, first, last, key = (x[use] for x in (text, trigger, first, last, key))
                if not len(text):
                    continue
            entry = slice_hash(sums, first, last + LENGTH).view(np.int64)
            order = np.lexsort((trigger, entry, text))
            text, trigger, first, last, key, entry = (x[order] for x in (text, trigger, first, last, key, entry))
            new = np.append(True, (text[1:] != text[:-1]) | (entry[1:] != entry[:-1]) | (np.diff(trigger) > LENGTH))
            a = np.flatnonzero(new)
            z = np.append(a[1:], len(text)) - 1
            columns = [
                pa.array(batch.column("row").to_numpy()[text[a]]),
                pa.array((trigger[a] - offsets[text[a]]).astype(np.int32)),
                pa.array((trigger[z] - offsets[text[a]]).astype(np.int32)),
                pa.array((z - a + 1).astype(np.int32)),
                pa.array((trigger - first)[a].astype(np.int16)),
                pa.array((trigger - last)[a].astype(np.int16)),
                pa.array(key[a]),
                pa.array(entry[a]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "at", "last", "n", "back", "ahead", "key", "entry"])

    return rows.select("row", "text").mapInArrow(run, "row bigint, at int, last int, n int, back smallint, ahead smallint, key bigint, entry bigint")


_ENTRY = "key bigint, entry bigint, copies bigint, back smallint, bytes binary"


def _entry_texts(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """key, entry, copies, back, bytes: the bytes from an entry's first string to the end of its last, taken from one row that holds it."""
    by_row = entries.groupBy("row").agg(F.collect_list(F.struct("at", "back", "ahead", "key", "entry", "copies")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in steps(batches):
            raw, parts = data.tobytes(), batch.column("parts")
            flat = parts.flatten()
            at = np.repeat(offsets[:-1], parts.value_lengths().to_numpy()) + flat.field("at").to_numpy()
            a, z = (at - flat.field("back").to_numpy()).tolist(), (at - flat.field("ahead").to_numpy() + LENGTH).tolist()
            found = pa.array([raw[x:y] for x, y in zip(a, z, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(flat.field(c) for c in ("key", "entry", "copies", "back")), found], names=["key", "entry", "copies", "back", "bytes"])

    # Equal rows have one key; any of them serves.
    texts = rows_in(rows.select("row", "text"), bitmap(by_row, "row"), "row")
    return texts.join(by_row, "row").mapInArrow(run, _ENTRY).dropDuplicates(["key", "entry"])


def _common(sorted_parts: list[bytes]) -> np.ndarray:
    """Length of the common prefix of each part with the one before it; -1 for the first."""
    size = np.array([len(x) for x in sorted_parts], np.int64)
    width = max(1, int(size.max()))
    grid = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in sorted_parts), np.uint8).reshape(-1, width)
    differ = grid[1:] != grid[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return np.concatenate([[-1], np.minimum(first, np.minimum(size[1:], size[:-1]))])


def parsed(parts: list[bytes]) -> list[list[bytes]]:
    """Each part cut after every gram that ends a phrase: no phrase is then a proper prefix of another but at a part's end."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(x) for x in parts])
    if len(data) < GRAM:
        return [[x] for x in parts]
    gram = np.ndarray((len(data) - GRAM + 1,), "<u8", data, strides=(1,)).astype(np.uint64)
    stop = np.flatnonzero(mixed(gram) & PHRASE_MASK == 0) + GRAM
    owner = np.searchsorted(ends, stop, "left")
    begin = ends - np.array([len(x) for x in parts])
    inside = (stop - begin[np.minimum(owner, len(parts) - 1)] >= GRAM) & (stop < ends[np.minimum(owner, len(parts) - 1)])
    stop, owner = (stop - begin[owner])[inside].tolist(), owner[inside]
    by_part = np.searchsorted(owner, np.arange(len(parts) + 1)).tolist()
    return [[x[a:b] for a, b in zip([0, *stop[i:j]], [*stop[i:j], len(x)], strict=True)] for x, i, j in zip(parts, by_part, by_part[1:], strict=False)]


def parse_order(parts: list[bytes]) -> list[int]:
    """The order of the parts, by the ranks of their phrases in the sorted dictionary."""
    every = parsed(parts)
    rank = {p: k for k, p in enumerate(sorted({p for x in every for p in x}))}
    ids = [[rank[p] for p in x] for x in every]
    return sorted(range(len(parts)), key=ids.__getitem__)


def repeated_strings(found: list[bytes], back: np.ndarray, copies: np.ndarray, lo: int = 0, hi: int = TRIGGERS) -> tuple[np.ndarray, np.ndarray]:
    """(entry, position) of every string that another entry has too, or that is in an entry of several copies, by entry and position.

    found: the entries' bytes; back: how many of them precede the trigger. Only strings that begin from lo to hi bytes before it.
    """
    back = back.astype(np.int64)
    end = np.array([len(x) for x in found], np.int64) - LENGTH  # position of an entry's last string
    before = [x[:b][::-1] for x, b in zip(found, back.tolist(), strict=True)]
    after = [x[b:] for x, b in zip(found, back.tolist(), strict=True)]
    of_dictionary = np.array(sorted(range(len(found)), key=before.__getitem__), np.int64)
    of_parse = np.array(parse_order(after), np.int64)
    common_before, common_after = _common([before[k] for k in of_dictionary]), _common([after[k] for k in of_parse])
    n = len(found)
    left, right = np.empty(n, np.int64), np.empty(n, np.int64)
    owner, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for depth in range(lo, min(hi, int(back.max())) + 1):
        at = np.flatnonzero((back >= depth) & (back - depth <= end))
        if not len(at):
            continue
        left[of_dictionary] = np.cumsum(common_before < depth)
        right[of_parse] = np.cumsum(common_after < LENGTH - depth)
        both = left[at] * (n + 1) + right[at]
        order = np.argsort(both, kind="stable")
        s = both[order]
        same = np.concatenate([[False], s[1:] == s[:-1]])
        again = np.zeros(len(at), bool)
        again[order] = same | np.concatenate([same[1:], [False]])
        again |= copies[at] > 1
        owner.append(at[again])
        place.append(back[at[again]] - depth)
    owner, place = np.concatenate(owner), np.concatenate(place)
    order = np.lexsort((place, owner))
    return owner[order], place[order]


_RUNS = "key bigint, entry bigint, starts array<int>, ends array<int>"


def _runs(rows: list[tuple], owner: np.ndarray, inside: np.ndarray) -> pa.RecordBatch:
    """key, entry, starts, ends: byte runs covered by repeated strings, counted from the trigger; neighbours a LENGTH apart or less are merged."""
    new = np.append(True, (owner[1:] != owner[:-1]) | (np.diff(inside) > LENGTH))[: len(owner)]
    cuts = np.searchsorted(owner[new], np.arange(len(rows) + 1))
    last = np.append(np.flatnonzero(new)[1:], len(owner))[: int(new.sum())] - 1
    back = np.repeat(np.array([r[3] for r in rows], np.int64), np.diff(cuts))
    listed = lambda x: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x - back, pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), listed(inside[new]), listed(inside[last] + LENGTH)], names=["key", "entry", "starts", "ends"])


def _compared(entries: DataFrame) -> DataFrame:
    """key, entry, starts, ends: the repeated byte runs of each entry; an entry may have several rows."""
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def given(keep: int) -> Iterator[pa.RecordBatch]:
            """Gives out all but the last ``keep`` rows, which are of a group that may go on."""
            nonlocal held
            rows, held = held[: len(held) - keep], held[len(held) - keep :]
            while rows:
                n = next((k for k, r in enumerate(rows) if r[5] != rows[0][5]), len(rows))
                own, rows = rows[:n], rows[n:]
                lo = own[0][5]
                yield _runs(own, *repeated_strings([r[4] for r in own], np.array([r[3] for r in own]), np.array([r[2] for r in own]), lo, lo + width - 1))

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("key", "entry", "copies", "back", "bytes", "lo", "crowd")), strict=True)
            if len(held) < TOGETHER:
                continue
            last = 0
            while last < len(held) and held[-1 - last][6] == held[-1][6]:
                last += 1
            yield from given(last)
        yield from given(0)

    def divided(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
        """The rows once for each half of their range, of ``width`` depths, that they have strings in, with the key of that half."""
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                for lo in (r["lo"], r["lo"] + width):
                    after = LENGTH - (lo + width - 1)
                    if lo <= r["back"] and r["back"] + after <= len(r["bytes"]):
                        new = r["bytes"][r["back"] - lo : r["back"] + after]
                        out.append({**r, "lo": lo, "crowd": int.from_bytes(hashlib.blake2b(new, digest_size=8, key=lo.to_bytes(2, "big")).digest(), "big", signed=True)})
            yield pa.RecordBatch.from_pylist(out, batch.schema)

    level = entries.withColumn("lo", F.lit(0)).withColumn("crowd", F.col("key"))
    out, width = None, TRIGGERS
    while True:
        crowded = cut(level.groupBy("crowd").agg(F.count("*").alias("n")).where(F.col("n") > ENTRIES_IN_TASK).select("crowd"))
        few = level.join(crowded, "crowd", "left_anti").repartition(parts, "crowd").sortWithinPartitions("lo", "crowd", "entry")
        own = few.mapInArrow(lambda batches, width=width: compare(batches, width), _RUNS)
        out = own if out is None else out.unionByName(own)
        if crowded.isEmpty():
            return out
        many = level.join(crowded, "crowd").select(*level.columns)
        if width == 1:  # one depth: all entries of a key hold one and the same string
            lo = F.col("lo")
            return out.unionByName(many.select("key", "entry", F.array(-lo).alias("starts"), F.array(LENGTH - lo).alias("ends")))
        width //= 2
        level = cut(many.mapInArrow(lambda batches, width=width: divided(batches, width), level.schema))


def _cleaned(rows: DataFrame, bits=None) -> DataFrame:
    """bits: rows in this bitmap are left out, and the others lose nothing."""
    with_runs = bits is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in steps(batches if with_runs else only(batches, bits, "row", False)):
            gone = np.zeros(len(data) + 1, np.int64)
            if with_runs:
                runs = batch.column("runs")
                flat, first = runs.flatten(), np.repeat(offsets[:-1], runs.value_lengths().fill_null(0).to_numpy())
                np.add.at(gone, first + flat.field("a").to_numpy(), 1)
                np.add.at(gone, first + flat.field("z").to_numpy(), -1)
            gone = np.cumsum(gone)[:-1] > 0
            lost = np.concatenate([[0], np.cumsum(gone)])
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            begins[offsets[:-1][np.diff(offsets) > 0]] |= gone[offsets[:-1][np.diff(offsets) > 0]]
            spans = np.concatenate([[0], np.cumsum(begins)])
            kept, left = data[~gone].tobytes(), (offsets - lost[offsets]).tolist()
            texts = [kept[a:b] for a, b in zip(left, left[1:], strict=False)]
            columns = [batch.column("doc_id"), *(pa.array(np.diff(x), pa.int64()) for x in (offsets, lost[offsets], spans[offsets])), pa.array([hashlib.sha256(x).hexdigest() for x in texts]), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary: the bytes left, which may end inside a character)."""
    rows = docs.select("doc_id", "text", _row_key().alias("row"))
    keys = _parsed(rows).groupBy("key").agg(F.sum("n").alias("n"), F.min("entry").alias("e0"), F.max("entry").alias("e1")).where("n > 1")
    keys = cut(keys.select("key", (F.col("e0") != F.col("e1")).alias("several")))
    held = cut(_parsed(rows, bitmap(keys, "key")).join(keys, "key"))
    entries = held.where("several").groupBy("key", "entry").agg(F.sum("n").alias("copies"), F.min(F.struct("row", "at", "back", "ahead")).alias("x"))
    compared = _compared(cut(_entry_texts(rows, entries.select("key", "entry", "copies", "x.*"))))
    # Occurrences of one record are LENGTH apart at most, and a run is no shorter, so the runs of all of them are one.
    whole = held.where("NOT several").select("row", (F.col("at") - F.col("back")).alias("a"), (F.col("last") - F.col("ahead") + LENGTH).alias("z"))
    found = held.where("several").join(compared.where(F.size("starts") > 0), ["key", "entry"])
    some = found.select("row", "at", "last", F.inline(F.arrays_zip("starts", "ends"))).select("row", (F.col("at") + F.col("starts")).alias("a"), (F.col("last") + F.col("ends")).alias("z"))
    runs = cut(whole.unionByName(some).groupBy("row").agg(F.collect_list(F.struct("a", "z")).alias("runs")))
    bits = bitmap(runs, "row")
    changed = rows_in(rows, bits, "row").join(runs, "row", "left").select("doc_id", "text", "runs")
    return _cleaned(changed).unionByName(_cleaned(rows, bits))
