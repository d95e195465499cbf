"""Document fingerprints by one-permutation MinHash (operator 1).

The hashes of a text's five-word shingles are dealt once into ``BINS`` bins by their leading bits, and each bin keeps
its least hash. An empty bin copies the bin that its own random order of the others names first among the filled ones
(optimal densification). Only the low ``BITS`` bits of each bin are kept, packed as hexadecimal; the likeness of two
fingerprints is the share of equal bins, corrected for the chance 2**-BITS that unequal bins agree.

Texts with fewer than five words have their whole word sequence as one shingle. A null or empty text, or one of white
space only, has the empty fingerprint: likeness 1 to another empty one and 0 to any other. Document order is by id, then by a
hash of the text, then by text, so repeated rows are neighbours; null ids come first. Ids are whole numbers. An empty table
gives no rows; one document is its own next. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import mixed, shingles, steps, text_bytes

WORDS = 5
BINS = 256
BITS = 8
#: The corpus is cut into runs of documents that are sorted by themselves: of DOCS_IN_RUN documents while that makes SOME_RUNS
#: at most, and beyond of RUN_BYTES of text, however many these are.
DOCS_IN_RUN, SOME_RUNS, RUN_BYTES = 1000, 256, 64 << 20

_LEAST = -(1 << 63)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_orders: list[np.ndarray] = []


def _fill_orders() -> np.ndarray:
    """(BINS, BINS): for each bin, an order of all bins to copy from."""
    if not _orders:
        _orders.append(np.argsort(mixed(np.arange(1, BINS * BINS + 1, dtype=np.uint64)).reshape(BINS, BINS), axis=1))
    return _orders[0]


def minima(hashes: np.ndarray, by_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Densified bins (texts x BINS, low BITS bits) and which texts have any shingle."""
    n = len(by_text) - 1
    bins = np.full(n * BINS, _NONE, np.uint64)
    shift = np.uint64(64 - (BINS - 1).bit_length())
    at = np.repeat(np.arange(n) * BINS, np.diff(by_text)) + (hashes >> shift).astype(np.int64)
    np.minimum.at(bins, at, mixed(hashes))
    bins = bins.reshape(n, BINS)
    some = np.diff(by_text) > 0
    order = _fill_orders()
    row, col = np.nonzero((bins == _NONE) & some[:, None])
    filled = bins != _NONE
    for k in range(BINS):
        if not len(row):
            break
        source = order[col, k]
        hit = filled[row, source]
        bins[row[hit], col[hit]] = bins[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
    return (bins & np.uint64((1 << BITS) - 1)).astype(np.uint8), some


def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    rows = pa.RecordBatch.from_arrays([texts], names=["text"])
    parts = [minima(*shingles(data, offsets, WORDS)) for _, data, offsets in steps(iter([rows]))]
    if not parts:
        return np.zeros((0, BINS), np.uint8), np.zeros(0, bool)
    return np.concatenate([p for p, _ in parts]), np.concatenate([s for _, s in parts])


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    chance = 2.0**-BITS
    share = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    return np.where(some_a & some_b, share, np.where(some_a | some_b, 0.0, 1.0))


def _hex(bins: np.ndarray, some: np.ndarray) -> list[str]:
    return [b.tobytes().hex() if s else "" for b, s in zip(bins, some, strict=True)]


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    """rows: (id, text, whether another row follows at once); the last only serves as somebody's next."""
    own = [t for _, t, _ in rows]
    bins, some = fingerprints(pa.array(own, pa.large_string()))
    use = np.array([k for k, r in enumerate(rows) if r[2]], np.int64)
    changed = [edited(own[k], own[k + 1]) for k in use.tolist()]
    bins_e, some_e = fingerprints(pa.array(changed, pa.large_string()))
    columns = [
        pa.array([rows[k][0] for k in use.tolist()], id_type),
        pa.array([len(own[k]) for k in use.tolist()], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        pa.array(_hex(bins[use], some[use]), pa.string()),
        pa.array(_hex(bins_e, some_e), pa.string()),
        pa.array(likeness(bins[use], some[use], bins_e, some_e), pa.float64()),
        pa.array(likeness(bins[use], some[use], bins[use + 1], some[use + 1]), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _sortable(at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Pairs of 64-bit numbers as byte strings of the same order."""
    pair = np.stack([at, h], axis=1).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(pair.astype(">u8")).view("S16").ravel()


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text -> the fingerprint of each text, of its edited text, and their likeness.

    The documents are cut into runs by their order, at bounds that Spark's range partitioning finds, so the texts are shuffled
    once and no window spans all rows; rows that share an id, or have none, are cut by the hashes of their texts. The first
    document of each run (its bound) is also sent to the run before, as the last one's next.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LEAST)).alias("at")).withColumn("h", F.xxhash64("text"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()
    runs = int(max(1, min(n // DOCS_IN_RUN, SOME_RUNS), size // RUN_BYTES))
    places = rows.select("at", "h")
    dealt = places.repartitionByRange(runs, "at", "h") if runs > 1 else places
    first = dealt.select("at", "h", F.spark_partition_id().alias("p")).groupBy("p").agg(F.min(F.struct("at", "h")).alias("x")).select("x.*").toArrow()
    bounds = spark.sparkContext.broadcast(np.unique(_sortable(first.column("at").to_numpy(), first.column("h").to_numpy())))

    @F.pandas_udf("int")
    def run_of(at: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, _sortable(at.to_numpy(), h.to_numpy()), "right") - 1).astype("int32")

    @F.pandas_udf("boolean")
    def bound(at: pd.Series, h: pd.Series) -> pd.Series:
        key = _sortable(at.to_numpy(), h.to_numpy())
        return pd.Series(bounds.value[np.maximum(np.searchsorted(bounds.value, key, "right") - 1, 0)] == key)

    own = rows.withColumn("run", run_of("at", "h")).withColumn("guest", F.lit(False))
    guests = rows.where(bound("at", "h")).withColumn("run", F.pmod(run_of("at", "h") - 1, F.lit(max(1, len(bounds.value))))).withColumn("guest", F.lit(True))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.unionByName(guests).repartition(parts, "run").sortWithinPartitions("run", "guest", "at", "h", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # (id, text, run, guest) not yet given out; the last of them waits for its next
        kind = pa.int64()

        def given(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            rows = [(a[0], a[1], not a[3] and b[2] == a[2]) for a, b in zip(held, held[1:], strict=False)]
            if rows:
                yield _compared([*rows, (held[-1][0], held[-1][1], False)], kind)
            held = [] if last else held[-1:]

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            size = 0
            for row, k in zip(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "run", "guest")), strict=True), np.diff(text_bytes(batch.column("text"))[1]).tolist(), strict=True):
                if row[3] and held and held[-1][3] and held[-1][2] == row[2]:
                    continue  # only the first guest of a run is anybody's next
                held.append(row)
                size += k
                if size > 4 << 20:
                    yield from given(False)
                    size = 0
            yield from given(False)
        yield from given(True)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return dealt.mapInArrow(compare, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
