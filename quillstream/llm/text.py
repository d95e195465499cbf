"""Texts of Arrow batches as numpy arrays: slices of bounded size, word bounds and word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy step works on; a single longer text is a step of its own.
STEP_BYTES = 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def steps(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their UTF-8 bytes end to end, n + 1 offsets), about STEP_BYTES at a time. A null text counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(offsets, offsets[lo] + STEP_BYTES, "right")) - 1
            hi = min(max(hi, lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi
    _give_back()


def _give_back() -> None:
    """What a task has freed goes back to the system: workers are used again, and other stages need the memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Powers are products of one of the first 2**_LOW powers and one of the powers of base**(2**_LOW): two short tables, whatever a text's length.
_LOW = 11


def _powers(base: int, n: int) -> np.ndarray:
    out, have = np.ones(max(1, n), np.uint64), 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


_low = {base: _powers(base, 1 << _LOW) for base in (_BASE, _INVERSE)}
_high = {base: np.zeros(0, np.uint64) for base in (_BASE, _INVERSE)}


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Low and high powers that make all powers below n."""
    rows = (n >> _LOW) + 1
    if len(_high[base]) < rows:
        _high[base] = _powers(pow(base, 1 << _LOW, 1 << 64), max(1 << _LOW, 1 << (rows - 1).bit_length()))
    return _low[base], _high[base]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """n + 1 sums from which ``slice_hash`` takes the hash of any slice."""
    low, high = _tables(_BASE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    for a in range(0, len(data), STEP_BYTES):
        part = data[a : a + STEP_BYTES].astype(np.uint64)
        part += np.uint64(1)
        row = a >> _LOW
        power = high[row : row + (len(part) >> _LOW) + 1, None] * low[None, :]
        np.multiply(part, power.reshape(-1)[: len(part)], out=sums[a + 1 : a + 1 + len(part)])
    np.cumsum(sums[1:], out=sums[1:])
    return sums


def slice_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end]: equal for equal bytes wherever they stand."""
    low, high = _tables(_INVERSE, len(sums))
    inverse = high[start >> _LOW] * low[start & ((1 << _LOW) - 1)]
    return mixed((sums[end] - sums[start]) * inverse + (end - start).astype(np.uint64) * _ODD)


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


#: Bytes of plain words: ASCII letters and digits, and all bytes of other characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = ~_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes of ``kind``, by default without white space; a word never crosses texts), and n + 1 word offsets."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = kind[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:n]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:] | first[1:n]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` lower-cased words, and n + 1 offsets by text.

    A text with fewer words has its whole word sequence as one shingle; without words it has none.
    """
    data = lowered(data)
    starts, ends, by_text = words(data, offsets)
    hashed = slice_hash(prefix_sums(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return grams(hashed, by_text, size)


def grams(hashed: np.ndarray, by_text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.diff(by_text)
    many = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    out = np.zeros(len(many) + 1, np.int64)
    np.cumsum(many, out=out[1:])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    at = np.repeat(by_text[:-1] - out[:-1], many) + np.arange(out[-1])
    short = np.repeat(count < size, many)
    taken = np.repeat(np.minimum(count, size), many)
    total = np.zeros(out[-1], np.uint64)
    last = len(hashed) - 1
    for k in range(size):
        part = hashed[np.minimum(at + k, last)] * np.uint64(pow(_INVERSE, 3 * k + 1, 1 << 64))
        total += np.where(k < taken, part, np.uint64(0)) if short.any() else part
    return mixed(total + taken.astype(np.uint64) * _ODD), out
