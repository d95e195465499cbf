"""Byte-level BPE encoding and decoding (operator 2).

Text is split without regular expressions. Each code point gets a class (letter, number, white space, other,
apostrophe that may open a contraction) by table lookup; each class is a transition function on four states, packed
in a byte; an associative scan over these bytes gives the state before every code point, from which the boundaries
follow. The slices go through a cache of merged pairs, and their offsets are kept for decoding.

Null and empty texts give no tokens. Texts of any length are taken whole. Repeated rows give equal results. Extra
columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import steps, text_bytes

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: Code points with the Unicode property White_Space (fixed values).
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters and numbers of Unicode 16 that Python's tables may not have yet (fixed values: first, last).
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: Cached pieces of a worker; beyond this many the cache starts anew.
CACHE_PIECES = 400_000
#: Pieces longer than this are merged with a heap.
LONG_PIECE = 64

# States: 0 an apostrophe would continue the token, 1 and 2 that many letters of a contraction are to come, 3 none of these.
_OPEN, _ONE, _TWO, _FREE = 0, 1, 2, 3


def _function(*to: int) -> int:
    """The function that maps state s to to[s], as one byte."""
    return sum(t << 2 * s for s, t in enumerate(to))


_IDENTITY = _function(0, 1, 2, 3)
_F_LETTER = _function(_FREE, _FREE, _ONE, _FREE)
_F_FREE = _function(*[_FREE] * 4)
_F_OPEN = _function(*[_OPEN] * 4)
_F_SHORT = _function(_OPEN, _OPEN, _OPEN, _ONE)
_F_PAIR = _function(_OPEN, _OPEN, _OPEN, _TWO)


def _composition() -> np.ndarray:
    """Table of 65,536: entry (f << 8) | g is the function that applies f, then g."""
    f, g = np.divmod(np.arange(1 << 16), 256)
    out = np.zeros(1 << 16, np.int64)
    for s in range(4):
        out |= (g >> (2 * (f >> 2 * s & 3)) & 3) << 2 * s
    return out.astype(np.uint8)


_THEN = _composition()
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point."""
    if not _classes:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        table[WHITE] = SPACE
        for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
            for a, b in ranges:
                table[a : b + 1] = kind
        _classes.append(table)
    return _classes[0]


def scan(f: np.ndarray, width: int = 64) -> np.ndarray:
    """Inclusive scan of packed functions under composition."""
    n = len(f)
    if n <= width:
        out = f.copy()
        for i in range(1, n):
            out[i] = _THEN[int(out[i - 1]) << 8 | int(out[i])]
        return out
    blocks = -(-n // width)
    padded = np.full(blocks * width, _IDENTITY, np.uint8)
    padded[:n] = f
    a = np.ascontiguousarray(padded.reshape(blocks, width).T)
    for j in range(1, width):
        a[j] = _THEN[a[j - 1].astype(np.uint16) << np.uint16(8) | a[j]]
    before = np.full(blocks, _IDENTITY, np.uint8)
    before[1:] = scan(a[-1].copy(), width)[:-1]
    out = _THEN[(before.astype(np.uint16) << np.uint16(8))[None, :] | a]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces begin. points: the texts' code points end to end; first: where non-empty texts begin, ascending."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    opens = np.zeros(n + 2, bool)
    opens[first] = True
    opens[n:] = True
    white = kind == SPACE
    blank_next = opens[1 : n + 1].copy()
    blank_next[:-1] |= white[1:]
    last_white = white & ~blank_next
    space = last_white & (points == 32)
    step = np.where(kind == LETTER, np.uint8(_F_LETTER), np.where(kind == OTHER, np.uint8(_F_OPEN), np.uint8(_F_FREE)))
    step[space] = _F_OPEN
    quote = np.flatnonzero(points == 39)
    if len(quote):
        wide = np.concatenate([points, np.zeros(2, points.dtype)])
        one = np.where(opens[quote + 1], 0, wide[quote + 1])
        two = np.where(opens[quote + 1] | opens[quote + 2], 0, wide[quote + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        step[quote[short]] = _F_SHORT
        step[quote[pair]] = _F_PAIR
    step[first] = (step[first] >> 6) * np.uint8(0x55)  # a text begins in the free state, whatever came before
    before = np.full(n, _FREE, np.uint8)
    before[1:] = scan(step)[:-1] >> 6
    before[first] = _FREE
    same = np.zeros(n, bool)
    same[1:] = kind[1:] == kind[:-1]
    after_space = np.zeros(n, bool)
    after_space[1:] = space[:-1]
    ended = np.zeros(n, bool)  # a contraction ended just before
    ended[1:] = (before[:-1] == _ONE) & (kind[:-1] == LETTER)
    goes_on = same & (kind != OTHER) & ~ended | after_space
    goes_on |= (kind == LETTER) & ((before == _ONE) | (before == _TWO))
    goes_on |= (kind == OTHER) & (before == _OPEN)
    goes_on &= ~last_white & ~opens[:n]
    return np.flatnonzero(~goes_on)


class Pieces(dict):
    """str piece -> its ids as little-endian 32-bit words; merges what it does not know."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        known = self.ranks.get(raw)
        ids = [known] if known is not None else (merged_long if len(raw) > LONG_PIECE else merged)(raw, self.ranks)
        packed = np.array(ids, "<u4").tobytes()
        if len(piece) <= LONG_PIECE:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = packed
        return packed


def merged(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a short piece: the pair of least rank, leftmost first, is merged until none has a rank."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    get, none = ranks.get, len(ranks)
    pair = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pair:
        least = min(pair)
        if least == none:
            break
        i = pair.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pair[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def merged_long(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As ``merged``, in O(n log n)."""
    n = len(raw)
    end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n + 1)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = right[i] if not gone[i] else n
        if gone[i] or j >= n or end[j] != stop:
            continue
        end[i], gone[j], right[i] = stop, 1, right[j]
        if right[i] < n:
            left[right[i]] = i
            if (r := ranks.get(raw[i : end[right[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[right[i]]))
        if left[i] >= 0 and (r := ranks.get(raw[left[i] : stop])) is not None:
            heapq.heappush(heap, (r, left[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[raw[i : end[i]]])
        i = right[i]
    return out


class Encoder:
    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.tokens: list[bytes] = [b""] * (1 + max(self.ranks.values(), default=-1))
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pieces = Pieces(self.ranks)

    def encode_step(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """For texts end to end: packed ids of each, starts of all pieces (code points, from the first text's start), and n + 1 offsets into them."""
        text = data.tobytes().decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(points) == len(data):
            at = offsets
        else:
            count = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=count[1:])
            at = count[offsets]
        first = np.unique(at[:-1][np.diff(at) > 0])
        starts = piece_starts(points, first)
        by_text = np.searchsorted(starts, at)
        bounds = [*starts.tolist(), len(text)]
        look = self.pieces
        parts = [look[text[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]
        cuts = by_text.tolist()
        return [b"".join(parts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], starts, by_text

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_step(*text_bytes(pa.array([text], pa.string())))[0][0], "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def token_ends(self, ids) -> np.ndarray:
        """Where each token ends in the decoded bytes."""
        return np.cumsum([len(self.tokens[i]) for i in ids], dtype=np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(rank_file: bytes) -> Encoder:
    """One encoder for each rank file and worker process."""
    key = hashlib.sha256(rank_file).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(rank_file)
    return _encoders[key]


def rank_file(df: DataFrame, path: str):
    """The vocabulary, read on the driver and broadcast: its size is that of the vocabulary file, whatever the corpus."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encoded(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, ``keep``, ids array<int>, token_ends array<int> (bytes), n_tokens: a narrow pass, no shuffle."""
    ranks = rank_file(docs, path)
    kept = (id_col, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks.value)
        lengths = np.array([len(t) for t in bpe.tokens], np.int64)
        for rows, data, offsets in steps(batches, text_col):
            packed, _, _ = bpe.encode_step(data, offsets)
            ids = np.frombuffer(b"".join(packed), "<i4")
            cuts = np.cumsum([0, *(len(p) // 4 for p in packed)])
            total = np.cumsum(np.concatenate([[0], lengths[ids]]))
            ends = (total[1:] - np.repeat(total[cuts[:-1]], np.diff(cuts))).astype(np.int32)
            listed = lambda x: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int32()))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), listed(ids), listed(ends), pa.array(np.diff(cuts), pa.int64())], names=[*kept, "ids", "token_ends", "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    return docs.select(*dict.fromkeys((*kept, text_col))).mapInArrow(run, f"{schema}, ids array<int>, token_ends array<int>, n_tokens bigint")


def digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every text, encoded and decoded in one narrow pass."""
    ranks = rank_file(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks.value)
        sha = hashlib.sha256
        for rows, data, offsets in steps(batches, text_col):
            packed, _, _ = bpe.encode_step(data, offsets)
            back = [sha(bpe.decode(np.frombuffer(p, "<u4").tolist())).hexdigest() for p in packed]
            yield pa.RecordBatch.from_arrays([rows.column(id_col), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([sha(p).hexdigest() for p in packed]), pa.array(back)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def length_histogram(docs: DataFrame, path: str, *, text_col: str = "text") -> DataFrame:
    """n_tokens, n_docs: documents by encoded length. Each task counts what it reads before anything is shuffled."""
    ranks = rank_file(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks.value)
        seen: dict[int, int] = {}
        for _, data, offsets in steps(batches, text_col):
            for p in bpe.encode_step(data, offsets)[0]:
                seen[len(p) // 4] = seen.get(len(p) // 4, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["n_tokens", "n_docs"])

    counted = docs.select(text_col).mapInArrow(run, "n_tokens bigint, n_docs bigint")
    return counted.groupBy("n_tokens").agg({"n_docs": "sum"}).withColumnRenamed("sum(n_docs)", "n_docs")
