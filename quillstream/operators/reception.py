"""Slots of one stream to a message.

Slots come in chunks, as arrays, and are cut at control symbols into passes. After each control symbol, and at the end,
the passes kept so far are tried: candidate lengths by support; for each, a word by position votes, with ever more of its
weakest symbols erased, then complete passes with one symbol too few or too many. All words of one trial are rows of one
matrix, which goes through the batch decoder at once; the first row that decodes is taken, so the order of the rows is the
order of preference. The trials of many streams go through it together: ``feeding`` and ``closing`` are generators that ask
for a search and are sent what it found.

At most ``MAX_PASSES`` passes are held. The first message is the only one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Generator
from typing import NamedTuple

import numpy as np

from .. import constants as C
from ..functions.reed_solomon import PAYLOAD_OF, codeword_length, first_messages

LOST = -1  # a symbol that was not read
TOP_LENGTHS = 4
#: Support of a complete pass for the lengths around its own (fixed values), and of one between two ENDs.
AROUND = {0: 2.0, -1: 0.5, 1: 0.5, -2: 0.25, 2: 0.25}


class Pass(NamedTuple):
    symbols: np.ndarray
    weights: np.ndarray
    starts: bool
    after_end: bool
    ends: bool

    @property
    def whole(self) -> bool:
        return self.starts and self.ends


class Message(NamedTuple):
    payload: bytes
    corrected: int
    passes: int
    n: int
    attempts: int  # words that were tried up to this one


def alignment(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a global alignment where a symbol of ``own`` stands beside one of ``other``.

    LOST is alike to anything, for nothing. Of equal paths the diagonal is taken, else a gap in ``other``.
    """
    n, m = len(own), len(other)
    pair = np.where(own[:, None] == other[None, :], C.ALIGN_MATCH, C.ALIGN_MISMATCH)
    pair[own == LOST] = 0
    pair[:, other == LOST] = 0
    ramp = C.ALIGN_GAP * np.arange(m + 1)
    score = np.empty((n + 1, m + 1), np.int64)
    score[0] = ramp
    for i in range(n):
        row = score[i] + C.ALIGN_GAP
        row[1:] = np.maximum(row[1:], score[i, :-1] + pair[i])
        score[i + 1] = np.maximum.accumulate(row - ramp) + ramp  # gaps in ``own``, all at once
    left, right = [], []
    i, j = n, m
    while i and j:
        if score[i, j] == score[i - 1, j - 1] + pair[i - 1, j - 1]:
            i, j = i - 1, j - 1
            left.append(i)
            right.append(j)
        elif score[i, j] == score[i - 1, j] + C.ALIGN_GAP:
            i -= 1
        else:
            j -= 1
    return np.array(left[::-1], np.int64), np.array(right[::-1], np.int64)


#: Gives a matrix of words to try, is sent what the first message among them is, and returns a message in the end.
Asking = Generator[np.ndarray, tuple[int, bytes, int] | None, object]


def answered(asking: list[Asking]) -> list:
    """What each returns in the end; the searches that they ask for at a time are made together."""
    out: list = [None] * len(asking)
    answers: dict[int, tuple[int, bytes, int] | None] = dict.fromkeys(range(len(asking)))
    while answers:
        asked: dict[int, np.ndarray] = {}
        for k, found in answers.items():
            try:
                asked[k] = asking[k].send(found)
            except StopIteration as end:
                out[k] = end.value
        answers = dict(zip(asked, first_messages(list(asked.values())), strict=True))
    return out


class Votes:
    """Weighted votes for symbols at positions; the first cast wins a tie."""

    def __init__(self, n: int):
        self.n = n
        self.cast: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, pos: np.ndarray, symbols: np.ndarray, weights: np.ndarray) -> None:
        use = (symbols != LOST) & (pos >= 0) & (pos < self.n)
        self.cast.append((pos[use], symbols[use], weights[use]))

    def leaders(self) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, LOST where nothing was cast; lead over the next) of each position."""
        word, lead = np.full(self.n, LOST, np.int64), np.zeros(self.n)
        pos, symbols, weights = (np.concatenate(x) for x in zip(*self.cast, strict=True)) if self.cast else ((),) * 3
        if not len(pos):
            return word, lead
        box, first, which = np.unique(pos * C.NUM_CLASSES + symbols, return_index=True, return_inverse=True)
        total = np.bincount(which, weights)
        order = np.lexsort((first, -total, box // C.NUM_CLASSES))
        at, total, symbol = box[order] // C.NUM_CLASSES, total[order], box[order] % C.NUM_CLASSES
        top = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        top = top[total[top] > 0]
        second = np.where(np.append(at, -1)[top + 1] == at[top], np.append(total, 0.0)[top + 1], 0.0)
        word[at[top]], lead[at[top]] = symbol[top], total[top] - second
        return word, lead


def erasing_weakest(word: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """(tries, n): the word, and the word with 2, 4, ... of its weakest symbols erased, while parity allows."""
    n = len(word)
    if n not in PAYLOAD_OF:
        return np.zeros((0, n), np.int64)
    known = np.flatnonzero(word != LOST)
    room = n - PAYLOAD_OF[n] - 3 - (n - len(known))
    if room < 0:
        return np.zeros((0, n), np.int64)
    rank = np.full(n, n)
    rank[known[np.lexsort((known, lead[known]))]] = np.arange(len(known))
    erased = np.arange(0, min(room, len(known) + 1) + 1, 2)
    return np.where(rank[None, :] < erased[:, None], LOST, word[None, :])


def one_mended(symbols: np.ndarray, n: int) -> np.ndarray:
    """(tries, n): a pass of n - 1 symbols with a lost one put in at each place, or one of n + 1 less each of its symbols."""
    size = len(symbols)
    if size == n - 1:
        place = np.arange(n)
        at = place[None, :] - (place[None, :] > place[:, None])
        return np.where(place[None, :] == place[:, None], LOST, symbols[np.minimum(at, size - 1)])
    if size == n + 1:
        return symbols[np.arange(n)[None, :] + (np.arange(n)[None, :] >= np.arange(n + 1)[:, None])]
    return np.zeros((0, n), np.int64)


class Reception:
    """One stream's state. ``feed`` takes a chunk of slots, ``close`` tells that the input ends; each gives the message when it can first be read.

    ``eager`` tries after every slot, also of a pass in progress.
    """

    def __init__(self, eager: bool = False):
        self.eager = eager
        self.kept: deque[Pass] = deque(maxlen=C.MAX_PASSES)
        self.symbols, self.weights = np.zeros(0, np.int64), np.zeros(0)
        self.starts = self.after_end = False
        self.attempts = 0
        self.vain: int | None = None  # words tried in vain of the passes as they still are
        self.message: Message | None = None

    def feed(self, cls, reliability, is_break=None) -> Message | None:
        return answered([self.feeding(cls, reliability, is_break)])[0]

    def close(self) -> Message | None:
        return answered([self.closing()])[0]

    def feeding(self, cls, reliability, is_break=None) -> Asking:
        """cls: symbols or control classes, LOST where a slot was not read."""
        cls, reliability = np.asarray(cls, np.int64), np.asarray(reliability, float)
        broken = np.zeros(len(cls), bool) if is_break is None else np.asarray(is_break, bool)
        weight = np.where(cls == LOST, 0.0, np.maximum(C.RELIABILITY_FLOOR, reliability))
        cuts = np.flatnonzero(broken | (cls == C.START) | (cls == C.END)).tolist()
        for a, b in zip([-1, *cuts], [*cuts, len(cls)], strict=True):
            own = slice(a + 1, b)
            for part in ([slice(k, k + 1) for k in range(a + 1, b)] if self.eager else [own]):
                self._more(cls[part], weight[part])
                if self.eager and (found := (yield from self._try())):
                    return found
            if b == len(cls):
                return None
            if broken[b]:
                self._ends(False, False, False)
                continue
            self._ends(cls[b] == C.END, cls[b] == C.START, cls[b] == C.END)
            if found := (yield from self._try()):
                return found
        return None

    def closing(self) -> Asking:
        return (yield from self._try())

    def _more(self, symbols: np.ndarray, weights: np.ndarray) -> None:
        if len(symbols) and self.starts:
            self.vain = None
        self.symbols, self.weights = np.append(self.symbols, symbols), np.append(self.weights, weights)
        over = len(self.symbols) // (C.MAX_PASS_LEN + 1) * (C.MAX_PASS_LEN + 1)
        if over:  # no pass is that long: what came before the overflow goes, and the anchor with it
            self.symbols, self.weights = self.symbols[over:], self.weights[over:]
            self.starts = self.after_end = False
            self.vain = None

    def _ends(self, ends: bool, starts: bool, after_end: bool) -> None:
        """The pass in progress is over; another begins."""
        if len(self.symbols) and (self.starts or ends):
            self.vain = None
            self.kept.append(Pass(self.symbols, self.weights, self.starts, self.after_end, bool(ends)))
        self.symbols, self.weights = np.zeros(0, np.int64), np.zeros(0)
        self.starts, self.after_end = bool(starts), bool(after_end)

    def usable(self) -> list[Pass]:
        live = [Pass(self.symbols, self.weights, True, False, False)] if self.starts and len(self.symbols) else []
        return [*self.kept, *live]

    def lengths(self) -> list[int]:
        """Codeword lengths by support, the best first; of equal ones that which was spoken for first."""
        support: dict[int, float] = {}
        for p in self.usable():
            size, offers = len(p.symbols), []
            if p.whole:
                offers += [(size + far, w) for far, w in sorted(AROUND.items(), key=lambda x: (x[0] != 0, x[0]))]
            elif p.after_end and p.ends:
                offers += [(size - 1, 1.5 if p.symbols[0] == LOST else 1.0), (size, 1.0)]
            if p.starts and 0 <= p.symbols[0] <= C.MAX_PAYLOAD:
                offers.append((codeword_length(int(p.symbols[0])), 1 + float(p.weights[0])))
            for n, w in offers:
                if n in PAYLOAD_OF:
                    support[n] = support.get(n, 0.0) + w
        return sorted(support, key=lambda n: -support[n])

    def votes(self, n: int) -> Votes:
        votes, askew = Votes(n), []
        for p in self.usable():
            size = len(p.symbols)
            if p.whole and size != n:
                askew += [p] if abs(size - n) <= C.MISALIGNED_TOLERANCE else []
            elif p.whole or size <= n + C.OPEN_PASS_SLACK:
                votes.add(np.arange(size) + (0 if p.starts else n - size), p.symbols, p.weights)
        agreed, _ = votes.leaders()
        if (agreed != LOST).any():
            for p in askew:
                own, at = alignment(p.symbols, agreed)
                votes.add(at, p.symbols[own], C.MISALIGNED_WEIGHT * p.weights[own])
        return votes

    def _try(self) -> Asking:
        if self.message:
            return None
        if self.vain is not None:  # nothing that counts was heard since
            self.attempts += self.vain
            return None
        before = self.attempts
        for n in self.lengths()[:TOP_LENGTHS]:
            word, lead = self.votes(n).leaders()
            shifted = [(one_mended, p.symbols, n) for p in self.usable()[::-1] if p.whole]
            for tries, symbols, more in [(erasing_weakest, word, lead), *shifted]:
                words = tries(symbols.astype(np.int16), more)
                found = (yield words) if len(words) else None
                self.attempts += found[0] + 1 if found else len(words)
                if found:
                    self.message = Message(found[1], found[2], len(self.kept) + self.starts, n, self.attempts)
                    return self.message
        self.vain = self.attempts - before
        return None
