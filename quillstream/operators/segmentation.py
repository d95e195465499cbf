"""Frames of one stream to slots, with repair by the clock.

Frames come in order, in chunks of any size, as arrays. A chunk is cut into runs (frames up to the next readable frame
of another class, or a gap), and only runs, not frames, go through the recurrent rules:

* a run of ``SPLIT_RUN`` readable frames ends the piece before it if that piece was read as another class, as often;
* a piece that begins too soon after the slot in hand, and reads like it, is more of the same slot;
* a slot that begins late leaves erasures, copies of an overlong slot before it, or a break.

What is held between chunks is bounded: tallies of at most two pieces, and three short rings of intervals. A stream may
thus be of any length, and go without a gap for as long as it likes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from .. import constants as C

SLOT_COLUMNS = "slot_index bigint, cls int, share double, reliability double, accepted int, frames int, t_start double, t_end double, synthetic boolean, is_break boolean"


class Slot(NamedTuple):
    index: int
    cls: int | None
    share: float
    reliability: float
    accepted: int
    frames: int
    t_start: float
    t_end: float
    synthetic: bool = False
    is_break: bool = False


class Tally:
    """Frames of a piece: how many, between which times, and the weight and number of each readable class, by first sight."""

    __slots__ = ("frames", "first", "last", "weight", "seen")

    def __init__(self):
        self.frames, self.first, self.last = 0, 0.0, 0.0
        self.weight: dict[int, float] = {}
        self.seen: dict[int, int] = {}

    def add(self, frames: int, first: float, last: float, cls: int = C.NONE, seen: int = 0, weight: float = 0.0) -> None:
        self.first = self.first if self.frames else first
        self.frames, self.last = self.frames + frames, last
        if seen:
            self.weight[cls] = self.weight.get(cls, 0.0) + weight
            self.seen[cls] = self.seen.get(cls, 0) + seen

    def joined(self, other: Tally) -> Tally:
        out = Tally()
        for part in (self, other):
            out.add(part.frames, part.first, part.last)
            for cls, n in part.seen.items():
                out.add(0, part.first, part.last, cls, n, part.weight[cls])
        return out

    def winner(self) -> int | None:
        """The class of greatest weight, the first seen on ties; control symbols need enough frames."""
        total = max(self.weight.values(), default=0.0)
        if total <= 0:
            return None
        cls = next(c for c, w in self.weight.items() if w == total)
        return None if cls in (C.START, C.END) and self.seen[cls] < C.MIN_CONTROL_FRAMES else cls

    def read(self, frame: float) -> Slot | None:
        """The slot of these frames; ``frame`` is how long one is shown. A lone frame that tells nothing is noise."""
        cls = self.winner()
        if cls is None and self.frames < C.MIN_FRAMES_ERASURE:
            return None
        share = 0.0 if cls is None else self.weight[cls] / sum(self.weight.values())
        sure = 0.0 if cls is None else share * (1 - 0.5 ** self.seen[cls])
        return Slot(-1, cls, share, sure, sum(self.seen.values()), self.frames, self.first, self.last + frame)


def middle(values: list[float]) -> float:
    """The median; of so few numbers, faster than numpy's."""
    x, n = sorted(values), len(values)
    return x[n // 2] if n & 1 else (x[n // 2 - 1] + x[n // 2]) / 2


class Ring:
    """The last values of a series, and their median once there are enough."""

    __slots__ = ("values", "size", "known")

    def __init__(self, size: int):
        self.values: list[float] = []
        self.size = size
        self.known: float | None = None

    def extend(self, more: list[float]) -> None:
        self.values, self.known = (self.values + more)[-self.size :], None

    def middle(self, least: int, otherwise: float) -> float:
        if len(self.values) < least:
            return otherwise
        if self.known is None:
            self.known = middle(self.values)
        return self.known

    def admit(self, x: float) -> None:
        """Takes a value, unless it is far above the median that there already is."""
        if x < 1.5 * self.middle(C.MIN_STATS, np.inf):
            self.extend([x])


class Segmentation:
    """One stream's state. ``feed`` gives the slots that a chunk of frames completes, ``close`` what is left at the end."""

    def __init__(self, timing: bool = True):
        self.timing = timing
        self.clock: float | None = None  # time of the last frame
        self.steps = Ring(C.DT_WINDOW)
        self.head = Tally()  # the open piece up to the run in progress
        self.run = Tally()  # the run in progress: one readable class, and the frames among and after it that tell nothing
        self.periods, self.durations = Ring(C.STATS_WINDOW), Ring(C.STATS_WINDOW)
        self.hand: tuple[Slot, Tally] | None = None  # the last slot, which may still grow
        self.before: Slot | None = None  # the slot given out last
        self.count = 0

    # -- frames to pieces

    def feed(self, t, gap, cls, p) -> list[Slot]:
        """t: times; gap: whether a frame shows a gap; cls: classes, C.NONE where there is none; p: weights."""
        t, gap, cls, p = np.asarray(t, float), np.asarray(gap, bool), np.asarray(cls, np.int64), np.asarray(p, float)
        if not len(t):
            return []
        delta = np.diff(t, prepend=t[0] if self.clock is None else self.clock)
        fine = (delta > 0) & (delta < C.DT_MAX_MS)
        steps = self.steps.values + delta[fine].tolist()
        upto = (len(self.steps.values) + np.cumsum(fine)).tolist()  # intervals known at each frame
        self.clock = float(t[-1])

        def frame_time(k: int) -> float:
            known = steps[max(0, upto[k] - C.DT_WINDOW) : upto[k]]
            return middle(known) if known else float(C.DT_DEFAULT_MS)

        out: list[Slot] = []
        times = t.tolist()
        for a, b, kind in self._runs(gap, cls):
            if gap[a]:
                out += self._piece(self._whole(), frame_time(a))
                self.head, self.run = Tally(), Tally()
                continue
            readable = np.flatnonzero(cls[a:b] != C.NONE) + a
            known = next(iter(self.run.seen), None)
            if kind != C.NONE and known is not None and kind != known:
                self.head, self.run = self._whole(), Tally()
            had = self.run.seen.get(kind, 0)
            if kind == C.NONE and known is None:
                self.head.add(b - a, times[a], times[b - 1])
                continue
            self.run.add(b - a, times[a], times[b - 1], kind, len(readable), float(p[readable].sum()))
            if had < C.SPLIT_RUN <= had + len(readable):
                other = self.head.winner()
                if other is not None and other != kind and self.head.seen[other] >= C.SPLIT_RUN:
                    out += self._piece(self.head, frame_time(int(readable[C.SPLIT_RUN - 1 - had])))
                    self.head = Tally()
        self.steps.extend(delta[fine].tolist())
        return out

    @staticmethod
    def _runs(gap: np.ndarray, cls: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first, last + 1, class) of stretches that are one gap frame, or hold one readable class at most and begin with it if they hold any."""
        marks = np.flatnonzero(gap | (cls != C.NONE))
        key = np.where(gap[marks], -1 - marks, cls[marks])  # every gap frame is a stretch of its own
        new = np.ones(len(marks), bool)
        new[1:] = key[1:] != key[:-1]
        starts = marks[new]
        if len(gap) and (not len(starts) or starts[0] > 0):
            yield 0, int(starts[0]) if len(starts) else len(gap), C.NONE
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(gap)], strict=False):
            if gap[a]:
                yield a, a + 1, C.NONE
                if b > a + 1:
                    yield a + 1, b, C.NONE
            else:
                yield a, b, int(cls[a])

    def _whole(self) -> Tally:
        return self.head.joined(self.run) if self.run.frames else self.head

    # -- pieces to slots

    def _piece(self, piece: Tally, frame: float) -> list[Slot]:
        slot = piece.read(frame) if piece.frames else None
        if slot is None:
            return []
        period = self.periods.middle(C.MIN_STATS, 0.0)
        if self.hand and slot.t_start - self.hand[0].t_start < C.MERGE_PERIODS * period and (None in (slot.cls, self.hand[0].cls) or slot.cls == self.hand[0].cls):
            both = self.hand[1].joined(piece)
            self.hand = both.read(frame) or self.hand[0], both
            return []
        done, self.hand = self.hand, (slot, piece)
        return self._given(done[0]) if done else []

    def close(self) -> list[Slot]:
        """The input ends: the open piece, and the slot in hand."""
        out = self._piece(self._whole(), self.steps.middle(1, float(C.DT_DEFAULT_MS)))
        self.head, self.run = Tally(), Tally()
        done, self.hand = self.hand, None
        return out + (self._given(done[0]) if done else [])

    def _given(self, slot: Slot) -> list[Slot]:
        late = slot.t_start - self.before.t_start if self.before else 0.0
        rows = [*self._filled(slot, late), slot] if self.timing and self.before else [slot]
        if self.timing and late > 0:
            self.periods.admit(late)
        if slot.cls is not None and slot.accepted >= 2:
            self.durations.admit(slot.t_end - slot.t_start)
        self.before = slot
        first, self.count = self.count, self.count + len(rows)
        return [s._replace(index=first + k) for k, s in enumerate(rows)]

    def _filled(self, slot: Slot, late: float) -> list[Slot]:
        """What the clock says stood between the slot before and this one."""
        period, old = self.periods.middle(C.MIN_STATS, 0.0), self.before
        if not period:
            return []
        if late > C.BREAK_PERIODS * period:
            return [Slot(-1, None, 0.0, 0.0, 0, 0, old.t_end, slot.t_start, True, True)]
        usual = self.durations.middle(C.MIN_STATS, 0.0)
        spare = (old.t_end - old.t_start - usual) / period if usual and old.cls is not None else 0.0
        copy, lost = (old.cls, old.share, C.COPY_RELIABILITY * old.reliability), (None, 0.0, 0.0)
        places = range(1, int(late / period + 0.5))
        return [Slot(-1, *(copy if k <= int(spare + 0.5) else lost), 0, 0, old.t_start + k * period, old.t_start + k * period, True) for k in places]
