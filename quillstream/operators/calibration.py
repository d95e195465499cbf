"""What class a slot should show, when classes are shown in a fixed order from an unknown one."""

from __future__ import annotations

from collections import deque

import numpy as np

from ..constants import ANCHOR_WINDOW, CAL_CLASSES


class Calibration:
    """Slots (slot_no, i, cls; -1 where not read) to (slot_no, i, got, expected).

    The offset of a readable slot is its class less its number; the commonest of the last ANCHOR_WINDOW, if any occurs twice,
    tells what to expect, until the next readable slot tells anew. Of equally common ones the earliest in the window counts.
    """

    def __init__(self):
        self.window: deque[int] = deque(maxlen=ANCHOR_WINDOW)
        self.anchor: int | None = None

    def feed(self, c: dict[str, np.ndarray]) -> list[tuple]:
        out = []
        for slot, i, cls in zip(c["slot_no"].tolist(), c["i"].tolist(), c["cls"].tolist(), strict=True):
            if cls >= 0:
                self.window.append((cls - i) % CAL_CLASSES)
                counts = {x: self.window.count(x) for x in dict.fromkeys(self.window)}
                most = max(counts, key=counts.__getitem__)
                self.anchor = most if counts[most] > 1 else None
            if self.anchor is not None:
                out.append((slot, i, None if cls < 0 else cls, (self.anchor + i) % CAL_CLASSES))
        return out

    def close(self) -> list[tuple]:
        return []
