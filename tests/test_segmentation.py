"""Frames to slots: against a machine that looks at one frame at a time, and by hand."""

import numpy as np
import pytest

from quillstream import constants as C
from quillstream.operators.segmentation import Segmentation, Tally

NO = C.NONE


def shown(symbols, step=40, on=7, off=2):
    """t, gap, cls, p of symbols that are shown one after the other, without any fault."""
    n = len(symbols) * (on + off)
    k = np.arange(n) % (on + off)
    gap = k >= on
    return np.arange(n) * float(step), gap, np.where(gap, NO, np.repeat(symbols, on + off)), np.ones(n)


def slots(t, gap, cls, p, sizes=(10**9,), timing=True):
    """All slots, fed in chunks of the given sizes, over and over."""
    m, out, a, k = Segmentation(timing), [], 0, 0
    while a < len(t):
        b = a + sizes[k % len(sizes)]
        out += m.feed(t[a:b], gap[a:b], cls[a:b], p[a:b])
        a, k = b, k + 1
    return out + m.close()


def noisy(seed, n=3000):
    r = np.random.default_rng(seed)
    t = np.cumsum(r.choice([20.0, 40.0, 60.0, 700.0], n, p=[0.3, 0.5, 0.19, 0.01]))
    cls = np.repeat(r.choice([3, 4, 5, C.START, C.END], n // 6 + 1), 6)[:n]
    cls = np.where(r.random(n) < 0.15, r.choice([3, 4, 5, NO], n), cls)
    return t, r.random(n) < 0.12, cls, np.round(r.random(n), 2)


def split_by_frames(t, gap, cls, p):
    """Pieces (list of frame numbers), by the rule as it is written: the last three readable frames agree, and what stood before them was read otherwise as often."""
    out, open_ = [], []
    for k in range(len(t)):
        if gap[k]:
            out.append(open_)
            open_ = []
            continue
        open_ = [*open_, k]
        readable = [i for i in open_ if cls[i] != NO]
        last = readable[-C.SPLIT_RUN :]
        if len(last) == C.SPLIT_RUN and len({cls[i] for i in last}) == 1:
            before = [i for i in open_ if i < last[0]]
            weight = {}
            for i in before:
                if cls[i] != NO:
                    weight[cls[i]] = weight.get(cls[i], 0) + p[i]
            best = next((c for c in weight if weight[c] == max(weight.values()) > 0), None)
            seen = sum(cls[i] == best for i in before)
            if best is not None and best != cls[last[0]] and seen >= C.SPLIT_RUN:
                out.append(before)
                open_ = [i for i in open_ if i >= last[0]]
    return [x for x in [*out, open_] if x]


@pytest.mark.parametrize("seed", range(12))
def test_pieces_against_a_frame_at_a_time(seed, monkeypatch):
    t, gap, cls, p = noisy(seed)
    found = []
    monkeypatch.setattr(Segmentation, "_piece", lambda self, piece, frame: found.append(piece) or [] if piece.frames else [])
    slots(t, gap, cls, p, (7, 1, 30))
    want = split_by_frames(t, gap, cls, p)
    assert [(x.frames, x.first, x.last) for x in found] == [(len(w), t[w[0]], t[w[-1]]) for w in want]
    for x, w in zip(found, want, strict=True):
        assert x.seen == {c: int((cls[w] == c).sum()) for c in dict.fromkeys(cls[w].tolist()) if c != NO}


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("sizes", [(1,), (2, 13), (100,)])
def test_chunks_do_not_matter(seed, sizes):
    whole, parts = slots(*noisy(seed)), slots(*noisy(seed), sizes)
    assert [s[:2] + s[4:] for s in whole] == [s[:2] + s[4:] for s in parts]
    assert np.allclose([s[2:4] for s in whole], [s[2:4] for s in parts])
    assert [s.index for s in whole] == list(range(len(whole)))


def test_a_clean_showing():
    symbols = np.arange(30) * 8
    got = slots(*shown(symbols))
    assert [s.cls for s in got] == symbols.tolist()
    assert {(s.frames, s.accepted, s.share) for s in got} == {(7, 7, 1.0)}
    assert all(s.reliability == pytest.approx(1 - 0.5**7) and s.t_end - s.t_start == 7 * 40 for s in got)


def test_symbols_that_run_into_each_other():
    symbols = np.array([9, 8, 7, 6, 5, 4, 3, 2, 1, 0])
    t, gap, cls, p = shown(symbols)
    gap[4 * 9 : 6 * 9 - 2] = False  # no gap after the fifth
    assert [s.cls for s in slots(t, gap, cls, p)] == symbols.tolist()


def test_equal_symbols_that_run_into_each_other_leave_a_copy():
    symbols = np.array([*range(20), 20, 20, 21, 22])
    t, gap, cls, p = shown(symbols)
    gap[20 * 9 + 7 : 21 * 9] = False
    got = slots(t, gap, cls, p)
    assert [s.cls for s in got] == symbols.tolist()
    assert got[21].synthetic and got[21].reliability == pytest.approx(0.6 * got[20].reliability)
    assert [s.cls for s in slots(t, gap, cls, p, timing=False)] == [*range(21), 21, 22]


def test_a_torn_symbol_is_one_slot():
    symbols = np.arange(15)
    t, gap, cls, p = shown(symbols)
    gap[10 * 9 + 3] = True
    got = slots(t, gap, cls, p)
    assert [s.cls for s in got] == symbols.tolist() and got[10].frames == 6


def test_missed_symbols_and_silence():
    symbols = np.arange(40)
    t, gap, cls, p = shown(symbols)
    gap[12 * 9 : 14 * 9] = True
    t[25 * 9 :] += 20 * 9 * 40
    got = slots(t, gap, cls, p)
    assert [s.cls for s in got] == [*range(12), None, None, *range(14, 25), None, *range(25, 40)]
    assert [s.is_break for s in got].index(True) == 25 and sum(s.is_break for s in got) == 1
    assert (got[25].t_start, got[25].t_end) == (got[24].t_end, got[26].t_start)
    assert got[12].t_start == got[11].t_start + 360 and got[13].t_start == got[11].t_start + 720


def test_little_evidence():
    m = Segmentation()
    assert m.feed([0.0, 40.0], [False, True], [NO, NO], [1, 1]) == [] == m.close()  # one frame of nothing
    one = slots(np.arange(3) * 40.0, np.array([False, False, True]), np.array([C.END, NO, NO]), np.ones(3))
    assert [s.cls for s in one] == [None] and one[0].accepted == 1  # a control symbol needs two frames
    assert slots(*shown(np.array([C.END])))[0].cls == C.END
    assert slots(np.zeros(0), np.zeros(0, bool), np.zeros(0, int), np.zeros(0)) == []


def test_the_first_seen_wins_a_tie():
    x = Tally()
    for cls in (5, 2, 2, 5):
        x.add(1, 0.0, 0.0, cls, 1, 0.5)
    assert x.winner() == 5
    y = Tally()
    y.add(1, 0.0, 0.0, 2, 1, 0.5)
    assert y.joined(x).winner() == 2
