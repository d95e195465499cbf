"""Slots to messages: framing of passes, votes, searches."""

import random

import numpy as np
import pytest

from quillstream import constants as C
from quillstream.functions import reed_solomon as R
from quillstream.operators.reception import LOST, Reception, Votes, alignment, erasing_weakest, one_mended


def passes(word, times=2):
    return [x for _ in range(times) for x in (C.START, *word, C.END)]


def heard(stream, chunk=10**9, weights=None, eager=False):
    m = Reception(eager)
    w = np.full(len(stream), 0.9) if weights is None else weights
    for a in range(0, len(stream), chunk):
        if found := m.feed(np.array(stream[a : a + chunk]), w[a : a + chunk]):
            return found
    return m.close()


TEXTS = [b"\x00", b"quill", "añil 雨".encode(), bytes(range(188))]


@pytest.mark.parametrize("payload", TEXTS)
@pytest.mark.parametrize("chunk", [1, 5, 10**9])
@pytest.mark.parametrize("eager", [False, True])
def test_a_clean_pass_is_read(payload, chunk, eager):
    got = heard(passes(R.encode(payload)), chunk, eager=eager)
    assert (got.payload, got.n) == (payload, R.codeword_length(len(payload)))
    assert eager or got.corrected == 0  # an eager receiver reads it before all of it is there


@pytest.mark.parametrize("payload", TEXTS[1:])
def test_two_bad_passes_make_one_good(payload):
    r = random.Random(len(payload))
    word = R.encode(payload)
    stream = []
    for _ in range(3):
        own = list(word)
        for p in r.sample(range(1, len(word)), len(word) // 4):
            own[p] = LOST if r.random() < 0.6 else r.randrange(256)
        stream += [C.START, *own, C.END]
    assert heard(stream).payload == payload


def test_joined_in_the_middle():
    word = R.encode(b"from the middle on")
    half = len(word) // 2
    assert heard([*word[half:], C.END, C.START, *word[: half + 2]]).payload == b"from the middle on"


@pytest.mark.parametrize("change", [lambda w: w[:4] + w[5:], lambda w: [*w[:9], w[8], *w[9:]]])
def test_a_symbol_too_few_or_too_many(change):
    word = R.encode(b"one symbol off")
    assert heard([C.START, *change(word), C.END]).payload == b"one symbol off"


def test_noise_is_no_message():
    r = np.random.default_rng(77)
    kinds = r.choice([C.START, C.END, LOST, 0], 4000, p=[0.01, 0.02, 0.07, 0.9])
    stream = np.where(kinds == 0, r.integers(0, 256, 4000), kinds)
    m = Reception()
    assert m.feed(stream, np.full(4000, 0.8)) is None and m.close() is None and len(m.kept) <= C.MAX_PASSES


def test_a_break_ends_a_pass_and_one_too_long_loses_its_anchor():
    word = R.encode(b"broken off")
    m = Reception()
    stream = np.array([C.START, *word[:6], LOST, *word[6:], C.END])
    m.feed(stream, np.full(len(stream), 0.9), stream == -2)
    assert [len(p.symbols) for p in m.kept] == [len(word) + 1]
    m = Reception()
    m.feed(stream, np.full(len(stream), 0.9), np.arange(len(stream)) == 7)
    assert [(len(p.symbols), p.whole) for p in m.kept] == [(6, False), (len(word) - 6, False)]
    m = Reception()
    m.feed([C.START, *[1] * (C.MAX_PASS_LEN + 4)], np.ones(C.MAX_PASS_LEN + 5))
    assert len(m.symbols) == 3 and not m.starts and not m.usable()


def brute_votes(cast):
    boxes = {}
    for pos, sym, w in cast:
        boxes.setdefault(pos, {}).setdefault(sym, 0.0)
        boxes[pos][sym] += w
    return boxes


@pytest.mark.parametrize("seed", range(8))
def test_leaders(seed):
    r = np.random.default_rng(seed)
    pos, sym, w = r.integers(-1, 6, 60), r.integers(-1, 4, 60), r.integers(0, 3, 60) / 2
    v = Votes(5)
    for a in range(0, 60, 13):
        v.add(pos[a : a + 13], sym[a : a + 13], w[a : a + 13])
    word, lead = v.leaders()
    boxes = brute_votes([x for x in zip(pos.tolist(), sym.tolist(), w.tolist(), strict=True) if 0 <= x[0] < 5 and x[1] >= 0])
    for p in range(5):
        best = max(boxes.get(p, {}).values(), default=0)
        if best <= 0:
            assert (word[p], lead[p]) == (LOST, 0)
            continue
        assert word[p] == next(s for s, x in boxes[p].items() if x == best)
        rest = sorted([*boxes[p].values(), 0])[-2] if len(boxes[p]) > 1 else 0
        assert lead[p] == pytest.approx(best - rest)


def brute_score(a, b):
    s = np.zeros((len(a) + 1, len(b) + 1), int)
    s[0], s[:, 0] = C.ALIGN_GAP * np.arange(len(b) + 1), C.ALIGN_GAP * np.arange(len(a) + 1)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            pair = 0 if LOST in (x, y) else C.ALIGN_MATCH if x == y else C.ALIGN_MISMATCH
            s[i, j] = max(s[i - 1, j - 1] + pair, s[i - 1, j] + C.ALIGN_GAP, s[i, j - 1] + C.ALIGN_GAP)
    return s[-1, -1]


@pytest.mark.parametrize("seed", range(25))
def test_alignment_reaches_the_best_score(seed):
    r = np.random.default_rng(seed)
    a, b = r.integers(-1, 4, r.integers(0, 9)), r.integers(-1, 4, r.integers(0, 9))
    i, j = alignment(a, b)
    assert (np.diff(i) > 0).all() and (np.diff(j) > 0).all()
    pairs = sum(0 if LOST in (a[x], b[y]) else C.ALIGN_MATCH if a[x] == b[y] else C.ALIGN_MISMATCH for x, y in zip(i, j, strict=True))
    assert pairs + C.ALIGN_GAP * (len(a) + len(b) - 2 * len(i)) == brute_score(a, b)


def test_searches_list_their_tries_in_order():
    word = np.array(R.encode(b"abcdefgh"))
    tries = erasing_weakest(word, np.arange(len(word))[::-1].astype(float))
    assert [np.flatnonzero(t == LOST).tolist() for t in tries] == [[], [13, 14], [11, 12, 13, 14]]
    assert len(erasing_weakest(np.full(len(word), LOST), np.zeros(len(word)))) == 0
    fewer = one_mended(np.delete(word, 3), len(word))
    assert fewer.shape == (15, 15) and [int(np.flatnonzero(t == LOST)[0]) for t in fewer] == list(range(15))
    assert all((np.delete(t, k) == np.delete(word, 3)).all() for k, t in enumerate(fewer))
    more = one_mended(np.insert(word, 3, 99), len(word))
    assert more.shape == (16, 15) and (more[3] == word).all()
    assert len(one_mended(word, len(word))) == 0
    assert R.first_message(fewer[3:])[:2] == (0, b"abcdefgh") == R.first_message(more[3:])[:2]


def one_by_one(w):
    try:
        payload, fixed = R.decode_message([None if x < 0 else int(x) for x in w])
        return payload, len(fixed)
    except R.DecodeError:
        return None


@pytest.mark.parametrize("length", [0, 1, 9, 77, 188])
def test_many_words_decode_as_one_does(length):
    r = random.Random(length)
    rows = []
    for _ in range(60):
        w = R.encode(bytes(r.randrange(256) for _ in range(length)))
        room = len(w) - length - 3
        gone = r.randrange(room + 2)
        for p in r.sample(range(len(w)), min(len(w), gone)):
            w[p] = LOST
        for p in r.sample(range(len(w)), min(len(w), r.randrange(max(1, (room - gone) // 2 + 2)))):
            w[p] = w[p] if w[p] == LOST else w[p] ^ r.randrange(1, 256)
        rows.append(np.array(w))
    want = [one_by_one(w) for w in rows]
    assert R.messages([*rows, np.array([1, 2, 3])]) == [*want, None]
    assert 10 < sum(x is not None for x in want)
