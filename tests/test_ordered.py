"""Machines of many keys: searches made together, keys of a stream held in groups."""

import numpy as np
import pyarrow as pa

from quillstream import constants as C
from quillstream.functions import reed_solomon as R
from quillstream.operators import reception
from quillstream.operators.ordered import Waiting
from quillstream.operators.reception import LOST, Reception, answered


def shown(payload):
    word = R.encode(payload)
    passes = [[LOST if (i + 4 * no) % 9 == 5 else x ^ 33 if not no and i % 13 == 7 else x for i, x in enumerate(word)] for no in (0, 1)]
    return np.array([x for p in passes for x in (C.START, *p, C.END)])


def test_searches_of_many_streams_are_made_together(monkeypatch):
    streams = [shown(bytes([k] * (10 + 3 * k))) for k in range(40)]
    alone = [Reception().feed(s, np.full(len(s), 0.9)) for s in streams]
    calls = []
    whole = reception.first_messages
    monkeypatch.setattr(reception, "first_messages", lambda x: calls.append(len(x)) or whole(x))
    assert answered([Reception().feeding(s, np.full(len(s), 0.9)) for s in streams]) == alone
    assert [m.payload for m in alone] == [bytes([k] * (10 + 3 * k)) for k in range(40)]
    assert len(calls) < 20 and max(calls) == 40


def test_what_failed_is_not_tried_again_before_more_is_heard(monkeypatch):
    word = R.encode(b"seldom read")
    bad = [LOST if i % 3 == 1 else x for i, x in enumerate(word)]
    calls = []
    whole = reception.first_messages
    monkeypatch.setattr(reception, "first_messages", lambda x: calls.append(len(x)) or whole(x))
    m = Reception()
    stream = np.array([C.START, *bad, C.END])
    assert m.feed(stream, np.full(len(stream), 0.9)) is None
    once, tried = sum(calls), m.attempts
    assert m.feed(np.array([C.START]), np.ones(1)) is None and m.close() is None
    assert sum(calls) == once and m.attempts == 3 * tried
    good = np.array([*word, C.END])
    assert m.feed(good, np.full(len(good), 0.9)).payload == b"seldom read"


class Listing:
    """Gives back what it is fed, and how many rows that was."""

    def __init__(self):
        self.n = 0

    def feed(self, c):
        self.n += len(c["v"])
        return [(int(v),) for v in c["v"]]

    def close(self):
        return [(-self.n,)]


def test_keys_of_a_group_wait_are_fed_in_order_and_go():
    r = np.random.default_rng(8)
    how = (["src", "id"], ["v"], "_ms", Listing, 50)
    rows = [(f"s{k % 3}", k if k else None, v, v + 1) for k in range(25) for v in range(0, 100 - 2 * k, 7)]
    r.shuffle(rows)
    held, out = Waiting(*how), []
    for watermark, part in [(0, [x for x in rows if x[3] <= 60]), (58, [x for x in rows if x[3] > 60]), (98, []), (120, [])]:
        new = pa.table([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["src", "id", "v", "_ms"]) if part else None
        out += held.step(new, watermark)
        held = Waiting.restored(held.state(), *how)
    assert any(x[2] < 0 for x in out) and held.own  # some are over, others not
    out += held.step(None, 10**6)
    assert not held.own and held.rows is None
    for k in range(25):
        own = [v for v in range(0, 100 - 2 * k, 7)]
        assert [x[2] for x in out if x[:2] == (f"s{k % 3}", k if k else None)] == [*own, -len(own)]


def test_a_key_with_new_rows_is_not_over():
    held = Waiting(["id"], ["v"], "_ms", Listing, 10)
    rows = lambda *v: pa.table({"id": pa.array([1] * len(v), pa.int64()), "v": list(v), "_ms": list(v)})
    assert held.step(rows(3, 1), 0) == []
    assert held.step(rows(40), 20) == [(1, 1), (1, 3)]
    assert held.step(None, 45) == [(1, 40)]
    assert held.step(None, 51) == [(1, -3)] and not held.own
