"""Searches over many words at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quillstream.functions import reed_solomon as R
from quillstream.operators.reception import erasing_weakest, one_mended
from quillstream.plans import exact


class Words:
    """A table of one batch, as far as a search looks at it."""

    sparkSession = None

    def __init__(self, batch):
        self.batch = batch

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return pa.Table.from_batches(run(iter([self.batch])))


WORD = np.array(R.encode(bytes(188)), np.int32)


@pytest.mark.parametrize(
    "count, word, tries, more, of",
    [(600, WORD[1:], one_mended, "n", len(WORD)), (3000, WORD, erasing_weakest, "margin", [0.5] * len(WORD))],
)
def test_a_batch_of_words_does_not_hold_the_tries_of_all(monkeypatch, count, word, tries, more, of):
    monkeypatch.setattr(exact, "ship", lambda _: None)
    short = R.encode(b"short")
    words = [word.tolist()] * count + [short]
    keys = {"src": ["x"] * (count + 1), "id": list(range(count + 1)), "turn": [0] * (count + 1)}
    last = len(short) if more == "n" else [0.5] * len(short)
    batch = pa.RecordBatch.from_pydict(keys | {"word": pa.array(words, pa.list_(pa.int32())), more: [of] * count + [last]})
    tracemalloc.start()
    found = exact._searched(Words(batch), tries, more).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found["id"] == list(range(count + 1))
    assert found["text"] == [bytes(188).decode()] * count + [None if more == "n" else "short"]
    assert peak < 80e6


def test_steps_take_every_word_once():
    lengths = np.random.default_rng(3).integers(0, 256, 5000)
    steps = exact.steps_of_tries(lengths)
    assert sorted(np.concatenate(steps).tolist()) == list(range(5000))
    assert max(((lengths[s] + 2) ** 2).sum() for s in steps) < exact.TRIED + 258**2
    assert exact.steps_of_tries(np.zeros(0, np.int64)) == []


class Stream(Words):
    """A table of many batches, of which none is kept; what it gives is counted and goes."""

    def __init__(self, batches):
        self.batches = batches

    def mapInArrow(self, run, _):
        return sum(x.column("text").null_count == 0 and x.num_rows for x in run(self.batches))


def test_a_search_does_not_take_more_memory_for_more_batches(monkeypatch):
    monkeypatch.setattr(exact, "ship", lambda _: None)
    word, margin = WORD.tolist(), [0.5] * len(WORD)

    def batch(k):
        keys = {"src": ["x"] * 300, "id": list(range(300 * k, 300 * k + 300)), "turn": [0] * 300}
        return pa.RecordBatch.from_pydict(keys | {"word": pa.array([word] * 300, pa.list_(pa.int32())), "margin": [margin] * 300})

    def peak(count):
        before = pa.total_allocated_bytes()
        arrow = []
        tracemalloc.start()
        assert exact._searched(Stream(arrow.append(pa.total_allocated_bytes() - before) or batch(k) for k in range(count)), erasing_weakest, "margin") == 300 * count
        own = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return own, max(arrow)

    peak(1)
    (once, _), (twice, held), (often, held_often) = peak(1), peak(2), peak(8)
    assert often < 1.2 * max(once, twice) and held_often < 1.2 * held
