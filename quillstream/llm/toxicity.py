"""Toxicity by non-negative positive-unlabelled learning (operator 3).

Features are the distinct words of a text and the first bytes of its words, hashed. The classifier is linear in them and
is trained with numpy from confirmed toxic documents and unlabelled text: the risk is

    prior * R(positive, +1) + max(0, R(unlabelled, -1) - prior * R(positive, -1))

where the second part, the risk on negatives, may not fall below zero, so the model cannot fit the positives that are
hidden among the unlabelled (Kiryo et al., 2017). The class prior is the toxic share of the labelled training rows.

Labels are learnt only from rows whose crc32(doc_id as text) mod 3 is not 1. A model of remainder 0 scores remainder 2
and the other way round; these scores set the scale, so that 0.7 is the cut of best F1 among them. The model in use is
trained on both. Training reads bounded samples of each remainder, taken in the order of a hash of the ids:
``POSITIVES``, ``UNLABELLED`` and ``CALIBRATION`` rows at most. Every document is scored, whole,
in one narrow pass; the weights (``SLOTS`` floats) are all that is broadcast.

A null or empty text has no features and gets the lowest score there is, as has any text without a feature of toxic
text. Without any confirmed positive, all scores are 0. Repeated rows get equal scores; extra columns are ignored, or
carried by ``accepted``. A label row without its document, or with a null label, is not used; a document labelled
twice counts as toxic if either label says so. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import ALNUM, lowered, mixed, prefix_sums, slice_hash, steps, words

POSITIVES, UNLABELLED, CALIBRATION = 2_000, 5_000, 5_000
SLOTS = 1 << 20
PREFIXES = (4, 5, 6)
#: A feature is used if this many training positives have it, and this share of them, and this many times as often as the rest.
LEAST_POSITIVES, LEAST_SHARE, LEAST_RATIO = 3, 0.01, 12.0
EPOCHS, RATE, DECAY = 200, 0.05, 1e-4
CUT = 0.7


def features(data: np.ndarray, offsets: np.ndarray, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of the distinct features, by text; only those of ``used`` if it is given."""
    low = lowered(data)
    starts, ends, by_text = words(low, offsets, ALNUM)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = prefix_sums(low)
    text = np.repeat(np.arange(len(by_text) - 1), np.diff(by_text))
    keys = []
    for size in (0, *PREFIXES):
        at = np.flatnonzero(ends - starts > size) if size else np.arange(len(starts))
        slot = (mixed(slice_hash(sums, starts[at], starts[at] + size if size else ends[at]) + np.uint64(size)) & np.uint64(SLOTS - 1)).astype(np.int64)
        owner = text[at]
        if used is not None:
            hit = used[slot]
            slot, owner = slot[hit], owner[hit]
        keys.append(owner * SLOTS + slot)
    key = np.unique(np.concatenate(keys))
    return key // SLOTS, key % SLOTS


@dataclass
class Rows:
    """Sparse rows of 0 and 1."""

    column: np.ndarray
    start: np.ndarray  # n + 1

    @property
    def n(self) -> int:
        return len(self.start) - 1

    def dot(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(w[self.column])])
        return total[self.start[1:]] - total[self.start[:-1]]

    def gradient(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.column, np.repeat(g, np.diff(self.start)), size)

    def only(self, place: np.ndarray) -> Rows:
        """With the columns for which place is not negative, renumbered."""
        to = place[self.column]
        kept = np.concatenate([[0], np.cumsum(to >= 0)])
        return Rows(to[to >= 0], kept[self.start])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def risk(w: np.ndarray, positive: Rows, unlabelled: Rows, prior: float) -> tuple[float, np.ndarray, bool]:
    """(value, gradient, whether the part on negatives is below zero) of the non-negative PU risk under the sigmoid loss; w: weights and, last, the bias.

    loss(z, +1) = sigmoid(-z), loss(z, -1) = sigmoid(z). Where the part on negatives falls below zero, the gradient is that of
    its negative, which leads back, and not that of the value.
    """
    zp, zu = positive.dot(w[:-1]) + w[-1], unlabelled.dot(w[:-1]) + w[-1]
    sp, su = _sigmoid(zp), _sigmoid(zu)
    dp, du = sp * (1 - sp) / positive.n, su * (1 - su) / unlabelled.n
    negative = su.mean() - prior * sp.mean()
    below = bool(negative < 0)
    gp, gu = (prior * dp, -du) if below else (-2 * prior * dp, du)
    size = len(w) - 1
    g = np.append(positive.gradient(gp, size) + unlabelled.gradient(gu, size), gp.sum() + gu.sum())
    return prior * (1 - sp).mean() + max(0.0, negative), g, below


def nonnegative_pu(positive: Rows, unlabelled: Rows, prior: float, size: int) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative PU risk, by Adam over all rows.

    All features were chosen as signs of toxic text, so no weight may fall below zero.
    """
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = -1.0
    for step in range(1, EPOCHS + 1):
        _, g, _ = risk(w, positive, unlabelled, prior)
        g[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        np.maximum(w[:-1], 0, out=w[:-1])
    return w[:-1], float(w[-1])


def scale(z: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """(slope, cut): sigmoid(slope * (z - cut) + logit(CUT)) reaches CUT at the cut of best F1."""
    if not toxic.any() or toxic.all():
        return 1.0, float(z.max() + 1 if len(z) and not toxic.any() else 0.0)
    order = np.argsort(-z, kind="stable")
    s, y = z[order], toxic[order].astype(np.int64)
    hit = np.cumsum(y)
    f1 = np.where(np.append(s[1:] < s[:-1], True), 2 * hit / (np.arange(1, len(s) + 1) + y.sum()), -1.0)
    k = int(f1.argmax())
    cut = (s[k] + (s[k + 1] if k + 1 < len(s) else s[k] - 1)) / 2
    spread = float(np.mean(np.abs(z - cut)))
    return 3.0 / max(spread, 1e-6), float(cut)


@dataclass
class Model:
    used: np.ndarray  # bool by slot
    weight: np.ndarray  # float by slot
    bias: float
    slope: float
    cut: float

    def raw(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        text, slot = features(data, offsets, self.used)
        return np.bincount(text, self.weight[slot], len(offsets) - 1) + self.bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * (self.raw(data, offsets) - self.cut) + np.log(CUT / (1 - CUT)))


def remainder(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3))


def _sample(docs: DataFrame, ids: DataFrame, n: int, used: np.ndarray | None = None) -> tuple[Rows, np.ndarray]:
    """Features (those of ``used``, if it is given) and labels of at most n of the ids. The ids are few, so they are broadcast and the texts stay where they are."""
    few = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    wanted = docs.sparkSession.sparkContext.broadcast(used)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in steps(batches):
            text, slot = features(data, offsets, wanted.value)
            cuts = np.searchsorted(text, np.arange(rows.num_rows + 1))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("toxic"), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(slot, pa.int32()))], names=["doc_id", "toxic", "slots"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    taken = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", "toxic", "text")
    rows = taken.mapInArrow(run, f"doc_id {kind}, toxic int, slots array<int>").toArrow().combine_chunks()
    rows = rows.take(pa.array(np.argsort(rows.column("doc_id").to_numpy(), kind="stable")))  # whatever the order of the tasks
    slots = rows.column("slots").combine_chunks()
    slots = slots.combine_chunks() if isinstance(slots, pa.ChunkedArray) else slots
    lengths = slots.value_lengths().to_numpy() if len(slots) else np.zeros(0, np.int64)
    return Rows(slots.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])), rows.column("toxic").to_numpy()


def _fitted(positive: Rows, unlabelled: Rows, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(used, weight, bias) over all slots."""
    p = np.bincount(positive.column, minlength=SLOTS)
    rate = p / positive.n
    rest = np.maximum(np.bincount(unlabelled.column, minlength=SLOTS) / unlabelled.n - prior * rate, 0) / (1 - prior)
    used = (p >= min(LEAST_POSITIVES, positive.n)) & (rate >= LEAST_SHARE) & (rate >= LEAST_RATIO * (rest + 1 / unlabelled.n))
    place = np.where(used, np.cumsum(used) - 1, -1)
    w, bias = nonnegative_pu(positive.only(place), unlabelled.only(place), prior, int(used.sum()))
    weight = np.zeros(SLOTS)
    weight[used] = w
    return used, weight, bias


def _joined(parts: list[Rows]) -> Rows:
    return Rows(np.concatenate([p.column for p in parts]), np.concatenate([[0], *(p.start[1:] + sum(len(q.column) for q in parts[:k]) for k, p in enumerate(parts))]))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """None without a confirmed positive to train from."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("fold", remainder()).where("fold <> 1")
    n, toxic = known.agg(F.count("*"), F.sum("toxic")).first()
    if not toxic:
        return None
    prior = min(max(toxic / n, 1e-3), 0.9)
    folds, z, truth = (0, 2), [], []
    positive = [_sample(docs, known.where(f"fold = {fold} AND toxic = 1").select("doc_id", "toxic"), POSITIVES)[0] for fold in folds]
    if not sum(p.n for p in positive):
        return None
    # No other feature can be used by any of the models.
    least = min([LEAST_POSITIVES, *(p.n for p in positive if p.n)])
    used = np.bincount(np.concatenate([p.column for p in positive]), minlength=SLOTS) >= least
    unlabelled = [_sample(docs, docs.select("doc_id").where(remainder() == fold).distinct().withColumn("toxic", F.lit(0)), UNLABELLED, used)[0] for fold in folds]
    for k, fold in enumerate(folds):
        held, y = _sample(docs, known.where(f"fold = {fold}").select("doc_id", "toxic"), CALIBRATION, used)
        if positive[1 - k].n and held.n:
            _, weight, bias = _fitted(positive[1 - k], unlabelled[1 - k], prior)
            z.append(held.only(np.where(weight != 0, np.arange(SLOTS), -1)).dot(weight) + bias)
            truth.append(y)
    used, weight, bias = _fitted(_joined(positive), _joined(unlabelled), prior)
    slope, cut = scale(np.concatenate(z), np.concatenate(truth) > 0) if z else (1.0, 0.0)
    return Model(used, weight.astype(np.float32), bias, slope, cut)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for rows, data, offsets in steps(batches):
            score = own.scores(data, offsets) if own else np.zeros(rows.num_rows)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic; decided where they are read."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for rows, data, offsets in steps(batches):
            yield rows.filter(pa.array(own.scores(data, offsets) < CUT)) if own else rows

    return docs.mapInArrow(run, docs.schema)
