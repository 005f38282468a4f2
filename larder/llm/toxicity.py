"""Toxicity scores from a factorization machine over hashed terms.

Terms are the distinct words of a text (letters, digits and non-ASCII
characters, ASCII lower-cased), hashed to 2**BITS slots.  The model has a
bias, a weight per slot and FACTORS latent factors per slot, so a pair of
terms (an insult and the group it is aimed at, say) can weigh more than its
parts.  It is fitted with Adagrad on a bounded sample of labelled rows: at
most SAMPLE toxic and 2 * SAMPLE other rows, those of lowest hash of doc_id
(a documented bound; scoring covers every row).  The model knows every slot of
the sample: a term may matter only together with another one, so none is left
out for being as frequent in toxic texts as in others.

The score of a text uses its words alone.  Null and empty texts get the
model's base score; rows that repeat a doc_id are scored one by one; labels
that repeat a doc_id count once, toxic if any row says so; labels that are
null or belong to no document are not used; with no usable labels every
score is 0.  Other columns of the documents pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import extend_batches, fresh, map_batches
from .text import ALNUM, LOWER, prefix_hashes, slices, span_hashes, utf8, words

BITS = 18
FACTORS = 4
SAMPLE = 8_000
EPOCHS = 12


def terms(column, bits: int = BITS, selected: np.ndarray | None = None):
    """Per document: its sorted distinct term slots (of the selected ones)."""
    data, offsets = utf8(column)
    for first, last in slices(offsets):
        part = LOWER[data[offsets[first]: offsets[last]]]
        starts, ends, at = words(part, offsets[first: last + 1] - offsets[first], ALNUM)
        slot = (span_hashes(prefix_hashes(part), starts, ends) >> np.uint64(64 - bits)).astype(np.int32)
        if selected is not None:
            keep = np.flatnonzero(selected[slot])
            slot, at = slot[keep], np.searchsorted(keep, at)
        for d in range(last - first):
            yield np.unique(slot[at[d]: at[d + 1]])


class FactorizationMachine:
    """Second-order factorization machine on binary features, logistic loss."""

    def __init__(self, slots: np.ndarray, factors: int = FACTORS, seed: int = 7):
        self.slots = slots  # sorted slots that the model knows
        self.bias = 0.0
        self.weight = np.zeros(len(slots))
        self.factor = np.random.default_rng(seed).normal(0, 0.05, (len(slots), factors))

    def _sums(self, index, offsets):
        """Linear sums, factor sums and squared factor sums of each row."""
        def by_row(x):
            total = np.zeros((len(x) + 1, *x.shape[1:]))
            np.cumsum(x, axis=0, out=total[1:])
            return total[offsets[1:]] - total[offsets[:-1]]
        v = self.factor[index]
        return by_row(self.weight[index]), by_row(v), by_row(v * v)

    def raw(self, index, offsets) -> np.ndarray:
        linear, s, q = self._sums(index, offsets)
        return self.bias + linear + 0.5 * (s * s - q).sum(axis=1)

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 256,
            rate: float = 0.1, penalty: float = 1e-4, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        rate_of = np.clip(labels.mean(), 1e-3, 1 - 1e-3) if len(labels) else 0.5
        self.bias = float(np.log(rate_of / (1 - rate_of)))
        gw, gv, gb = np.full(len(self.slots), 1e-6), np.full(self.factor.shape, 1e-6), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for first in range(0, len(order), batch):
                pick = order[first: first + batch]
                offsets = np.concatenate(([0], np.cumsum([len(rows[i]) for i in pick])))
                index = np.concatenate([rows[i] for i in pick])
                linear, s, q = self._sums(index, offsets)
                y = self.bias + linear + 0.5 * (s * s - q).sum(axis=1)
                error = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[pick]) / len(pick)
                each = np.repeat(error, np.diff(offsets))
                dw = np.bincount(index, each, len(self.slots)) + penalty * self.weight
                dv = np.zeros_like(self.factor)
                whole = np.repeat(s, np.diff(offsets), axis=0) - self.factor[index]
                for k in range(dv.shape[1]):
                    dv[:, k] = np.bincount(index, each * whole[:, k], len(self.slots))
                dv += penalty * self.factor
                gw += dw * dw
                gv += dv * dv
                gb += error.sum() ** 2
                self.weight -= rate * dw / np.sqrt(gw)
                self.factor -= rate * 0.3 * dv / np.sqrt(gv)
                self.bias -= rate * 0.1 * float(error.sum()) / np.sqrt(gb)

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(int)
        flat = np.concatenate(rows) if rows else np.zeros(0, int)
        return 1 / (1 + np.exp(-np.clip(self.raw(np.searchsorted(self.slots, flat), offsets), -30, 30)))


def held_out(doc_id="doc_id"):
    """Whether crc32(doc_id as text) mod 5 is 0; such rows never teach the model."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS):
    """The fitted model; reads labels only of rows that are not held out."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id is not null and toxic is not null")
             .where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    near = F.xxhash64("doc_id")
    chosen = (known.where("toxic = 1").orderBy(near, "doc_id").limit(sample)
              .unionByName(known.where("toxic = 0").orderBy(near, "doc_id").limit(2 * sample)))

    def features(batch):
        name = batch.schema.get_field_index
        return {"toxic": batch.column(name("toxic")), "slots": [t.astype(np.int32).tobytes() for t in terms(batch.column(name("text")), bits)]}

    # at most 3 * sample ids: their size is bounded by the parameter
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    got = map_batches(picked.select("toxic", "text"), features, "toxic int, slots binary").toArrow()
    rows = [np.frombuffer(x, np.int32) for x in got.column("slots").to_pylist()]
    y = np.array(got.column("toxic").to_pylist(), dtype=float)
    order = sorted(range(len(rows)), key=lambda i: (y[i], rows[i].tobytes()))  # independent of task order
    rows, y = [rows[i] for i in order], y[order] if len(order) else y
    slots = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.int32)  # at most 2**bits
    model = FactorizationMachine(slots)
    if len(rows):
        model.fit([np.searchsorted(slots, r) for r in rows], y)
    else:
        model.bias = -30.0
    return model


def scored(docs: DataFrame, model: FactorizationMachine, bits: int = BITS) -> tuple[DataFrame, str]:
    """``docs`` with a score column; returns (frame, name of that column)."""
    sent = docs.sparkSession.sparkContext.broadcast((model.slots, model.bias, model.weight, model.factor))  # at most 2**bits slots
    name = fresh(docs, "toxic_score")
    made: list = []

    def run(batch):
        if not made:
            slots, bias, weight, factor = sent.value
            known = FactorizationMachine(slots)
            known.bias, known.weight, known.factor = bias, weight, factor
            selected = np.zeros(1 << bits, dtype=bool)
            selected[slots] = True
            made.extend([known, selected])
        rows = list(terms(batch.column(batch.schema.get_field_index("text")), bits, made[1]))
        return {name: pa.array(made[0].score(rows), pa.float64())}

    return extend_batches(docs, run, f"`{name}` double"), name


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, unchanged."""
    out, name = scored(docs, train(docs, labels))
    return out.where(F.col(f"`{name}`") < threshold).select(*(f"`{c}`" for c in docs.columns))
