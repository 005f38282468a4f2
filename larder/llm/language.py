"""Language of a text by a convolutional network over bytes.

A text is cut into windows of WINDOW bytes; a byte has an embedding of
EMBEDDING numbers, filters of several widths run over the window, each
filter's largest answer (cut off below zero) is kept, and a softmax layer
turns those into probabilities.  A text's prediction comes from the mean
log-probabilities of all its windows, weighted by their length.

The network is trained in numpy on a bounded sample: SAMPLE documents a
language, those of lowest hash of doc_id, and of each at most WINDOWS windows
at regular places (documented parameters; prediction covers every byte of
every row).  For prediction the embedding and the filters are folded into one
table of filter answers a pair of bytes, so a window costs look-ups and
additions.

Null texts and texts without a letter are ``und`` with score 0.  Learning
uses rows with a label, a doc_id and a letter only; rows that repeat a
doc_id and label count once (any one of them, by the bytes of its windows).
With no such row every text is ``und``.  Each row is predicted by its text
alone, so repeated rows agree; other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spark import extend_batches, fresh, map_batches
from .text import slices, utf8

WINDOW = 256
EMBEDDING = 8
WIDTHS = (2, 3, 4)
FILTERS = 16
SAMPLE = 400
WINDOWS = 6
EPOCHS = 6
UNKNOWN = "und"
#: Windows that are looked up at a time, so that the answers stay in the processor's cache.
LOT = 64
PAD = max(WIDTHS) - 1


def cut(data: np.ndarray, offsets: np.ndarray):
    """All windows (rows of WINDOW bytes, zero beyond the text), the bytes in each, and each document's offset among them."""
    length = np.diff(offsets)
    each = -(-length // WINDOW)
    at = np.concatenate(([0], np.cumsum(each)))
    doc = np.repeat(np.arange(len(length)), each)
    start = (np.arange(at[-1]) - at[doc]) * WINDOW
    held = np.minimum(length[doc] - start, WINDOW)
    place = (offsets[doc] - offsets[0] + start)[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < held[:, None]
    padded = np.concatenate((data, np.zeros(WINDOW, np.uint8)))
    return np.where(inside, padded[np.minimum(place, len(data))], np.uint8(0)), held, at


class ByteNetwork:
    """Embedding, filters of several widths, largest answers, softmax."""

    def __init__(self, classes: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.embedding[0] = 0  # beyond the text
        self.filters = [rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.filter_bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes)).astype(np.float32)
        self.out_bias = np.zeros(classes, np.float32)

    def parameters(self):
        return [self.embedding, *self.filters, self.filter_bias, self.out, self.out_bias]

    # ------------------------------------------------------------ training

    def _forward(self, windows: np.ndarray):
        """Largest answers and where they lie, from the embedded bytes."""
        n = len(windows)
        padded = np.concatenate((windows, np.zeros((n, PAD), np.uint8)), axis=1)
        embedded = self.embedding[padded]
        best, places = [], []
        for w, kernel in zip(WIDTHS, self.filters, strict=True):
            seen = np.concatenate([embedded[:, k: k + WINDOW] for k in range(w)], axis=2)
            answer = seen @ kernel
            place = answer.argmax(axis=1)
            places.append(place)
            best.append(np.take_along_axis(answer, place[:, None, :], axis=1)[:, 0])
        return padded, np.maximum(np.concatenate(best, axis=1) + self.filter_bias, 0), places

    def _gradients(self, windows: np.ndarray, labels: np.ndarray):
        padded, hidden, places = self._forward(windows)
        rows = np.arange(len(labels))
        error = softmax(hidden @ self.out + self.out_bias)
        error[rows, labels] -= 1
        error /= len(labels)
        back = (error @ self.out.T) * (hidden > 0)
        d_embedding = np.zeros_like(self.embedding)
        d_filters = []
        for j, (w, kernel) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            part, place = back[:, j * FILTERS: (j + 1) * FILTERS], places[j]
            seen = np.stack([padded[rows[:, None], place + k] for k in range(w)], axis=2)  # bytes under each largest answer
            d_filters.append(np.einsum("nf,nfe->ef", part, self.embedding[seen].reshape(len(rows), FILTERS, -1)))
            each = (part[:, :, None] * kernel.T).reshape(-1, EMBEDDING)
            flat = seen.reshape(-1)
            for e in range(EMBEDDING):
                d_embedding[:, e] += np.bincount(flat, each[:, e], 256)
        d_embedding[0] = 0
        return [d_embedding, *d_filters, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 3) -> None:
        """Adam over shuffled batches."""
        rng = np.random.default_rng(seed)
        mean = [np.zeros_like(p) for p in self.parameters()]
        square = [np.zeros_like(p) for p in self.parameters()]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for first in range(0, len(order), batch):
                pick, step = order[first: first + batch], step + 1
                for p, g, m, s in zip(self.parameters(), self._gradients(windows[pick], labels[pick]), mean, square, strict=True):
                    m += np.float32(0.1) * (g.astype(np.float32) - m)
                    s += np.float32(0.001) * (g.astype(np.float32) ** 2 - s)
                    p -= np.float32(rate) * (m / np.float32(1 - 0.9 ** step)) / (np.sqrt(s / np.float32(1 - 0.999 ** step)) + np.float32(1e-8))

    # ---------------------------------------------------------- prediction

    def folded(self) -> list[tuple[int, int, np.ndarray]]:
        """Tables (offset, first filter, answers) over byte pairs whose sum at each place is the convolution."""
        width = len(WIDTHS) * FILTERS
        tables = []
        for offset in range(0, max(WIDTHS), 2):
            table = np.zeros((256, 256, width), np.float32)
            for j, (w, kernel) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                own = slice(j * FILTERS, (j + 1) * FILTERS)
                if offset < w:
                    table[:, :, own] += (self.embedding @ kernel[offset * EMBEDDING: (offset + 1) * EMBEDDING])[:, None, :]
                if offset + 1 < w:
                    table[:, :, own] += (self.embedding @ kernel[(offset + 1) * EMBEDDING: (offset + 2) * EMBEDDING])[None, :, :]
            used = sum(w <= offset for w in WIDTHS) * FILTERS  # narrower filters end before this offset
            tables.append((offset, used, np.ascontiguousarray(table.reshape(65536, width)[:, used:])))
        return tables


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def log_probabilities(windows: np.ndarray, tables, filter_bias, out, out_bias) -> np.ndarray:
    """Of each window and class."""
    made = [np.zeros((0, len(out_bias)), np.float32)]
    for first in range(0, len(windows), LOT):
        part = windows[first: first + LOT].astype(np.uint16)
        padded = np.concatenate((part, np.zeros((len(part), PAD + 1), np.uint16)), axis=1)
        pairs = padded[:, :-1] * np.uint16(256) + padded[:, 1:]
        answer = None
        for offset, used, table in tables:
            got = table.take(pairs[:, offset: offset + WINDOW], axis=0)
            if answer is None:
                answer = got
            else:
                answer[:, :, used:] += got
        hidden = np.maximum(answer.max(axis=1) + filter_bias, 0)
        made.append(np.log(np.maximum(softmax(hidden @ out + out_bias), 1e-9)))
    return np.concatenate(made)


class LanguageModel:
    """The languages, in order, and the network's tables."""

    def __init__(self, languages: list[str], network: ByteNetwork | None):
        self.languages = languages
        if network is not None:
            self.tables = network.folded()
            self.rest = network.filter_bias, network.out, network.out_bias

    def predict(self, column) -> tuple[list[str], np.ndarray]:
        """Language and probability of each text of a string column."""
        data, offsets = utf8(column)
        names, scores = [], []
        for first, last in slices(offsets):
            windows, held, at = cut(data[offsets[first]: offsets[last]], offsets[first: last + 1])
            each = log_probabilities(windows, self.tables, *self.rest) * held[:, None]
            total = np.concatenate((np.zeros((1, len(self.languages))), np.cumsum(each, axis=0, dtype=np.float64)))
            size = np.maximum(np.diff(offsets[first: last + 1]), 1)
            chance = softmax((total[at[1:]] - total[at[:-1]]) / size[:, None])
            best = chance.argmax(axis=1)
            names.extend(self.languages[k] for k in best)
            scores.append(chance[np.arange(len(best)), best])
        return names, np.concatenate(scores) if scores else np.zeros(0)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32(doc_id as text) mod 4 is 2; such rows never teach the network."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: str = "text"):
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def sample(docs: DataFrame, size: int = SAMPLE, windows: int = WINDOWS) -> DataFrame:
    """``(lang, windows)`` of at most ``size`` documents a language: a bounded table."""
    able = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where("doc_id is not null and lang is not null")
    able = able.where(~held_out() & has_letter())
    known = able.select("lang", "doc_id").distinct()
    share = known.groupBy("lang").agg((F.lit(2.0 * size) / F.count(F.lit(1))).alias("share"))  # one row a language
    hashed = F.xxhash64("doc_id")
    near = known.join(share, "lang").where(F.pmod(hashed, F.lit(1 << 40)) < F.col("share") * float(1 << 40))
    low = Window.partitionBy("lang").orderBy(F.pmod(hashed, F.lit(1 << 40)), "doc_id")  # about 2 * size rows a language
    chosen = near.withColumn("n", F.row_number().over(low)).where(F.col("n") <= size).select("lang", "doc_id")

    def taken(batch):
        field = batch.schema.get_field_index
        data, offsets = utf8(batch.column(field("text")))
        got = []
        for d in range(len(offsets) - 1):
            rows, _, _ = cut(data[offsets[d]: offsets[d + 1]], offsets[d: d + 2])
            got.append(rows[np.unique(np.linspace(0, len(rows) - 1, windows).astype(int))].tobytes())
        return {"lang": batch.column(field("lang")), "doc_id": batch.column(field("doc_id")), "windows": got}

    picked = able.join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi")  # at most ``size`` ids a language
    return (map_batches(picked, taken, "lang string, doc_id long, windows binary")
            .groupBy("lang", "doc_id").agg(F.min("windows").alias("windows")).select("lang", "doc_id", "windows"))


def train(docs: DataFrame, size: int = SAMPLE, windows: int = WINDOWS, epochs: int = EPOCHS) -> LanguageModel:
    """The network fitted on the sample, which is at most ``size * windows`` windows a language."""
    rows = sorted(map(tuple, sample(docs, size, windows).collect()))  # independent of task order
    languages = sorted({r[0] for r in rows})
    if not languages:
        return LanguageModel([], None)
    seen = [np.frombuffer(bytes(r[2]), np.uint8).reshape(-1, WINDOW) for r in rows]
    labels = np.repeat([languages.index(r[0]) for r in rows], [len(x) for x in seen])
    network = ByteNetwork(len(languages))
    network.fit(np.concatenate(seen), labels, epochs)
    return LanguageModel(languages, network)


def predicted(docs: DataFrame, model: LanguageModel) -> tuple[DataFrame, tuple[str, str]]:
    """``docs`` with the predicted language and its probability; returns (frame, names of those columns)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two tables of 65,536 byte pairs
    name, score, letter = fresh(docs, "lang_pred"), fresh(docs, "lang_score"), fresh(docs, "has_letter")

    def run(batch):
        known, column = sent.value, batch.schema.get_field_index
        if known.languages:
            names, scores = known.predict(batch.column(column("text")))
            spoken = batch.column(column(letter)).to_pylist()
            names = [x if yes else UNKNOWN for x, yes in zip(names, spoken, strict=True)]
            scores = np.where(spoken, scores, 0.0)
        else:
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
        return {name: pa.array(names, pa.string()), score: pa.array(scores, pa.float64())}

    out = extend_batches(docs.withColumn(letter, has_letter()), run, f"`{name}` string, `{score}` double")
    return out.drop(letter), (name, score)
