"""Importance resampling of documents towards a target distribution.

A document's features are its runs of 1 to ``max_n`` words, counted with
repeats in ``buckets`` buckets by crc32.  Each bucket's gain is the scaled
logarithm of its smoothed share in the target texts over that in all
documents, and a document's weight is the floored mean gain of its features:
the gains are one array and a text is scored by looking its buckets up in it.
Weight plus Gumbel noise drawn from a hash of the doc_id gives the score, and
the documents of the highest scores are the sample without replacement.
Their exact ranks come from parallel sorting by regular sampling
(``order.ranked``).

Counts and noise cover all rows; nothing is sampled or capped.  Null texts
have no words and weight 0; rows with fewer than ``min_words`` words are
scored but never drawn.  Rows that repeat a doc_id have the same noise and
are ranked one by one; rows alike in score, doc_id and features follow one
another.  A null doc_id is hashed as an empty one and loses ties.  Empty
documents or an empty target give zero counts, which the smoothing allows.
Other columns pass through.
"""

from __future__ import annotations

import gc
import math
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import ranked
from .spark import arrow_schema, extend_batches, fresh, stored
from .text import ALNUM, LOWER, slices, utf8, words

BUCKETS = 10_000
MIN_WORDS = 20
SEED = 2024
LONG_WORD = 64
#: Fixed value: the reversed polynomial of crc32.
POLYNOMIAL = 0xEDB88320


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(POLYNOMIAL) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


_TABLE = _crc_table()


def extended(register: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each crc register after the bytes [start, end) of ``data``; all spans go one byte at a time together."""
    out, length = register.copy(), ends - starts
    for k in np.flatnonzero(length > LONG_WORD):  # a few spans would make the others wait
        whole = zlib.crc32(data[starts[k]: ends[k]].tobytes(), int(out[k]) ^ 0xFFFFFFFF)
        out[k] = whole ^ 0xFFFFFFFF
    length = np.where(length > LONG_WORD, 0, length)
    order = np.argsort(-length, kind="stable")
    at, held = starts[order], out[order]
    longer = len(order) - np.searchsorted(np.sort(length), np.arange(int(length.max(initial=0))), "right")
    for k, n in enumerate(longer):
        held[:n] = _TABLE[(held[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (held[:n] >> np.uint32(8))
    out[order] = held
    return out


def features(column, max_n: int = 1, buckets: int = BUCKETS):
    """Per document: its number of words and the buckets of its features."""
    data, offsets = utf8(column)
    for first, last in slices(offsets):
        part = LOWER[data[offsets[first]: offsets[last]]]
        starts, ends, at = words(part, offsets[first: last + 1] - offsets[first], ALNUM)
        register = np.full(len(starts), 0xFFFFFFFF, np.uint32)
        grams = []
        for n in range(max_n):
            if n:  # the run one word longer: a space and the next word follow
                register = register[:-1]
                register = _TABLE[(register ^ np.uint32(32)) & np.uint32(255)] ^ (register >> np.uint32(8))
            register = extended(register, part, starts[n:], ends[n:])
            grams.append(((register ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64))
        for d in range(last - first):
            a, b = int(at[d]), int(at[d + 1])
            yield b - a, (grams[0][a:b] if max_n == 1 else np.concatenate([g[a: max(b - n, a)] for n, g in enumerate(grams)]))


def bucket_counts(docs: DataFrame, max_n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows; every task sends one row a bucket at most."""
    schema = arrow_schema("bucket int, n long")

    def run(batches):
        gc.collect()
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found in features(batch.column(0), max_n, buckets):
                total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], schema=schema)

    out = np.zeros(buckets, np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / source share)) of each bucket, shares smoothed by one."""
    size, s_all, t_all = len(source), float(source.sum()) + len(source), float(target.sum()) + len(source)
    return np.array([math.floor(1000 * math.log((float(target[k]) + 1) * s_all / ((float(source[k]) + 1) * t_all))) for k in range(size)],
                    dtype=np.int64)


def noise(doc_id, seed: int = SEED) -> int:
    """The scaled Gumbel draw of a document."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, max_n: int = 1, seed: int = SEED) -> tuple[DataFrame, tuple[str, str, str, str]]:
    """``docs`` with words, features, weight and score; returns (frame, names of those columns)."""
    names = tuple(fresh(docs, x) for x in ("n_words", "n_features", "weight", "score"))
    buckets = len(gain)

    def run(batch):
        column = batch.schema.get_field_index
        rows = [(n, len(found), int(gain[found].sum()) // len(found) if len(found) else 0)
                for n, found in features(batch.column(column("text")), max_n, buckets)]
        n_words, n_features, weight = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        drawn = np.array([noise(x, seed) for x in batch.column(column("doc_id")).to_pylist()], np.int64)
        return dict(zip(names, (n_words, n_features, weight, weight + drawn), strict=True))

    return extend_batches(docs, run, ", ".join(f"`{x}` long" for x in names)), names


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, max_n: int = 1, buckets: int = BUCKETS,
              min_words: int = MIN_WORDS, seed: int = SEED, drop: tuple[str, ...] = ()) -> tuple[DataFrame, tuple[str, str, str, str, str]]:
    """Every row of ``docs`` with words, features, weight, score and rank (null: not drawn).

    Returns (frame, names of those columns); a filter on the rank gives the
    sample.  ``drop`` names columns that are not wanted in the result, so
    that a long text need not be stored with its score.
    """
    gain = gains(bucket_counts(docs, max_n, buckets), bucket_counts(target, max_n, buckets))
    out, names = scored(docs, gain, max_n, seed)
    words_, features_, _, score = names
    row, rank = fresh(out, "row"), fresh(out, "rank")
    out = stored(out.drop(*drop).withColumn(row, F.monotonically_increasing_id()))
    able = out.where(F.col(f"`{words_}`") >= min_words)
    doc_id = F.col("doc_id").cast("long")
    keys = able.select((-F.col(f"`{score}`")).alias("a"), doc_id.isNull().cast("long").alias("b"), F.coalesce(doc_id, F.lit(0)).alias("c"),
                       (-F.col(f"`{features_}`")).alias("d"), F.col(f"`{row}`").alias("e"))
    ranks = ranked(keys, ["a", "b", "c", "d", "e"], able.count() * percent // 100)
    ranks = ranks.select(F.col("row").alias(row), F.col("rank").alias(rank))
    return out.join(ranks, row, "left").drop(row), (*names, rank)
