"""Exact ranks by parallel sorting by regular sampling.

Every task sorts its rows in runs of at most RUN rows.  Each run gives
SAMPLES rows at regular places, and regular places of the sorted samples give
the splitters.  The runs are cut at the splitters, the pieces of one range
are exchanged and merged in one task, and the ranges' counts before a range
give its first rank.  A range that came out larger than LIMIT rows is cut
again by the same rule among its own pieces, until none is; keys never tie
(they end in the row number), so this always ends.

What reaches the driver are the samples, SAMPLES keys a run, and one count a
range.  Rows travel as packed pieces of at most CHUNK rows.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import arrow_schema, map_batches, stored

RUN = 1 << 20
SAMPLES = 64
TARGET = 1 << 18
LIMIT = 1 << 21
CHUNK = 1 << 14


def _sorted(keys: np.ndarray) -> np.ndarray:
    """Rows of an int64 table in ascending order, the first column leading."""
    return keys[np.lexsort(keys.T[::-1])]


def _unpacked(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(-1, width)


def _regular(n: int, wanted: int) -> np.ndarray:
    """At most ``wanted`` regular places among n."""
    wanted = min(n, wanted)
    return (np.arange(wanted) * n + n // 2) // max(wanted, 1)


def _places(keys: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """For each splitter, how many of the sorted keys are not above it."""
    low, high = np.zeros(len(splitters), np.int64), np.full(len(splitters), len(keys), np.int64)
    while (low < high).any():
        middle = np.minimum((low + high) // 2, len(keys) - 1)
        above = np.zeros(len(splitters), bool)
        level = np.ones(len(splitters), bool)
        for k in range(keys.shape[1]):
            above |= level & (keys[middle, k] > splitters[:, k])
            level &= keys[middle, k] == splitters[:, k]
        going = low < high
        high = np.where(going & above, middle, high)
        low = np.where(going & ~above, middle + 1, low)
    return low


def _runs(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Sorted runs in pieces: (range, n, sample, data); all in range 0."""
    ddl = "range long, n long, sample binary, data binary"
    schema = arrow_schema(ddl)

    def pieces(held):
        keys = _sorted(np.concatenate(held))
        chosen = keys[_regular(len(keys), SAMPLES)].tobytes()
        for first in range(0, len(keys), CHUNK):
            part = keys[first: first + CHUNK]
            yield pa.RecordBatch.from_pylist([{"range": 0, "n": len(part), "sample": b"" if first else chosen, "data": part.tobytes()}], schema=schema)

    def run(batches):
        gc.collect()
        held, n = [], 0
        for batch in batches:
            keys = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(columns))])
            for first in range(0, len(keys), RUN):
                held.append(keys[first: first + RUN])
                n += len(held[-1])
                if n >= RUN:
                    yield from pieces(held)
                    held, n = [], 0
        if n:
            yield from pieces(held)

    return rows.select(*columns).mapInArrow(run, ddl)


def _splitters(samples: list[bytes], width: int, ranges: int) -> np.ndarray:
    taken = [_unpacked(x, width) for x in samples if x]
    if not taken:
        return np.zeros((0, width), np.int64)
    keys = _sorted(np.concatenate(taken))
    places = np.unique(np.arange(1, ranges) * len(keys) // ranges)
    return keys[places[places < len(keys)]]


def _cut(pieces: DataFrame, splitters: dict[int, np.ndarray], first: dict[int, int], width: int) -> DataFrame:
    """Pieces cut at the splitters of their range; the new ranges of range r start at number ``first[r]``."""
    def run(batch):
        got = {"range": [], "n": [], "sample": [], "data": []}
        for number, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            keys = _unpacked(data.as_py(), width)
            at = np.concatenate(([0], _places(keys, splitters[number]), [len(keys)]))
            for k in np.flatnonzero(np.diff(at)):
                part = keys[at[k]: at[k + 1]]
                got["range"].append(first[number] + int(k))
                got["n"].append(len(part))
                got["sample"].append(part[_regular(len(part), SAMPLES)].tobytes() if len(part) > SAMPLES else part.tobytes())
                got["data"].append(part.tobytes())
        return got

    return map_batches(pieces.select("range", "data"), run, "range long, n long, sample binary, data binary")


def _counts(pieces: DataFrame) -> dict[int, int]:
    """Rows of each range: one entry a range."""
    return {r["range"]: r["n"] for r in pieces.groupBy("range").agg(F.sum("n").alias("n")).collect()}


def ranked(rows: DataFrame, columns: list[str], wanted: int | None = None) -> DataFrame:
    """``(row, rank)`` of the ``wanted`` first rows (all of them if None): ranks 1, 2, 3 ... in ascending order.

    ``columns`` are long columns without nulls; the last one is unique and
    comes back as ``row``.  ``rows`` should be a stored table.
    """
    width = len(columns)
    pieces = stored(_runs(rows, columns))
    counts = _counts(pieces)
    order = sorted(counts)
    total = sum(counts.values())
    wants = dict.fromkeys(order, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TARGET))
    while wants:
        cuts, first, number = {}, {}, 0
        for r in order:  # ranges keep their order; one that is cut makes room for its parts
            found = pieces.where(F.col("range") == r).select("sample").collect() if r in wants else []
            cuts[r], first[r] = _splitters([x[0] for x in found], width, wants.get(r, 1)), number
            number += len(cuts[r]) + 1
        pieces = stored(_cut(pieces, cuts, first, width))
        counts = _counts(pieces)
        order = sorted(counts)
        wants = {r: -(-counts[r] // TARGET) for r in order if counts[r] > LIMIT}
    before, at = {}, 0
    for r in order:
        before[r] = at
        at += counts[r]
    wanted = total if wanted is None else wanted
    last = max((r for r in order if before[r] < wanted), default=-1)

    def merged(key, table):
        number = key[0].as_py()
        keys = _sorted(np.concatenate([_unpacked(x.as_py(), width) for x in table.column("data")]))[: wanted - before[number], -1]
        return pa.table({"row": keys, "rank": np.arange(before[number] + 1, before[number] + 1 + len(keys))})

    return pieces.where(F.col("range") <= last).select("range", "data").groupBy("range").applyInArrow(merged, "row long, rank long")
