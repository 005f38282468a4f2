"""A bitmap of fixed size over hashes: who may be in a set, without sending the set."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITMAP_BITS = 23


def marked(words: np.ndarray, h: int) -> bool:
    bit = h & ((1 << BITMAP_BITS) - 1)
    return bool(int(words[bit >> 6]) >> (bit & 63) & 1)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """2**BITMAP_BITS bits, set for the given hashes; its size does not depend on the data."""
    bit = F.col("h").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    rows = (hashes.groupBy(F.shiftright(bit, 6).cast("int").alias("w"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(h & 63 as int))")).alias("m")).toArrow())
    words = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.uint64)
    words[rows.column("w").to_numpy()] = rows.column("m").to_numpy().view(np.uint64)
    return words
