"""Per-key selection operators, written to stay safe under key skew.

A window ``PARTITION BY key`` sends every row of a key to one task; if one
key holds a third of the rows, that task does a third of the work.  Both
operators here are aggregations instead: Spark computes a partial result per
input partition before the shuffle (map-side combine), so a hot key costs one
small row per partition in the exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast.

    For tables that grow with the items or their receipts.  Spark broadcasts a
    side by its estimated bytes, and the estimate of a well-compressed file or
    of a row-local explode (item x store) is many times below the rows that the
    driver then has to hold.  Both sides are shuffled and sorted instead,
    whatever the estimate."""
    return df.hint("merge")


def rows_at_max(df: DataFrame, key: str, by: str) -> DataFrame:
    """All rows whose ``by`` equals the greatest ``by`` of their ``key``.

    Ties are kept.  Rows with a NULL key or NULL ``by`` never qualify (they
    cannot equal a maximum), as with a correlated ``= (SELECT MAX ...)``.
    Plan: partial+final ``max`` per key, then a left-semi join back on
    ``(key, by)`` — hashing both columns spreads a hot key's rows by value.
    """
    top = (df.where(F.col(key).isNotNull() & F.col(by).isNotNull())
           .groupBy(key).agg(F.max(by).alias(by)))
    return df.join(top, on=[key, by], how="left_semi")


def top_one(df: DataFrame, key: str, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per ``key``: the row with the greatest ``order`` tuple.

    ``order`` must end in columns that make the tuple unique per key (the
    tie-break), so the choice is deterministic.  NULL order values lose to
    non-NULL ones (``ORDER BY ... DESC NULLS LAST``).  Implemented as
    ``max(struct(order..., keep...))`` per key.
    """
    fields = list(order) + [c for c in keep if c not in order]
    best = F.max(F.struct(*[F.col(c) for c in fields])).alias("_best")
    return (df.groupBy(key).agg(best)
            .select(key, *[F.col(f"_best.{c}").alias(c) for c in keep]))


def distinct_keys(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Distinct values of ``key`` over several frames (UNION of key sets):
    one shuffle, each branch pre-deduplicated per partition."""
    cols = [f.select(F.col(key)) for f in frames]
    out = cols[0]
    for f in cols[1:]:
        out = out.unionByName(f)
    return out.distinct()

