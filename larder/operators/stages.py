"""Intermediate results that are written once and read by several readers.

Spark evaluates a frame again for each of its readers unless their plans
happen to share an exchange.  ``stage`` is the create-as sink: it writes the
frame as a table in the shared checkpoint folder and returns a frame over
that table, with exact sizes for the planner and without the lineage behind
it, so a lost executor re-reads files instead of re-running the plan.

Writing costs a job of its own, which small inputs do not repay:
``stage_if_large`` writes only where the tables that the frame reads exceed
STAGE_BYTES, and returns the frame itself otherwise.  Rows are the same
either way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import shared_folder

STAGE_BYTES = 256 << 20


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """``df`` written once under the shared folder; the returned frame reads that table."""
    path = f"{shared_folder(df.sparkSession)}/larder-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_bytes(df: DataFrame) -> int:
    """Estimated bytes of the tables that ``df`` reads, after column pruning."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))


def is_large(df: DataFrame, staged: bool | None = None) -> bool:
    """``staged``; whether ``df`` reads more than STAGE_BYTES if None."""
    return read_bytes(df) > STAGE_BYTES if staged is None else staged


def stage_if_large(df: DataFrame, name: str = "stage", staged: bool | None = None) -> DataFrame:
    """``stage(df)`` if ``staged``, ``df`` if not; by the bytes it reads if None."""
    return stage(df, name) if is_large(df, staged) else df
