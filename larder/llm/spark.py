"""Shared Spark helpers: table reads, stored intermediates, Arrow maps."""

from __future__ import annotations

import ctypes
import gc
import inspect
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder


#: A batch that goes out with all its columns is handled in parts of about this size.
PART_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut, lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def release() -> None:
    """Give freed memory back to the system, as workers are reused and keep what earlier tasks touched."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def releasing(function: Callable) -> Callable:
    """``function`` of a task, a generator over batches or a function of a table, with ``release`` before and after it: idle workers hold little."""
    if inspect.isgeneratorfunction(function):
        def run(batches):
            release()
            yield from function(batches)
            release()
    else:
        def run(table):
            release()
            out = function(table)
            release()
            return out
    return run


def parts(batch: pa.RecordBatch, size: int = PART_BYTES):
    """Slices of ``batch`` of about ``size`` bytes each, one row at least."""
    rows = max(1, batch.num_rows * size // max(1, batch.nbytes))
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows)


def map_batches(df: DataFrame, function: Callable, ddl: str) -> DataFrame:
    """``function(batch) -> dict of columns | iterable of such dicts | None`` over Arrow batches."""
    schema = arrow_schema(ddl)

    @releasing
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            made = function(batch)
            for columns in [made] if isinstance(made, dict) else made or ():
                yield pa.RecordBatch.from_arrays(
                    [columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type)
                     for f in schema], schema=schema)

    return df.mapInArrow(run, ddl)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def extend_batches(df: DataFrame, function: Callable, ddl: str) -> DataFrame:
    """All columns of ``df`` and those of ``ddl``, which ``function(batch) -> dict`` makes row by row."""
    extra = arrow_schema(ddl)

    @releasing
    def run(batches):
        for whole in batches:
            for batch in parts(whole):
                made = function(batch)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *(made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type) for f in extra)],
                    names=[*batch.schema.names, *extra.names])

    from pyspark.sql.types import StructType
    return df.mapInArrow(run, StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields]))
