"""Physical layout of the stored domain tables.

A report asks for one store and a period, but store and date stand in the
headers (invoices, usage sources, counts, requests) while nearly all rows
are lines.  ``write`` carries the header's store and month down to every line
and partitions both by them: ``PartStore`` and ``PartMonth`` (year * 100 +
month).  Within a partition the rows are clustered by the columns of
``PLACES``, so the row groups of an item or of a header lie together.  Rows
are dealt out by ranges of (store, month, cluster), so a store that holds a
third of the rows is written by many tasks, and a directory gets few files.

Old or thin years may be kept in one directory a year (``by_year``; month
yyyy00): bounds on the month find both forms, in one table too.

A missing store or month (undated headers, lines without a header) is
written as NO_STORE or 0: every row is in some partition, and bounds taken
from headers always include it.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ntz

STORE, MONTH = "PartStore", "PartMonth"
NO_STORE = -1
SCHEMA = ".schema.json"


@dataclass(frozen=True)
class Place:
    """How a table finds its partition: by its own store and dates (the first
    that is set), or by ``parent``'s row with ``key`` = ``via``."""

    cluster: tuple[str, ...]
    store: str | None = None
    dates: tuple[str, ...] = ()
    parent: str | None = None
    via: str | None = None
    key: str | None = None


PLACES = {
    "Invoice": Place(("InvoiceId",), store="Store", dates=("InvoiceDate",)),
    "InvoiceItem": Place(("Item", "Invoice"), parent="Invoice", via="Invoice", key="InvoiceId"),
    "InvoiceRFC": Place(("InvoiceItem",), parent="InvoiceItem", via="InvoiceItem", key="InvoiceLineId"),
    "UsageSource": Place(("UsageSourceId",), store="Store", dates=("UsageDate",)),
    "ItemUsage": Place(("Item", "UsageSource"), parent="UsageSource", via="UsageSource", key="UsageSourceId"),
    "Waste": Place(("WasteDate",), parent="UsageSource", via="UsageSource", key="UsageSourceId"),
    "TransferContext": Place(("Store", "TransferContextId"), parent="UsageSource", via="UsageSource", key="UsageSourceId"),
    "Transfer": Place(("TransferId",), dates=("TransferDate",)),
    "Inventory": Place(("InventoryId",), store="Store", dates=("OpenDate", "CloseDate")),
    "InventorySummary": Place(("Item", "Inventory"), parent="Inventory", via="Inventory", key="InventoryId"),
    "Requisition": Place(("RequisitionId",), store="SendingStore", dates=("DateRequired",)),
    "RequisitionStatus": Place(("Requisition",), parent="Requisition", via="Requisition", key="RequisitionId"),
    "RequisitionItem": Place(("Requisition",), parent="Requisition", via="Requisition", key="RequisitionId"),
    "RequisitionItemStatus": Place(("RequisitionItem",), parent="RequisitionItem", via="RequisitionItem", key="RequisitionItemId"),
}
#: Parents come before the tables that follow them.
ORDER = sorted(PLACES, key=lambda name: (PLACES[name].parent is not None, PLACES[name].parent not in (None, *(n for n, p in PLACES.items() if p.parent is None))))


def with_parents(names) -> list[str]:
    """The tables and those they take their partition from."""
    out: list[str] = []
    for name in names:
        chain = [name]
        while chain[-1] in PLACES and PLACES[chain[-1]].parent:
            chain.append(PLACES[chain[-1]].parent)
        out.extend(x for x in reversed(chain) if x not in out)
    return out


def month_number(day: Column) -> Column:
    return F.year(day) * 100 + F.month(day)


def placed(name: str, rows: DataFrame, parent: DataFrame | None, by_year: bool = False) -> DataFrame:
    """``rows`` with their partition; ``parent`` is the stored parent table with its own."""
    place = PLACES[name]
    if place.parent is None:
        store = F.col(place.store).cast("int") if place.store else F.lit(None).cast("int")
        day = F.coalesce(*[F.col(d) for d in place.dates])
        month = F.year(day) * 100 if by_year else month_number(day)
        return rows.withColumn(STORE, F.coalesce(store, F.lit(NO_STORE))).withColumn(MONTH, F.coalesce(month, F.lit(0)))
    found = parent.select(F.col(place.key).alias("_key"), STORE, MONTH)
    out = rows.join(found, F.col(place.via) == F.col("_key"), "left").drop("_key")
    return out.withColumn(STORE, F.coalesce(STORE, F.lit(NO_STORE))).withColumn(MONTH, F.coalesce(MONTH, F.lit(0)))


def dealt(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` dealt to the writing tasks by ranges of (store, month, cluster)
    and sorted.  The number of tasks is that of shuffle partitions, not left to
    adaptive merging, which looks at bytes and would have one task open every
    directory; ranges are contiguous, so there are at most tasks + directories files."""
    by = [STORE, MONTH, *PLACES[name].cluster]
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(tasks, *by).sortWithinPartitions(*by)


def stored(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table with its partition columns, where it has them."""
    path = os.path.join(root, name)
    files, note = on_disk(spark, path + SCHEMA)
    if not files.exists(note):  # written by others
        return spark.read.parquet(path)
    stream = files.open(note)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return spark.read.schema(T.StructType.fromJson(json.loads(text))).parquet(path)


def on_disk(spark: SparkSession, path: str):
    """The file system of a path, whichever it is, and the path in its form."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _note_schema(rows: DataFrame, path: str) -> None:
    """Keep the schema beside the table: an empty one has no file to tell it, and no footer need be read."""
    files, note = on_disk(rows.sparkSession, path + SCHEMA)
    stream = files.create(note, True)
    stream.write(bytearray(T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields]).json().encode()))
    stream.close()


def write(tables, names, root: str, mode: str = "overwrite", by_year: bool = False) -> None:
    """Write ``tables[name]`` for all names under ``root``, lines and headers by store and month (or year)."""
    for name in [*(n for n in ORDER if n in names), *(n for n in names if n not in PLACES)]:
        rows, path = tables[name], os.path.join(root, name)
        if name not in PLACES:
            _note_schema(rows, path)
            rows.write.mode(mode).parquet(path)
            continue
        parent = PLACES[name].parent
        out = placed(name, rows, stored(rows.sparkSession, root, parent) if parent else None, by_year)
        _note_schema(out.select(*rows.columns, STORE, MONTH), path)
        dealt(out, name).write.mode(mode).partitionBy(STORE, MONTH).parquet(path)


def append(rows: DataFrame, root: str, name: str) -> None:
    """Add ``rows``, which have their partition columns, to a stored table."""
    dealt(rows, name).write.mode("append").partitionBy(STORE, MONTH).parquet(os.path.join(root, name))


def months_between(start, end) -> Column:
    """Condition on the month for dates in the closed interval; ``None`` leaves a side open, a Column is taken as is."""
    out = F.lit(True)
    if start is not None:  # a whole year (yyyy00) counts from its first month on
        first = start if isinstance(start, Column) else ntz(start)
        whole_year = (F.col(MONTH) % 100 == 0) & (F.col(MONTH) >= F.year(first) * 100)
        out = out & ((F.col(MONTH) >= month_number(first)) | whole_year)
    if end is not None:
        last = end if isinstance(end, Column) else ntz(end)
        out = out & (F.col(MONTH) <= month_number(last))
    return out


def within(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """``rows`` of the partitions that ``headers`` lie in.

    The set of partitions (one number each) is a scalar subquery in a
    partition filter: Spark evaluates it before it chooses the files to read.
    """
    number = F.col(STORE).cast("bigint") * 1_000_000 + F.col(MONTH)
    return rows.where(F.array_contains(headers.agg(F.collect_set(number)).scalar(), number))
