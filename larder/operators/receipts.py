"""The latest receipt per item and supplier, kept as a mergeable summary.

"Most recent supplier of an item" needs the greatest (invoice date, invoice
id) of its lines.  That pair is one number here (``receipt_rank``), so the
pick is a plain ``max`` / ``max_by`` with partial results: one shuffle, no
window, no join back.  And a maximum merges: the greatest rank per item and
supplier of each month is stored next to the facts (``summarise``), and a
report reads the stored maxima plus the lines of months that are not in the
summary, instead of every invoice line ever written.

The supplier is part of the key because eligibility depends on the vendor's
name, which may change: it is tested when the summary is read.

``append_invoices`` adds invoices to the stored facts, late ones too.  The
summary's partitions of the months it touches are removed before a line is
written and rebuilt afterwards by merging the removed maxima with the new
lines' (the old lines are not read again), so a run that fails at any point
leaves a store whose reports are right: a month without a summary is read
from its lines.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import starts_numeric
from ..sources import Catalog, layout

FOLDER = "LatestReceipt"
RANK = "decimal(38,0)"
#: Invoice ids are 64-bit numbers: moved by _ID_SHIFT they lie in 0 .. _ID_RANGE - 1.
_ID_SHIFT, _ID_RANGE = 1 << 63, 1 << 64
#: Stands for a missing date: before any date that a timestamp can hold.
_NEVER = -4_000_000_000_000_000_000


def receipt_rank(day: Column, invoice: Column) -> Column:
    """(date, invoice id) as one number in the same order; an undated invoice is before any dated one."""
    seconds = F.hour(day) * 3600 + F.minute(day) * 60
    fraction = (F.date_part(F.lit("SECOND"), day) * 1_000_000).cast("bigint")
    micros = F.unix_date(day.cast("date")).cast("bigint") * 86_400_000_000 + seconds.cast("bigint") * 1_000_000 + fraction
    when = F.coalesce(micros, F.lit(_NEVER)).cast("decimal(19,0)")
    width, shift = (F.lit(str(x)).cast("decimal(20,0)") for x in (_ID_RANGE, _ID_SHIFT))
    return (when * width + (invoice.cast("decimal(20,0)") + shift)).cast(RANK)


def eligible_vendors(c: Catalog) -> DataFrame:
    """Suppliers whose name does not start with a numeric character (those are internal)."""
    return c["Vendor"].where(~starts_numeric(F.col("Name"))).select(F.col("SupplierId").alias("Supplier"))


def line_receipts(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """``(Item, Supplier, Latest)`` of every line, with the line's month where ``lines`` has it."""
    heads = invoices.select(F.col("InvoiceId").alias("Invoice"), "Supplier",
                            receipt_rank(F.col("InvoiceDate"), F.col("InvoiceId")).alias("Latest"))
    carried = [layout.MONTH] if layout.MONTH in lines.columns else []
    return lines.select("Invoice", "Item", *carried).join(heads, "Invoice").select("Item", "Supplier", "Latest", *carried)


def merged(receipts: DataFrame) -> DataFrame:
    """One row per item and supplier (and month): the greatest rank of the given ones."""
    keys = [x for x in receipts.columns if x != "Latest"]
    return receipts.groupBy(*keys).agg(F.max("Latest").alias("Latest"))


def receipts(c: Catalog, items: DataFrame | None = None) -> DataFrame:
    """``(Item, Supplier, Latest)`` of eligible suppliers, several rows per
    pair: the stored maxima and the lines of all other months; every line
    where there is no summary.  ``items`` restricts the result to its items."""
    vendors = eligible_vendors(c)

    def of_items(df):
        return df if items is None else df.join(items.select("Item").distinct(), "Item", "left_semi")

    # headers are far fewer than lines: eligible ones first
    heads = c["Invoice"].join(vendors, "Supplier", "left_semi")
    kept = summary(c)
    if kept is None:
        return line_receipts(heads, of_items(c["InvoiceItem"]))
    open_lines = c.placed("InvoiceItem").where(~F.col(layout.MONTH).isin(months(kept)))
    open_heads = c.of_headers("Invoice", open_lines).join(vendors, "Supplier", "left_semi")
    fresh = line_receipts(open_heads, of_items(open_lines.drop(layout.STORE, layout.MONTH)))
    stored = of_items(kept.drop(layout.MONTH)).join(vendors, "Supplier", "left_semi")
    return stored.select("Item", "Supplier", "Latest").unionByName(fresh)


# ---------------------------------------------------------------- storage

def summary(c: Catalog) -> DataFrame | None:
    """The stored maxima of a catalog whose facts have the stored layout, if it has any."""
    if c.root is None or not c.is_placed("InvoiceItem"):
        return None
    files, where = layout.on_disk(c.spark, os.path.join(c.root, FOLDER))
    if not files.exists(where) or not any(x.isDirectory() for x in files.listStatus(where)):
        return None
    ddl = f"Item bigint, Supplier bigint, Latest {RANK}, {layout.MONTH} int"
    return c.spark.read.schema(ddl).parquet(os.path.join(c.root, FOLDER))


def months(kept: DataFrame) -> list[int]:
    """The months that a summary holds: one number a month."""
    return sorted(r[0] for r in kept.select(layout.MONTH).distinct().collect())


def _write(spark: SparkSession, root: str, receipts_: DataFrame) -> None:
    """Replace the partitions of the months of ``receipts_``, others stay."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (merged(receipts_).repartitionByRange(tasks, layout.MONTH, "Item").sortWithinPartitions(layout.MONTH, "Item")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(layout.MONTH).parquet(os.path.join(root, FOLDER)))


def _months_of(c: Catalog, only: Iterable[int] | None) -> DataFrame:
    lines, heads = c.placed("InvoiceItem"), c.placed("Invoice")
    if only is not None:
        lines, heads = (x.where(F.col(layout.MONTH).isin(list(only))) for x in (lines, heads))
    return line_receipts(heads.drop(layout.STORE, layout.MONTH), lines)


def summarise(c: Catalog, only: Iterable[int] | None = None) -> None:
    """Store the maxima of the given months (all of them if None) from their lines."""
    if c.root is None or not c.is_placed("InvoiceItem"):
        raise ValueError("a summary needs facts in the stored layout")
    _write(c.spark, c.root, _months_of(c, only))


def append_invoices(c: Catalog, invoices: DataFrame, lines: DataFrame) -> None:
    """Add invoices and their lines (with the tables' columns) to the stored
    facts and fold them into the summary.

    Rows that the months of these invoices have already (by invoice id, by
    line id) are not added again, so a run may be repeated, after a failure too: lines are
    written before their headers, and lines without a header are in no report.
    """
    if c.root is None or not c.is_placed("InvoiceItem"):
        raise ValueError("invoices are appended to facts in the stored layout")
    spark, root = c.spark, c.root
    heads = layout.placed("Invoice", invoices, None)
    rows = layout.placed("InvoiceItem", lines, heads)
    had = layout.within(layout.stored(spark, root, "Invoice"), heads).select("InvoiceId")
    had_lines = layout.within(layout.stored(spark, root, "InvoiceItem"), heads).select("InvoiceLineId")
    heads, rows = heads.join(had, "InvoiceId", "left_anti"), rows.join(had_lines, "InvoiceLineId", "left_anti")
    # what is new decides nothing about the months: a repeated run has to restore theirs as well
    touched = sorted(r[0] for r in layout.placed("Invoice", invoices, None).select(layout.MONTH).distinct().collect())
    kept = summary(c)
    old = None
    if kept is not None and touched:
        old = _aside(c, kept.where(F.col(layout.MONTH).isin(touched)))
        for month in touched:
            files, where = layout.on_disk(spark, os.path.join(root, FOLDER, f"{layout.MONTH}={month}"))
            files.delete(where, True)
    layout.append(rows, root, "InvoiceItem")
    layout.append(heads, root, "Invoice")
    c.refresh()
    if old is not None:
        had = months(old)
        parent = layout.placed("Invoice", invoices, None)
        new = line_receipts(parent.drop(layout.STORE, layout.MONTH), layout.placed("InvoiceItem", lines, parent))
        if had:
            _write(spark, root, old.unionByName(new.where(F.col(layout.MONTH).isin(had))))
        missing = [m for m in touched if m not in had]
        if missing:
            summarise(c, missing)


def _aside(c: Catalog, rows: DataFrame) -> DataFrame:
    """The rows, written outside the folder whose files are about to go."""
    from .stages import stage
    return stage(rows)
