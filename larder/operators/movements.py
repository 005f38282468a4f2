"""Stock movements of one store over a period (the usage summary's inputs).

Each movement kind is first expressed as narrow *line* rows
``(Item, measure...)`` already restricted to the store and period, and only
then aggregated per item.  The individual operators (purchases, transfers
out / in, waste, counts) each aggregate one kind; ``period_movements``
aggregates all of them in a single pass over their union, which is what the
summary uses: one shuffle on ``Item`` with map-side partial sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import SUM_QTY, SUM_VALUE, between, ntz
from ..params import Period
from ..sources import Catalog


def purchase_lines(c: Catalog, p: Period) -> DataFrame:
    """Invoice lines of the store dated in the period, net of their credits:
    ``(Item, Store, qty, value)``.  A line with several credits appears once
    per credit (left-join semantics)."""
    period = (p.store, p.start, p.end)
    inv = (c.of_period("Invoice", *period).where((F.col("Store") == p.store) & between(F.col("InvoiceDate"), p.start, p.end))
           .select(F.col("InvoiceId").alias("Invoice"), "Store"))
    lines = c.of_period("InvoiceItem", *period).select("InvoiceLineId", "Invoice", "Item", "StockQty", "AdjustedTotal")
    credits = c.of_period("InvoiceRFC", *period).select(F.col("InvoiceItem").alias("InvoiceLineId"),
                                                        F.col("StockQty").alias("credit"))
    j = lines.join(inv, "Invoice").join(credits, "InvoiceLineId", "left")
    return j.select("Item", "Store",
                    (F.col("StockQty") - F.coalesce(F.col("credit"), F.lit(0))).alias("qty"),
                    F.col("AdjustedTotal").alias("value"))


USAGE_KINDS = ("out", "in", "waste")


def _usage_roles(c: Catalog, p: Period, kinds=USAGE_KINDS) -> DataFrame:
    """``(UsageSource, kind)`` of the usage sources that count for the period:
    the store's sending (``out``) or receiving (``in``) end of a transfer dated
    in the period — store tested on the transfer context — and waste events
    dated in the period whose usage source is at the store.

    Over the stored layout the rows carry the partition of their usage
    source: an event's date need not be that of its source, so the source's
    partition, not the period, says where its usage lines are."""
    parts = []
    ends = []
    carried = c.partition_columns("TransferContext", "Waste", "ItemUsage")
    for kind, side in (("out", "Sender"), ("in", "Receiver")):
        if kind in kinds:
            ends.append(c.of_period("Transfer", None, p.start, p.end).where(between(F.col("TransferDate"), p.start, p.end))
                        .select(F.col(side).alias("TransferContextId"), F.lit(kind).alias("kind")))
    if ends:  # the context table is read once for both directions
        t = ends[0] if len(ends) == 1 else ends[0].unionByName(ends[1])
        tc = c.placed("TransferContext").where(F.col("Store") == p.store).select("TransferContextId", "UsageSource", *carried)
        parts.append(tc.join(t, "TransferContextId").select("UsageSource", "kind", *carried))
    if "waste" in kinds:
        us = (c.of_period("UsageSource", p.store).where(F.col("Store") == p.store)
              .select(F.col("UsageSourceId").alias("UsageSource")))
        w = c.of_period("Waste", p.store).where(between(F.col("WasteDate"), p.start, p.end)).select("UsageSource", *carried)
        parts.append(w.join(us, "UsageSource").select("UsageSource", F.lit("waste").alias("kind"), *carried))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def usage_lines(c: Catalog, p: Period, kinds=USAGE_KINDS) -> DataFrame:
    """Usage rows of transfers out / in and waste of the store in the period,
    ``(Item, kind, qty)`` with the usage quantity negated.  One join of the
    usage fact against all roles: the fact is read once for the three kinds,
    and a usage source with several roles counts once per role."""
    roles = _usage_roles(c, p, kinds)
    iu = c.of_headers("ItemUsage", roles).select("UsageSource", "Item", "StockQty")
    return iu.join(roles.select("UsageSource", "kind"), "UsageSource").select(
        "Item", "kind", (-F.col("StockQty")).alias("qty"))


def transfer_lines(c: Catalog, p: Period, side: str) -> DataFrame:
    """Usage rows booked on the ``side`` (``'Sender'`` or ``'Receiver'``) end
    of transfers dated in the period, whose context is at the store:
    ``(Item, qty)`` with the usage quantity negated."""
    kind = {"Sender": "out", "Receiver": "in"}[side]
    return usage_lines(c, p, (kind,)).select("Item", "qty")


def waste_lines(c: Catalog, p: Period) -> DataFrame:
    """Usage rows of waste events dated in the period at the store:
    ``(Item, qty)`` negated."""
    return usage_lines(c, p, ("waste",)).select("Item", "qty")


def period_purchases(c: Catalog, p: Period) -> DataFrame:
    """Per item (and the store): net purchased quantity and invoiced value."""
    return (purchase_lines(c, p).groupBy("Item", "Store")
            .agg(F.sum("qty").cast(SUM_QTY).alias("InvoiceSum"),
                 F.sum("value").cast(SUM_VALUE).alias("InvoiceValue")))


def period_transfer_out(c: Catalog, p: Period) -> DataFrame:
    return (transfer_lines(c, p, "Sender").groupBy("Item")
            .agg(F.sum("qty").cast(SUM_QTY).alias("TransferOutQty")))


def period_transfer_in(c: Catalog, p: Period) -> DataFrame:
    return (transfer_lines(c, p, "Receiver").groupBy("Item")
            .agg(F.sum("qty").cast(SUM_QTY).alias("TransferInQty")))


def period_waste(c: Catalog, p: Period) -> DataFrame:
    return waste_lines(c, p).groupBy("Item").agg(F.sum("qty").cast(SUM_QTY).alias("WasteQty"))


MEASURES = {
    "InvoiceSum": SUM_QTY, "InvoiceValue": SUM_VALUE,
    "TransferOutQty": SUM_QTY, "TransferInQty": SUM_QTY, "WasteQty": SUM_QTY,
}
COUNT_LINE = "struct<Inventory:int,QtyOnHand:decimal(18,3),PreppedQty:decimal(18,3),TotalValue:decimal(18,4)>"
COUNT_SIDES = {"open": "OpenDate", "close": "CloseDate"}


def _tagged(df: DataFrame, **measures) -> DataFrame:
    """Rows of one movement kind in the common wide shape: the kind's own
    measures filled, every other measure NULL."""
    none = F.lit(None)
    return df.select("Item", *[(measures.get(name, none)).cast(t).alias(name) for name, t in MEASURES.items()],
                     *[measures.get(f"{side}_line", none).cast(COUNT_LINE).alias(f"{side}_line") for side in COUNT_SIDES])


def period_movements(c: Catalog, p: Period, include_counts: bool = True) -> DataFrame:
    """Every movement of the store in the period per item, in one
    aggregation over the union of the kinds: ``(Item, InvoiceSum,
    InvoiceValue, TransferOutQty, TransferInQty, WasteQty, open_lines,
    close_lines)``.

    A kind without rows for an item sums to NULL, as a left join to that
    kind's per-item aggregate would give.  Count lines are not summed: they
    are kept as a list per item (a handful: one per count of that date), so
    that every count keeps its own row.  One shuffle on ``Item`` with
    map-side partial results replaces six joins, and a hot item costs one
    partial row per input partition."""
    def of(kind):
        return F.when(F.col("kind") == kind, F.col("qty"))

    parts = [
        _tagged(purchase_lines(c, p), InvoiceSum=F.col("qty"), InvoiceValue=F.col("value")),
        _tagged(usage_lines(c, p), TransferOutQty=of("out"), TransferInQty=of("in"), WasteQty=of("waste")),
    ]
    if include_counts:
        line = F.struct("Inventory", "QtyOnHand", "PreppedQty", "TotalValue")
        roles = [_counts(c, p.store, col, when).withColumn("side", F.lit(side))
                 for (side, col), when in zip(COUNT_SIDES.items(), (p.start, p.end), strict=True)]
        both = roles[0].unionByName(roles[1])
        lines = c.of_headers("InventorySummary", both).join(both.select("Inventory", "side"), "Inventory")  # one read for both sides
        parts.append(_tagged(lines, **{f"{side}_line": F.when(F.col("side") == side, line) for side in COUNT_SIDES}))
    u = parts[0]
    for part in parts[1:]:
        u = u.unionByName(part)
    lists = [F.collect_list(f"{side}_line").alias(f"{side}_lines") for side in COUNT_SIDES] if include_counts else []
    return u.groupBy("Item").agg(*[F.sum(n).cast(MEASURES[n]).alias(n) for n in MEASURES], *lists)


def with_counts(c: Catalog, p: Period, items: DataFrame) -> DataFrame:
    """Each item of ``period_movements`` with its opening and closing count:
    columns ``open_qoh, open_prep, open_val, close_qoh, close_prep, close_val``.

    A row per count line; a count of that date that lacks the item gives a
    row with empty values, as attaching every count of the date to every item
    does; no count at all gives one such row.  The number of counts of a date
    is a scalar, so this is an explode, not a join without key."""
    out = items
    for (side, col), when in zip(COUNT_SIDES.items(), (p.start, p.end), strict=True):
        n = _counts(c, p.store, col, when).agg(F.count(F.lit(1)).cast("int")).scalar()
        lines = F.coalesce(F.col(f"{side}_lines"), F.array().cast(f"array<{COUNT_LINE}>"))
        held = F.size(F.array_distinct(F.transform(lines, lambda x: x["Inventory"])))
        missing = F.array_repeat(F.lit(None).cast(COUNT_LINE), F.greatest(n - held, F.lit(0)))
        out = out.withColumn("_line", F.concat(lines, missing)).drop(f"{side}_lines")
        out = out.select("*", F.explode_outer("_line").alias("_x")).select(
            *[x for x in out.columns if x != "_line"], F.col("_x.QtyOnHand").alias(f"{side}_qoh"),
            F.col("_x.PreppedQty").alias(f"{side}_prep"), F.col("_x.TotalValue").alias(f"{side}_val"))
    return out


def _counts(c: Catalog, store: int, date_col: str, when) -> DataFrame:
    """The store's counts whose ``date_col`` is exactly ``when``; unfinalised ones are included."""
    return (c.of_period("Inventory", store).where((F.col("Store") == store) & (F.col(date_col) == ntz(when)))
            .select(F.col("InventoryId").alias("Inventory"), *c.partition_columns("Inventory", "InventorySummary")))


def period_count(c: Catalog, store: int, date_col: str, when) -> DataFrame:
    """Count lines of the store's inventory counts whose ``date_col``
    (``OpenDate`` / ``CloseDate``) is exactly ``when``: ``(Item, QtyOnHand,
    PreppedQty, TotalValue)``, one row per line of each such count."""
    counts = _counts(c, store, date_col, when)
    s = c.of_headers("InventorySummary", counts).select("Inventory", "Item", "QtyOnHand", "PreppedQty", "TotalValue")
    return s.join(counts.select("Inventory"), "Inventory").drop("Inventory")


def period_opening_inventory(c: Catalog, p: Period) -> DataFrame:
    return period_count(c, p.store, "OpenDate", p.start)


def period_closing_inventory(c: Catalog, p: Period) -> DataFrame:
    return period_count(c, p.store, "CloseDate", p.end)

