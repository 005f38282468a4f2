"""Period usage summary operators: the stock balance per item.

``usage = opening + purchases + out + in + waste - ending`` in reporting
units, where out / in / waste are already negated usage sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import SUMMARY_QTY, SUMMARY_VALUE, reporting_qty
from ..params import Period
from ..sources import Catalog
from .dimensions import item_primary_location, recent_supplier, reporting_factor, with_category
from .movements import period_movements, with_counts

QTY_COLUMNS = ["OpenInvQty", "PurchaseQty", "TransferOutQty", "TransferInQty", "WasteQty", "EndInvQty"]
SUMMARY_COLUMNS = ["ItemDescrip", "Supplier", "OrderCode", "Category_Name", "Item_Location", "UOM",
                   *QTY_COLUMNS, "UsageQty"]
HIDDEN_COLUMNS = ["ItemId", "ApproxValue", "EndInvValue"]


def _z(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def usage_balance(df: DataFrame) -> DataFrame:
    """Balance columns from the joined movement columns, each term NULL-safe;
    the quantities are rounded to the summary's declared decimal(14,3) and
    values to decimal(15,4).  A missing or zero factor gives NULL quantities."""
    f = F.col("ReportingConversionFactor")

    def rq(name: str) -> Column:
        return reporting_qty(_z(name), f)

    opening = rq("open_qoh") + rq("open_prep")
    ending = rq("close_qoh") + rq("close_prep")
    purchases, t_out, t_in, waste = rq("InvoiceSum"), rq("TransferOutQty"), rq("TransferInQty"), rq("WasteQty")
    usage = (opening + purchases + t_out + t_in + waste) - ending
    q = SUMMARY_QTY
    return df.select(
        F.col("Item").alias("ItemId"), "ItemDescrip", "Supplier", "OrderCode", "Category_Name",
        "Item_Location", "UOM",
        opening.cast(q).alias("OpenInvQty"), purchases.cast(q).alias("PurchaseQty"),
        t_out.cast(q).alias("TransferOutQty"), t_in.cast(q).alias("TransferInQty"),
        waste.cast(q).alias("WasteQty"), ending.cast(q).alias("EndInvQty"), usage.cast(q).alias("UsageQty"),
        (_z("open_val") + _z("InvoiceValue") - _z("close_val")).cast(SUMMARY_VALUE).alias("ApproxValue"),
        _z("close_val").cast(SUMMARY_VALUE).alias("EndInvValue"),
    )


def movement_filter(summary: DataFrame) -> DataFrame:
    """Keep items with any non-zero rounded quantity (NULL terms do not keep
    a row)."""
    cond = None
    for name in QTY_COLUMNS:
        term = F.col(name) != 0
        cond = term if cond is None else (cond | term)
    return summary.where(F.coalesce(cond, F.lit(False)))


def usage_table(c: Catalog, p: Period, all_items: bool = False) -> DataFrame:
    """The per-item usage table with all sixteen columns.

    With ``all_items=False`` only items with at least one movement or count
    line are built: every other item has all quantities zero or NULL, so the
    movement filter would drop it anyway — starting from the per-item
    movements instead of the whole item master keeps the joins proportional
    to the period's activity.  ``all_items=True`` builds every item (the full
    table)."""
    moves = period_movements(c, p)
    items = c["Item"].select(F.col("ItemId").alias("Item"), F.col("Descrip").alias("ItemDescrip"), "ItemGroup")
    items = with_counts(c, p, items.join(moves, "Item", "left" if all_items else "inner"))
    # not restricted to the items that moved: that would read every movement fact once more
    supplier = recent_supplier(c).select("Item", F.col("SupplierName").alias("Supplier"), "OrderCode")
    factor = reporting_factor(c, how="left", uom_field="Descrip", uom_name="UOM")
    j = (with_category(c, items, how="left", name="Category_Name")
         .join(item_primary_location(c, p.store), "Item", "left")
         .join(supplier, "Item", "left")
         .join(factor, "Item", "left"))
    return usage_balance(j)
