"""Item catalogue for the item search: tracked items with packaging, costs,
stock on hand and last receipt, for one store or for every store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import PRODUCT, RATIO, reporting_cost, reporting_qty
from ..params import SearchParams
from ..sources import Catalog
from .dimensions import packaging_units, reporting_factor, with_category, with_store_name
from .keyed import by_shuffle


def item_catalogue(c: Catalog, p: SearchParams) -> DataFrame:
    """One row per tracked item x store (x last-received row, see below).

    With ``store=None`` every store is listed and, as in the original report, the
    last-received rows are matched on the item alone, so each item x store
    row repeats once per store that received the item
    (``last_received_scope='item_store'`` matches item and store instead).
    Costs, case cost and stock on hand are matched on item and store.
    """
    detail = c["ItemDetail"].where(F.col("TrackInventory") == 1)
    if p.store is not None:
        detail = detail.where(F.col("Store") == p.store)
    detail = detail.select("Item", "Store", F.col("CurrentCaseSize").alias("CaseSizeId"))
    items = c["Item"].select(F.col("ItemId").alias("Item"), F.col("Descrip").alias("ItemDescrip"), "ItemGroup")
    cs = c["CaseSize"].select("CaseSizeId", "CaseQty", "PakQty", "PurchaseUom", "CaseUom", "PakUom")
    csc = c["CaseSizeCost"].select(F.col("CaseSize").alias("CaseSizeId"), "Store", "CaseCost")
    iuc = c["ItemUnitCost"].where(F.col("Active") == 1).select("Item", "Store", "TrackingCost")
    qoh = c["ItemQtyOnHand"].select("Item", "Store", F.col("QtyOnHand").alias("qoh"))
    ilr = c["ItemLastReceived"]
    if p.store is not None:
        ilr = ilr.where(F.col("Store") == p.store)
    if p.last_received_scope == "item_store":
        ilr = ilr.select("Item", "Store", "LastReceived")
        ilr_keys = ["Item", "Store"]
    elif p.last_received_scope == "item":
        ilr = ilr.select("Item", "LastReceived")
        ilr_keys = ["Item"]
    else:
        raise ValueError(f"last_received_scope={p.last_received_scope!r}")

    # Joins grouped by key so the wide row changes partitioning as little as
    # possible: item x store tables, then the case-size tables (pre-joined
    # on their own key), then the item-keyed tables.  All of them grow with
    # the items, so none is broadcast.
    j = detail.join(by_shuffle(iuc), ["Item", "Store"]).join(by_shuffle(qoh), ["Item", "Store"])
    packs = packaging_units(c, cs).join(by_shuffle(csc), "CaseSizeId")
    j = j.join(by_shuffle(packs), ["CaseSizeId", "Store"])
    j = with_category(c, j.join(by_shuffle(items), "Item"))
    j = j.join(by_shuffle(reporting_factor(c)), "Item").join(by_shuffle(ilr), ilr_keys)
    j = with_store_name(c, j, "Store")
    factor = F.col("ReportingConversionFactor")
    return j.select(
        "StoreName", "CategoryName", F.col("Item").alias("ItemId"), "ItemDescrip",
        "CaseCost", "CaseQty", "PakQty",
        reporting_cost(F.col("TrackingCost"), factor).cast(PRODUCT).alias("UnitCost"),
        "PurchaseUom", "CaseUom", "PakUom",
        reporting_qty(F.col("qoh"), factor).cast(RATIO).alias("QtyOnHand"),
        (F.col("qoh") * F.col("TrackingCost")).cast("decimal(13,2)").alias("ApproxValue"),
        "LastReceived", "ReportingUom",
    )
