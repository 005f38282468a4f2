"""The four reports, composed from the operators.  Each returns a lazy
DataFrame; nothing is collected or cached inside, and only shared steps over
large tables are written on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mismatch_flag
from ..operators.catalogue import item_catalogue
from ..operators.dimensions import (item_search_filter, lookup, recent_supplier, with_category,
                                    with_uom_codes)
from ..operators.keyed import by_shuffle
from ..operators.ledger import activity_ledger, item_info
from ..operators.stages import stage_if_large
from ..operators.requests import large_lines, latest_requisition_status, request_lines, staged_candidates
from ..operators.usage import HIDDEN_COLUMNS, SUMMARY_COLUMNS, movement_filter, usage_table
from ..params import (ACTIVITY_ORDER, FULFILLED, LEDGER_DISPLAY, UNKNOWN_ACTIVITY_RANK, UOM_OK,
                      LedgerParams, Period, PickSheetParams, SearchParams)
from ..sources import Catalog


def activity_rank(col: str = "ActivityTypeName"):
    rank = F.lit(UNKNOWN_ACTIVITY_RANK)
    for name, pos in sorted(ACTIVITY_ORDER.items(), key=lambda kv: -kv[1]):
        rank = F.when(F.col(col) == name, F.lit(pos)).otherwise(rank)
    return rank


def item_activity_ledger(c: Catalog, p: LedgerParams = LedgerParams(), with_subtotals: bool = False,
                         display_names: bool = True, staged: bool | None = None) -> DataFrame:
    """R1: every inventory event of the store's active items in the period,
    with category, in business order (item, day, activity type).

    Three steps share their inputs: the item lookup, the period's lines and
    the ledger itself.  On large inputs (``staged=None``: by the bytes they
    read) lookup and lines are written once as tables under the checkpoint
    folder; else everything is one lazy plan."""
    info = stage_if_large(item_info(c, p), "item-info", staged)
    return ledger_output(activity_ledger(c, p, info, with_subtotals=with_subtotals, staged=staged), info, display_names)


def ledger_output(ledger: DataFrame, info: DataFrame, display_names: bool = True) -> DataFrame:
    """The ledger's output step: category from the item lookup, business
    order (item, day, activity type), days instead of times, display names."""
    out = ledger.join(info.select("ItemId", "CategoryName"), "ItemId")
    ordered = out.orderBy(F.col("ItemDescrip"), F.to_date("ActivityDate"), activity_rank(), F.col("ItemId"),
                          F.col("ActivityDate"), F.col("PurchaseInfo"), F.col("SupplierName"))
    cols = [(F.to_date("ActivityDate") if src == "ActivityDate" else F.col(src)).alias(
        dst if display_names else src) for src, dst in LEDGER_DISPLAY]
    return ordered.select(*cols)


def stock_request_pick_sheet(c: Catalog, p: PickSheetParams = PickSheetParams(), staged: bool | None = None) -> DataFrame:
    """R2: open stock requests sent by the store in the look-back window,
    one row per request line at its latest line status, newest first.  Over
    large line tables the requests and their lines are written once
    (``staged=None``: by the bytes of these tables)."""
    staged = large_lines(c) if staged is None else staged
    candidates = staged_candidates(c, p, staged)
    status = (latest_requisition_status(c, candidates).where(F.col("Status") != FULFILLED)
              .select("Requisition", "EffectiveDate", F.col("Employee").alias("EmployeeId")))
    lines, line_status = request_lines(c, candidates, staged)
    lines = lines.select("RequisitionItem", "Requisition", F.col("Item").alias("ItemId"))
    line_status = line_status.select("RequisitionItem", F.col("Qty").alias("QtyRequested"), F.col("Uom").alias("RequestUom"))
    req = candidates.select(
        "Requisition", "SendingStore", "ReceivingStore", F.col("Description").alias("StockReq_Descrip"),
        F.col("Notes").alias("StockReq_Notes"), "DateRequired")

    j = req.join(status, "Requisition")
    j = lookup(j, c["Store"], "SendingStore", "StoreId", {"Name": "Sender"})
    j = lookup(j, c["Store"], "ReceivingStore", "StoreId", {"Name": "Receiver"})
    j = lookup(j, c["Employee"], "EmployeeId", "EmployeeId", {"FirstName": "Employee"})
    j = j.join(lines, "Requisition").join(line_status, "RequisitionItem")
    items = c["Item"].select("ItemId", F.col("Descrip").alias("ItemName"), "ItemGroup")
    j = with_category(c, j.join(items, "ItemId"))
    detail = (c["ItemDetail"].where(F.col("Store") == p.store)
              .select(F.col("Item").alias("ItemId"), F.col("CurrentCaseSize").alias("CaseSizeId")))
    cs = c["CaseSize"].select("CaseSizeId", F.col("Supplier").alias("SupplierId"), "OrderCode")
    j = lookup(j.join(detail, "ItemId").join(cs, "CaseSizeId"), c["Vendor"], "SupplierId", "SupplierId",
               {"Name": "Supplier"})
    icf = c["ItemConversionFactor"].select(F.col("Item").alias("ItemId"), F.col("ReportingUom"))
    j = with_uom_codes(c, j.join(icf, "ItemId"), {"ReportingUom": "ReportingUom", "RequestUom": "RequestUom"})
    out = j.select(
        "ItemName", "QtyRequested", "RequestUom", "ReportingUom",
        mismatch_flag(F.col("RequestUom"), F.col("ReportingUom"), p.mismatch_label, UOM_OK, p.case_insensitive)
        .alias("UomMismatchFlag"),
        "CategoryName", "Sender", "Receiver", "Supplier", "OrderCode", "StockReq_Descrip",
        "StockReq_Notes", "DateRequired", "EffectiveDate", F.col("Sender").alias("StoreName"),
        "Employee", "Requisition", "RequisitionItem")
    return (out.orderBy(F.col("DateRequired").desc(), "Requisition", "RequisitionItem")
            .drop("Requisition", "RequisitionItem"))


def item_search(c: Catalog, p: SearchParams = SearchParams()) -> DataFrame:
    """R3: item catalogue with recent supplier and order code, filtered by
    description and order-code search terms.  Unordered."""
    cat = item_catalogue(c, p)
    # search terms narrow the items before their invoices are ranked
    items = None
    if p.item_term is not None and set(p.item_term) - {"%"}:
        items = item_search_filter(c["Item"].select(F.col("ItemId").alias("Item"), "Descrip"), p.item_term, None, "Descrip")
    supplier = recent_supplier(c, items).withColumnRenamed("Item", "ItemId")
    j = item_search_filter(cat.join(by_shuffle(supplier), "ItemId", "left"), p.item_term, p.order_code_term,
                           case_insensitive=p.case_insensitive)
    return j.select("StoreName", "CategoryName", "ItemId", "ItemDescrip", "SupplierName", "OrderCode",
                    "CaseCost", "CaseQty", "PakQty", "UnitCost", "PurchaseUom", "CaseUom", "PakUom",
                    "QtyOnHand", "ApproxValue", "LastReceived", "ReportingUom")


def item_usage_summary(c: Catalog, p: Period = Period(), include_hidden: bool = False) -> DataFrame:
    """R4: per item with any movement in the period, opening count,
    purchases, transfers out / in, waste, closing count and usage, ordered by
    category, location and description."""
    table = movement_filter(usage_table(c, p))
    ordered = table.orderBy("Category_Name", "Item_Location", "ItemDescrip", "ItemId")
    cols = SUMMARY_COLUMNS + (HIDDEN_COLUMNS if include_hidden else [])
    return ordered.select(*cols)
