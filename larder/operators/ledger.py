"""Item activity ledger operators: one row per inventory event of an active
item at a store in a period (opening count, purchase, waste, transfer in,
transfer out, ending count), in reporting units.

Each activity kind is first expressed as narrow event rows (item, date,
type, reference, counterparty, quantity and value in stock units); the kinds
are unioned and then joined once to the item description and the item
lookup, and cast to the 19-column ledger shape (``LEDGER_SCHEMA``).  Waste
and transfers are summed per ``(item, event)`` *before* the wide lookup is
attached.  Grouping the joined rows by every lookup column would sum an event
over lookup rows that differ in the category alone (which is not grouped by),
so such rows are counted and the sums multiplied; counts and purchases, which
are not summed, repeat instead.
The single-kind operators (``ledger_waste`` ...) run the same code for one
kind.

Tables that grow with the items are joined by shuffle (``by_shuffle``): the
planner would broadcast them by the few bytes of their files, and the driver
has to hold what is broadcast.  On large inputs the headers of the period are
written first (``stages``): a written table has an exact size, so where it is
small the line facts are cut to it where they are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import MONEY, QTY, between, like, reporting_cost, reporting_qty, unit_cost_from_value
from ..params import (ENDING, MATCH_ALL, OPENING, PURCHASE, SUBTOTAL, TRANSFER_IN,
                      TRANSFER_OUT, WASTE, LedgerParams)
from ..sources import Catalog
from .dimensions import lookup, packaging_units, reporting_factor, store_name, with_category
from .keyed import by_shuffle, distinct_keys
from .stages import is_large, stage

S = T.StringType()
LEDGER_SCHEMA = T.StructType([
    T.StructField("ItemId", T.LongType()),
    T.StructField("ItemDescrip", S),
    T.StructField("ActivityDate", T.TimestampNTZType()),
    T.StructField("ActivityTypeName", S),
    T.StructField("Amount", QTY),
    T.StructField("QtyOnHand", QTY),
    T.StructField("Value", MONEY),
    T.StructField("PurchaseInfo", S),
    T.StructField("StoreName", S),
    T.StructField("SupplierName", S),
    T.StructField("OrderCode", S),
    T.StructField("CaseCost", MONEY),
    T.StructField("CaseQty", QTY),
    T.StructField("PakQty", QTY),
    T.StructField("UnitCost", MONEY),
    T.StructField("PurchaseUom", S),
    T.StructField("CaseUom", S),
    T.StructField("PakUom", S),
    T.StructField("ReportingUom", S),
])
LEDGER_COLUMNS = [f.name for f in LEDGER_SCHEMA.fields]

INFO_COLUMNS = ["ItemId", "OrderCode", "CaseCost", "CaseQty", "PakQty", "TrackingCost",
                "ReportingConversionFactor", "PurchaseUom", "CaseUom", "PakUom",
                "ReportingUom", "CategoryName"]


def as_ledger(**cols: Column) -> list[Column]:
    """Columns in ledger order, each cast to its declared type (the
    original report rounds decimals to the declared scale)."""
    missing = set(LEDGER_COLUMNS) - set(cols)
    if missing:
        raise ValueError(f"ledger columns missing: {sorted(missing)}")
    return [cols[f.name].cast(f.dataType).alias(f.name) for f in LEDGER_SCHEMA.fields]


# --------------------------------------------------------------------------
# Item set and lookup
# --------------------------------------------------------------------------

def _of(rows: DataFrame, headers: DataFrame, key: str, name: str, staged: bool) -> DataFrame:
    """``rows`` joined to their headers; ``staged``: to the written headers,
    the rows cut to them before.  The cut is a filter (``IN``), which passes
    below the steps that make the rows; a semi join stays above most."""
    if staged:
        headers = stage(headers, name)
        rows = rows.where(F.col(key).isin(headers.select(key)))
    return rows.join(headers, key)


def _store_purchases(c: Catalog, p: LedgerParams, staged: bool = False) -> DataFrame:
    period = (p.store, p.start, p.end)
    inv = (c.of_period("Invoice", *period).where((F.col("Store") == p.store) & between(F.col("InvoiceDate"), p.start, p.end))
           .select(F.col("InvoiceId").alias("Invoice"), "InvoiceDate", "InvoiceNumber"))
    return _of(c.of_period("InvoiceItem", *period), inv, "Invoice", "invoices", staged).select(
        F.col("Item").alias("ItemId"), "InvoiceLineId", "CaseSize", "StockQty", "AdjustedTotal", "InvoiceDate", "InvoiceNumber")


USAGE_KINDS = (WASTE, TRANSFER_IN, TRANSFER_OUT)
COUNT_KINDS = (OPENING, ENDING)
ALL_KINDS = COUNT_KINDS + USAGE_KINDS + (PURCHASE,)


def _store_sources(c: Catalog, p: LedgerParams) -> DataFrame:
    """Usage sources at the store dated in the period: ``(UsageSource)``."""
    return (c.of_period("UsageSource", p.store, p.start, p.end)
            .where((F.col("Store") == p.store) & between(F.col("UsageDate"), p.start, p.end))
            .select(F.col("UsageSourceId").alias("UsageSource")))


def _usage_roles(c: Catalog, p: LedgerParams, kinds, staged: bool = False) -> DataFrame:
    """What each of the store's period usage sources records, keyed by
    ``UsageSource``: a waste event (dated by its waste date) and / or the
    store's own end of a transfer — ``Transfer In`` when that end is the
    receiver, ``Transfer Out`` when it is the sender — with the transfer id
    as reference and the other end's context id.

    Built from the period's usage sources outward: waste rows and transfer
    contexts are first cut to those sources (a small set), and only that
    small side meets the transfer table, so the full transfer history is
    never joined with the full context table.  ``staged``: the sources and
    their contexts are written, so that what they cut need not be shuffled."""
    sources = _store_sources(c, p)
    if staged:
        sources = stage(sources, "sources")
    period = (p.store, p.start, p.end)  # waste and contexts lie in the partition of their usage source
    parts = []
    if WASTE in kinds:
        parts.append(c.of_period("Waste", *period).join(sources, "UsageSource").select(
            "UsageSource", F.col("WasteDate").alias("ActivityDate"), F.lit(WASTE).alias("ActivityTypeName"),
            F.lit("").alias("PurchaseInfo"), F.lit(None).cast("bigint").alias("other_ctx")))
    roles = []
    for kind, own, other in ((TRANSFER_IN, "Receiver", "Sender"), (TRANSFER_OUT, "Sender", "Receiver")):
        if kind in kinds:
            roles.append(c["Transfer"].select(
                F.col(own).alias("own_ctx"), F.col("TransferDate").alias("ActivityDate"),
                F.lit(kind).alias("ActivityTypeName"), F.col("TransferId").cast("string").alias("PurchaseInfo"),
                F.col(other).alias("other_ctx")))
    if roles:
        tc = (c.of_period("TransferContext", *period).select(F.col("TransferContextId").alias("own_ctx"), "UsageSource")
              .join(sources, "UsageSource"))
        if staged:
            tc = stage(tc, "contexts")
        parts.append(tc.join(reduce(DataFrame.unionByName, roles), "own_ctx").drop("own_ctx"))
    return reduce(DataFrame.unionByName, parts)


def usage_activity(c: Catalog, p: LedgerParams, kinds=USAGE_KINDS, staged: bool = False) -> DataFrame:
    """Store usage rows tagged with the activity their source records: one
    join of the usage fact against all roles (which only hold the store's
    period usage sources), so the fact is read once for waste and both
    transfer directions."""
    iu = c.of_period("ItemUsage", p.store, p.start, p.end).select("UsageSource", "Item", "StockQty", "TrackingCost")
    return _of(iu, _usage_roles(c, p, kinds, staged), "UsageSource", "roles", staged)


@dataclass(frozen=True)
class PeriodLines:
    """The line facts of a store and period, as every step of the ledger needs
    them; ``staged`` if the purchases were written."""

    purchases: DataFrame
    usage: DataFrame
    staged: bool = False


def period_lines(c: Catalog, p: LedgerParams, kinds=USAGE_KINDS, staged: bool | None = None) -> PeriodLines:
    """Purchased and used lines of the store in the period.  The active items
    and the events are both made from them: staged (``stages``), each line
    fact is read once for the whole ledger; else once per reader."""
    purchases = _store_purchases(c, p)
    large = is_large(purchases, staged)
    if large:
        purchases = stage(_store_purchases(c, p, True), "purchases")
    usage = usage_activity(c, p, kinds) if kinds else None
    if kinds and is_large(usage, staged):
        usage = stage(usage_activity(c, p, kinds, True), "usage")
    return PeriodLines(purchases, usage, large)


def usage_events(c: Catalog, p: LedgerParams, kinds=USAGE_KINDS, lines: PeriodLines | None = None) -> DataFrame:
    """Waste and transfer activity per item and event in one aggregation:
    ``(ItemId, ActivityDate, ActivityTypeName, PurchaseInfo, SupplierName,
    q, v)`` with ``q = sum(StockQty)`` and ``v = sum(StockQty *
    TrackingCost)``.  Transfers are keyed by transfer id and carry the
    Identifier of the store at the other end, looked up after aggregating
    (a transfer whose other end is unknown is dropped, as an inner join
    would)."""
    agg = ((usage_activity(c, p, kinds) if lines is None else lines.usage)
           .groupBy(F.col("Item").alias("ItemId"), "ActivityDate", "ActivityTypeName", "PurchaseInfo", "other_ctx")
           .agg(F.sum("StockQty").alias("q"), F.sum(F.col("StockQty") * F.col("TrackingCost")).alias("v")))
    waste = agg.where(F.col("ActivityTypeName") == WASTE).withColumn("SupplierName", F.lit(None).cast("string"))
    waste = waste.drop("other_ctx")
    if set(kinds) == {WASTE}:
        return waste
    moved = agg.where(F.col("ActivityTypeName") != WASTE)
    # only the other ends of these transfers are looked up
    other = (c["TransferContext"].select(F.col("TransferContextId").alias("other_ctx"), F.col("Store").alias("other_store"))
             .join(moved.select("other_ctx").distinct(), "other_ctx", "left_semi"))
    named = lookup(other, c["Store"], "other_store", "StoreId", {"Identifier": "SupplierName"}).select("other_ctx", "SupplierName")
    moved = moved.join(named, "other_ctx").drop("other_ctx")
    return moved if WASTE not in kinds else waste.unionByName(moved)


def active_items(c: Catalog, p: LedgerParams, lines: PeriodLines | None = None) -> DataFrame:
    """Distinct items with a purchase, waste, transfer in or transfer out at
    the store in the period (counts alone do not make an item active)."""
    lines = lines or period_lines(c, p, staged=False)
    return distinct_keys([lines.purchases.select("ItemId"), lines.usage.select(F.col("Item").alias("ItemId"))], "ItemId")


def item_info(c: Catalog, p: LedgerParams) -> DataFrame:
    """Per tracked item at the store: current case size and its order code,
    case cost, item unit cost, reporting factor, four unit codes and
    category; distinct.  The order-code pattern is matched case-folded, and
    ``'%%'`` disables it (keeping items without an order code)."""
    detail = (c["ItemDetail"].where((F.col("Store") == p.store) & (F.col("TrackInventory") == 1))
              .select(F.col("Item").alias("ItemId"), F.col("CurrentCaseSize").alias("CaseSizeId")))
    cs = c["CaseSize"].select("CaseSizeId", "OrderCode", "CaseQty", "PakQty",
                              "PurchaseUom", "CaseUom", "PakUom")
    csc = (c["CaseSizeCost"].where(F.col("Store") == p.store)
           .select(F.col("CaseSize").alias("CaseSizeId"), "CaseCost"))
    iuc = (c["ItemUnitCost"].where((F.col("Store") == p.store) & (F.col("Active") == 1))
           .select(F.col("Item").alias("ItemId"), "TrackingCost"))
    icf = reporting_factor(c).withColumnRenamed("Item", "ItemId")
    items = c["Item"].select("ItemId", "ItemGroup")
    # Joins grouped by key: case-size tables first (keyed by case size), then
    # every item-keyed table, so the wide row is shuffled by CaseSizeId once
    # and by ItemId once; the distinct and the later joins on ItemId reuse
    # that last partitioning.
    packs = cs.join(by_shuffle(csc), "CaseSizeId")
    if p.order_code_like != MATCH_ALL:
        packs = packs.where(like(F.col("OrderCode"), p.order_code_like, fold_case=True))
    j = detail.join(by_shuffle(packs), "CaseSizeId")
    for by_item in (items, iuc, icf):
        j = j.join(by_shuffle(by_item), "ItemId")
    j = with_category(c, packaging_units(c, j))
    return j.select(*INFO_COLUMNS).distinct()


def _items_like(c: Catalog, p: LedgerParams) -> DataFrame:
    return (c["Item"].where(like(F.col("Descrip"), p.item_like, fold_case=True))
            .select("ItemId", F.col("Descrip").alias("ItemDescrip")))


def _info_fields(store_label: Column) -> dict[str, Column]:
    """Ledger columns that come from the item lookup (``info``)."""
    return dict(
        StoreName=store_label,
        OrderCode=F.col("OrderCode"),
        CaseCost=F.col("CaseCost"),
        CaseQty=F.col("CaseQty"),
        PakQty=F.col("PakQty"),
        UnitCost=reporting_cost(F.col("TrackingCost"), F.col("ReportingConversionFactor")),
        PurchaseUom=F.col("PurchaseUom"),
        CaseUom=F.col("CaseUom"),
        PakUom=F.col("PakUom"),
        ReportingUom=F.col("ReportingUom"),
    )


# --------------------------------------------------------------------------
# Branches
# --------------------------------------------------------------------------

def count_events(c: Catalog, p: LedgerParams, active: DataFrame, kinds=COUNT_KINDS, staged: bool = False) -> DataFrame:
    """Lines of the store's finalized counts opened (``Opening Inventory``)
    or closed (``Ending Inventory``) in the period, active items only: a
    count with both dates in the period gives both rows.  ``staged``: the
    counts are written and their lines cut to them."""
    roles = []
    for kind, col in ((OPENING, "OpenDate"), (ENDING, "CloseDate")):
        if kind in kinds:
            roles.append(c.of_period("Inventory", p.store).where(
                (F.col("Store") == p.store) & F.col("Finalized").isNotNull() & between(F.col(col), p.start, p.end))
                .select(F.col("InventoryId").alias("Inventory"), F.col(col).alias("ActivityDate"),
                        F.lit(kind).alias("ActivityTypeName"), *c.partition_columns("Inventory", "InventorySummary")))
    inv = reduce(DataFrame.unionByName, roles)
    lines = _of(c.of_headers("InventorySummary", inv), inv, "Inventory", "counts", staged).select(
        F.col("Item").alias("ItemId"), "ActivityDate", "ActivityTypeName", "QtyOnHand", "PreppedQty",
        "TotalValue")
    return lines.join(by_shuffle(active), "ItemId", "left_semi")


def info_ledger(c: Catalog, p: LedgerParams, info: DataFrame, active: DataFrame | None,
                kinds=ALL_KINDS, lines: PeriodLines | None = None, apart: bool = False) -> DataFrame:
    """Ledger rows of the given kinds, joined to the item and to the item
    lookup once for all of them; ``apart``: the events of staged lines are
    written before, which halves the plan that the driver has to hold.  Counts, waste and transfers take packaging
    and costs from the lookup; purchases carry their line's own values and
    take only the reporting factor from it (the lookup join still repeats a
    purchase once per lookup row, as every branch does).  Quantities are in
    stock units until divided by the factor."""
    parts = []
    if set(kinds) & set(COUNT_KINDS):
        counts = count_events(c, p, active, kinds, lines is not None and lines.staged)
        parts.append(counts.select(
            "ItemId", "ActivityDate", "ActivityTypeName", F.lit("").alias("PurchaseInfo"),
            F.lit(None).cast("string").alias("SupplierName"),
            (F.col("QtyOnHand") + F.col("PreppedQty")).alias("raw_qty"),
            F.col("TotalValue").alias("raw_value"), F.lit(True).alias("is_count")))
    if set(kinds) & set(USAGE_KINDS):
        ev = usage_events(c, p, [k for k in USAGE_KINDS if k in kinds], lines)
        # Transfers in keep the usage value's sign; waste and transfers out negate it.
        value = F.when(F.col("ActivityTypeName") == TRANSFER_IN, F.col("v")).otherwise(-F.col("v"))
        parts.append(ev.select("ItemId", "ActivityDate", "ActivityTypeName", "PurchaseInfo", "SupplierName",
                               (-F.col("q")).alias("raw_qty"), value.alias("raw_value"),
                               F.lit(False).alias("is_count")))
    if PURCHASE in kinds:
        parts.append(purchase_events(c, p, lines))
    no_line = [F.lit(False).alias("is_line")] + [F.lit(None).cast(t).alias(f"line_{k}")
                                                   for k, t in LINE_FIELDS.items()]
    parts = [part if "is_line" in part.columns else part.select("*", *no_line) for part in parts]
    events = reduce(DataFrame.unionByName, parts)
    if apart and lines is not None and lines.staged:
        events = stage(events, "events")
    alike = [x for x in INFO_COLUMNS if x != "CategoryName"]
    info = info.groupBy(*alike).agg(F.count(F.lit(1)).cast("int").alias("copies"))
    j = events.join(by_shuffle(_items_like(c, p)), "ItemId").join(by_shuffle(info), "ItemId")
    summed = F.col("ActivityTypeName").isin(*USAGE_KINDS)
    times = F.when(summed, F.col("copies")).otherwise(1)
    j = (j.withColumn("raw_qty", F.col("raw_qty") * times).withColumn("raw_value", F.col("raw_value") * times)
         .withColumn("_n", F.explode(F.sequence(F.lit(1), F.when(summed, 1).otherwise(F.col("copies"))))).drop("_n"))
    qty = reporting_qty(F.col("raw_qty"), F.col("ReportingConversionFactor"))
    from_info = _info_fields(store_name(c, p.store))
    fields = {k: (F.when(F.col("is_line"), F.col(f"line_{k}")).otherwise(v) if k in LINE_FIELDS else v)
              for k, v in from_info.items()}
    return j.select(*as_ledger(
        ItemId=F.col("ItemId"), ItemDescrip=F.col("ItemDescrip"), ActivityDate=F.col("ActivityDate"),
        ActivityTypeName=F.col("ActivityTypeName"), Amount=qty,
        QtyOnHand=F.when(F.col("is_count"), qty).otherwise(F.lit(0)), Value=F.col("raw_value"),
        PurchaseInfo=F.col("PurchaseInfo"), SupplierName=F.col("SupplierName"), **fields))


def _branch(c: Catalog, p: LedgerParams, info: DataFrame | None, active: DataFrame | None, kind: str):
    info = item_info(c, p) if info is None else info
    if kind in COUNT_KINDS and active is None:
        active = active_items(c, p)
    return info_ledger(c, p, info, active, (kind,))


def ledger_opening_inventory(c: Catalog, p: LedgerParams, info: DataFrame | None = None,
                             active: DataFrame | None = None) -> DataFrame:
    """Finalized counts of the store opened in the period, active items only."""
    return _branch(c, p, info, active, OPENING)


def ledger_ending_inventory(c: Catalog, p: LedgerParams, info: DataFrame | None = None,
                            active: DataFrame | None = None) -> DataFrame:
    """Finalized counts of the store closed in the period, active items only."""
    return _branch(c, p, info, active, ENDING)


def ledger_waste(c: Catalog, p: LedgerParams, info: DataFrame | None = None) -> DataFrame:
    """Waste per item and waste date (store and period tested on the usage
    source): quantity and value are negated sums."""
    return _branch(c, p, info, None, WASTE)


def ledger_transfer_in(c: Catalog, p: LedgerParams, info: DataFrame | None = None) -> DataFrame:
    """Receipts by transfer, per item and transfer; counterparty = the
    sending store's Identifier; the value keeps the usage sign."""
    return _branch(c, p, info, None, TRANSFER_IN)


def ledger_transfer_out(c: Catalog, p: LedgerParams, info: DataFrame | None = None) -> DataFrame:
    """Shipments by transfer, per item and transfer; counterparty = the
    receiving store's Identifier."""
    return _branch(c, p, info, None, TRANSFER_OUT)


LINE_FIELDS = {
    # ledger column: type of the line-level value a purchase row carries
    "OrderCode": T.StringType(), "CaseCost": MONEY, "CaseQty": QTY, "PakQty": QTY,
    "UnitCost": T.DecimalType(24, 7), "PurchaseUom": S, "CaseUom": S, "PakUom": S, "ReportingUom": S,
}


def purchase_events(c: Catalog, p: LedgerParams, lines: PeriodLines | None = None) -> DataFrame:
    """Invoice lines of the store in the period, one row per line (per credit
    when a line has several): quantity net of credits, value as invoiced,
    and the packaging, vendor, case cost, unit cost and units of the line's
    own case size and of the item at the store (``line_*`` columns).

    Every such item is active by construction (the active set is built from
    these same lines), so no semi-join is needed.  Over staged lines the
    credits are cut to theirs."""
    lines = lines or period_lines(c, p, (), staged=False)
    credits = c.of_period("InvoiceRFC", p.store, p.start, p.end).select(F.col("InvoiceItem").alias("InvoiceLineId"),
                                                                        F.col("StockQty").alias("credit"))
    if lines.staged:
        credits = credits.where(F.col("InvoiceLineId").isin(lines.purchases.select("InvoiceLineId")))
    cs = c["CaseSize"].select(F.col("CaseSizeId").alias("CaseSize"), "Supplier", "OrderCode",
                              "CaseQty", "PakQty", "PurchaseUom", "CaseUom", "PakUom")
    if p.order_code_like != MATCH_ALL:
        cs = cs.where(like(F.col("OrderCode"), p.order_code_like, case_insensitive=p.case_insensitive))
    iuc = (c["ItemUnitCost"].where((F.col("Store") == p.store) & (F.col("Active") == 1))
           .select(F.col("Item").alias("ItemId"), "TrackingCost"))
    csc = c["CaseSizeCost"].where(F.col("Store") == p.store).select("CaseSize", "CaseCost")
    icf = reporting_factor(c).select(F.col("Item").alias("ItemId"),
                                     F.col("ReportingConversionFactor").alias("line_factor"),
                                     "ReportingUom")
    # Grouped by key: line-keyed credits, then the case-size tables (joined
    # to each other first), then the item-keyed tables; the vendor and the
    # units are looked up for the lines, not for all case sizes.
    j = (lines.purchases.join(by_shuffle(credits), "InvoiceLineId", "left")
         .join(by_shuffle(cs.join(by_shuffle(csc), "CaseSize")), "CaseSize")
         .join(by_shuffle(iuc), "ItemId").join(by_shuffle(icf), "ItemId"))
    j = packaging_units(c, lookup(j, c["Vendor"], "Supplier", "SupplierId", {"Name": "SupplierName"}, drop_key=True))
    line = {
        "OrderCode": F.col("OrderCode"), "CaseCost": F.col("CaseCost"), "CaseQty": F.col("CaseQty"),
        "PakQty": F.col("PakQty"), "UnitCost": reporting_cost(F.col("TrackingCost"), F.col("line_factor")),
        "PurchaseUom": F.col("PurchaseUom"), "CaseUom": F.col("CaseUom"), "PakUom": F.col("PakUom"),
        "ReportingUom": F.col("ReportingUom"),
    }
    return j.select(
        "ItemId", F.col("InvoiceDate").alias("ActivityDate"), F.lit(PURCHASE).alias("ActivityTypeName"),
        F.col("InvoiceNumber").alias("PurchaseInfo"), "SupplierName",
        (F.col("StockQty") - F.coalesce(F.col("credit"), F.lit(0))).alias("raw_qty"),
        F.col("AdjustedTotal").alias("raw_value"), F.lit(False).alias("is_count"), F.lit(True).alias("is_line"),
        *[line[k].cast(t).alias(f"line_{k}") for k, t in LINE_FIELDS.items()])


def ledger_purchases(c: Catalog, p: LedgerParams, info: DataFrame | None = None) -> DataFrame:
    """Purchases: one ledger row per invoice line (and credit), with the
    line's own packaging, vendor and costs; the quantity is converted with
    the item lookup's factor."""
    return _branch(c, p, info, None, PURCHASE)


def activity_ledger(c: Catalog, p: LedgerParams, info: DataFrame | None = None,
                    with_subtotals: bool = False, staged: bool | None = None, apart: bool = False) -> DataFrame:
    """All six activity kinds in the 19-column ledger shape (bag union),
    built together in ``info_ledger`` from one set of period lines."""
    info = item_info(c, p) if info is None else info
    lines = period_lines(c, p, staged=staged)
    ledger = info_ledger(c, p, info, active_items(c, p, lines), lines=lines, apart=apart)
    return _with_subtotals(ledger) if with_subtotals else ledger


def _with_subtotals(ledger: DataFrame) -> DataFrame:
    """The ledger with a subtotal row per item, from one evaluation: every
    row goes out twice, as itself (a group of its own) and into its item's
    subtotal (partial sums before the shuffle)."""
    both = ledger.withColumn("_row", F.monotonically_increasing_id()).withColumn("_sub", F.explode(F.array(F.lit(False), F.lit(True))))
    kept = {"ItemDescrip", "StoreName"}
    summed = {"Amount", "Value"}
    cells = [F.sum(x).alias(x) if x in summed else F.max(F.col(x) if x in kept else F.when(~F.col("_sub"), F.col(x))).alias(x)
             for x in LEDGER_COLUMNS if x != "ItemId"]
    rows = both.groupBy("ItemId", "_sub", F.when(~F.col("_sub"), F.col("_row")).alias("_row")).agg(*cells)
    label = {"ActivityTypeName": F.lit(SUBTOTAL), "PurchaseInfo": F.lit("")}
    return rows.select(*as_ledger(**{x: F.when(F.col("_sub"), label[x]).otherwise(F.col(x)) if x in label else F.col(x) for x in LEDGER_COLUMNS}))


def activity_subtotal(ledger: DataFrame) -> DataFrame:
    """One subtotal row per item (the original report's optional, commented-out
    step): summed quantity and value, other columns empty."""
    agg = ledger.groupBy("ItemId").agg(
        F.max("ItemDescrip").alias("ItemDescrip"), F.sum("Amount").alias("Amount"),
        F.sum("Value").alias("Value"), F.max("StoreName").alias("StoreName"))
    none = F.lit(None)
    return agg.select(*as_ledger(
        ItemId=F.col("ItemId"), ItemDescrip=F.col("ItemDescrip"), ActivityDate=none,
        ActivityTypeName=F.lit(SUBTOTAL), Amount=F.col("Amount"), QtyOnHand=none,
        Value=F.col("Value"), PurchaseInfo=F.lit(""), StoreName=F.col("StoreName"),
        SupplierName=none, OrderCode=none, CaseCost=none, CaseQty=none, PakQty=none,
        UnitCost=none, PurchaseUom=none, CaseUom=none, PakUom=none, ReportingUom=none))


def ledger_unit_cost(ledger: DataFrame) -> DataFrame:
    """Ledger rows with a unit cost derived from the activity value and
    quantity (value / quantity, NULL for a zero or missing quantity), in the
    ledger's money type."""
    return ledger.select(
        "ItemId", "ActivityDate", "ActivityTypeName", "PurchaseInfo", "Amount", "Value",
        unit_cost_from_value(F.col("Value"), F.col("Amount")).cast(MONEY).alias("UnitCostFromValue"))
