"""Domain tables of the stock-control model, derived from the test tables.

The reports read about thirty base tables (items, case sizes, invoices,
usage, transfers, counts, requisitions ...).  The test data is a TPC-H-like
star schema, so each domain table is a deterministic projection of one or two
of those tables (rules in FIXTURES.md §2).  Everything here is lazy
DataFrame code: a report that filters on ``Store`` and a date range gets its
predicates pushed through these projections into the Parquet scans of
``orders`` and ``lineitem``.

Each builder takes a ``raw(name) -> DataFrame`` accessor (``RawTables``) for the test tables
and a ``dom(name) -> DataFrame`` accessor for already-derived domain tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QTY = T.DecimalType(11, 3)
MONEY = T.DecimalType(12, 4)
VALUE = T.DecimalType(15, 4)
NTZ = T.TimestampNTZType()

# The unit-of-measure reference list of the fixtures.
UOM_ROWS = [
    (0, "EA", "Each"),
    (1, "CS", "Case"),
    (2, "KG", "Kilogram"),
    (3, "LB", "Pound"),
    (4, "ea", "each (lower)"),
]

class RawTables:
    """The test tables of one folder, each opened once.

    The two facts that the fixture rules spread over every table, the store
    list and the supplier key range, are read once per folder and become
    literals: as scalar subqueries they would stand in a report's plan a
    hundred times, to be analysed each time.  Their size is that of the store
    list, which every per-store table multiplies by anyway."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder, self._frames = spark, folder, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._spark.read.parquet(f"{self._folder.rstrip('/')}/{name}.parquet")
        return self._frames[name]

    @cached_property
    def stores(self) -> list[int]:
        """Region keys in order."""
        keys = self("region").select(F.col("r_regionkey").cast("int").alias("k")).where("k IS NOT NULL").distinct()
        return sorted(r.k for r in keys.collect())

    @cached_property
    def suppliers(self) -> int | None:
        """One above the greatest supplier key."""
        top = self("supplier").agg(F.max("s_suppkey")).head()[0]
        return None if top is None else top + 1


def _stores(raw) -> Column:
    """The store ids in order, as one array."""
    return F.array(*[F.lit(k) for k in raw.stores]).cast("array<int>")


def _store_of(raw, key: Column) -> Column:
    """Stores are dealt by key over the whole store list."""
    return F.element_at(_stores(raw), (F.pmod(key, F.lit(len(raw.stores))) + 1).cast("int"))


def _supplier_of(raw, key: Column) -> Column:
    """Suppliers are dealt by key over the whole supplier key range."""
    return F.pmod(key, F.lit(raw.suppliers).cast("bigint"))


def _brand_no(p_brand: Column) -> Column:
    return F.substring_index(p_brand, "#", -1).cast("int")


def _line_id(orderkey: Column, linenumber: Column, copy=0) -> Column:
    """Key of an order's line: room for 99 line numbers and 9,999 rows each."""
    return orderkey * 1_000_000 + linenumber * 10_000 + copy


def store(raw, dom, spark: SparkSession) -> DataFrame:
    r = raw("region")
    return r.select(
        r.r_regionkey.cast("int").alias("StoreId"),
        r.r_name.alias("Name"),
        r.r_name.alias("Identifier"),
    )


def uom(raw, dom, spark: SparkSession) -> DataFrame:
    # An inline VALUES table is a LocalRelation: the planner knows its exact
    # size and broadcasts it directly.  (A DataFrame made from a Python list
    # is an RDD scan without statistics, which costs a shuffle stage per join
    # before AQE notices it is tiny.)
    def lit(v):
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    rows = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in UOM_ROWS)
    return spark.sql(f"SELECT CAST(UomId AS INT) AS UomId, Uom, Descrip "
                     f"FROM VALUES {rows} AS t(UomId, Uom, Descrip)")


def vendor(raw, dom, spark: SparkSession) -> DataFrame:
    s = raw("supplier")
    prefix = (F.when(s.s_suppkey % 7 == 0, F.lit("7 "))
              .when(s.s_suppkey % 7 == 1, F.lit("$ "))
              .otherwise(F.lit("")))
    return s.select(s.s_suppkey.alias("SupplierId"),
                    F.concat(prefix, s.s_name).alias("Name"))


def employee(raw, dom, spark: SparkSession) -> DataFrame:
    c = raw("customer")
    return c.select(c.c_custkey.alias("EmployeeId"), c.c_name.alias("FirstName"))


def location(raw, dom, spark: SparkSession) -> DataFrame:
    n = raw("nation")
    return n.select(n.n_nationkey.cast("int").alias("LocationId"), n.n_name.alias("Name"))


def item_group(raw, dom, spark: SparkSession) -> DataFrame:
    brand = _brand_no(raw("part").p_brand)
    return (raw("part").select(brand.alias("GroupId"), (brand % 6).alias("Category"))
            .distinct())


def category(raw, dom, spark: SparkSession) -> DataFrame:
    cat = _brand_no(raw("part").p_brand) % 6
    return (raw("part").select(cat.alias("CategoryId")).distinct()
            .select("CategoryId",
                    F.concat(F.lit("CAT-"), F.col("CategoryId").cast("string")).alias("Name")))


def item(raw, dom, spark: SparkSession) -> DataFrame:
    p = raw("part")
    return p.select(p.p_partkey.alias("ItemId"), p.p_name.alias("Descrip"),
                    _brand_no(p.p_brand).alias("ItemGroup"))


def item_conversion_factor(raw, dom, spark: SparkSession) -> DataFrame:
    p = raw("part")
    factor = (F.when(p.p_size % 4 == 0, 0).when(p.p_size % 4 == 1, 1)
              .when(p.p_size % 4 == 2, 2).otherwise(4))
    return p.where(p.p_partkey % 50 != 0).select(
        p.p_partkey.alias("Item"),
        factor.cast(QTY).alias("ReportingConversionFactor"),
        (p.p_size % 5).cast("int").alias("ReportingUom"),
    )


def case_size(raw, dom, spark: SparkSession) -> DataFrame:
    p = raw("part")
    n = F.explode(F.array(F.lit(0), F.lit(1))).alias("n")
    base = p.select("p_partkey", "p_size", n)
    cs_id = base.p_partkey * 2 + base.n
    return base.select(
        cs_id.alias("CaseSizeId"),
        base.p_partkey.alias("Item"),
        _supplier_of(raw, base.p_partkey).alias("Supplier"),
        F.when(cs_id % 11 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("OC-"), cs_id.cast("string"))).alias("OrderCode"),
        (base.p_size % 12 + 1).cast(QTY).alias("CaseQty"),
        (base.p_size % 6 + 1).cast(QTY).alias("PakQty"),
        (base.p_size % 5).cast("int").alias("PurchaseUom"),
        ((base.p_size + 1) % 5).cast("int").alias("CaseUom"),
        ((base.p_size + 2) % 5).cast("int").alias("PakUom"),
    )


def case_size_cost(raw, dom, spark: SparkSession) -> DataFrame:
    cs = dom("CaseSize").select("CaseSizeId", "CaseQty", "PakQty", _each_store(raw))
    return cs.select(
        F.col("CaseSizeId").alias("CaseSize"),
        F.col("StoreId").alias("Store"),
        (F.col("CaseQty") * F.col("PakQty") + F.col("StoreId")).cast(MONEY).alias("CaseCost"),
    )


def _each_store(raw) -> Column:
    """Generator column: one output row per store id (a row-local explode,
    so per-store tables need no join)."""
    return F.explode(_stores(raw)).alias("StoreId")


def _part_by_store(raw, dom, cols) -> DataFrame:
    return raw("part").select(*cols, _each_store(raw))


def item_detail(raw, dom, spark: SparkSession) -> DataFrame:
    ps = _part_by_store(raw, dom, ["p_partkey"])
    return ps.select(
        ps.p_partkey.alias("Item"),
        ps.StoreId.alias("Store"),
        (ps.p_partkey * 2 + ps.StoreId % 2).alias("CurrentCaseSize"),
        F.when((ps.p_partkey + ps.StoreId) % 10 == 0, 0).otherwise(1).alias("TrackInventory"),
    )


def item_unit_cost(raw, dom, spark: SparkSession) -> DataFrame:
    ps = _part_by_store(raw, dom, ["p_partkey", "p_size"])
    active = F.explode(F.array(F.lit(0), F.lit(1))).alias("Active")
    return ps.select(
        ps.p_partkey.alias("Item"),
        ps.StoreId.alias("Store"),
        (ps.p_size * F.lit(0.25).cast("decimal(3,2)")).cast(MONEY).alias("TrackingCost"),
        active,
    )


def item_qty_on_hand(raw, dom, spark: SparkSession) -> DataFrame:
    ps = _part_by_store(raw, dom, ["p_partkey", "p_size"])
    return ps.select(ps.p_partkey.alias("Item"), ps.StoreId.alias("Store"),
                     (ps.p_size * ps.StoreId).cast(QTY).alias("QtyOnHand"))


def item_last_received(raw, dom, spark: SparkSession) -> DataFrame:
    ii = dom("InvoiceItem").select("Invoice", "Item")
    inv = dom("Invoice").select("InvoiceId", "Store", "InvoiceDate")
    return (ii.join(inv, ii.Invoice == inv.InvoiceId)
            .groupBy("Item", "Store").agg(F.max("InvoiceDate").alias("LastReceived")))


def key_item_detail(raw, dom, spark: SparkSession) -> DataFrame:
    ps = _part_by_store(raw, dom, ["p_partkey", "p_size"])
    return ps.where(ps.p_partkey % 9 != 0).select(
        ps.p_partkey.alias("Item"), ps.StoreId.alias("Store"),
        (ps.p_size % 30).cast("int").alias("PrimaryLocation"))


def invoice(raw, dom, spark: SparkSession) -> DataFrame:
    o = raw("orders")
    return o.select(
        o.o_orderkey.alias("InvoiceId"),
        _store_of(raw, o.o_custkey).alias("Store"),
        o.o_orderdate.alias("InvoiceDate"),
        F.concat(F.lit("INV-"), o.o_orderkey.cast("string")).alias("InvoiceNumber"),
        _supplier_of(raw, o.o_custkey).alias("Supplier"),
    )


def _numbered(raw, flags: Column) -> DataFrame:
    """Line rows with a key of their own.  (order, line number) is not unique
    in lineitem, so the rows of a pair are numbered by all their columns,
    within the return flag (a filter on it passes below the numbering).  The
    numbering is dropped from plans that do not use the key."""
    li = raw("lineitem").where(flags)
    order = Window.partitionBy("l_orderkey", "l_linenumber", "l_returnflag").orderBy(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate")
    copy = 2 * F.row_number().over(order) + F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    return li.withColumn("line_id", _line_id(F.col("l_orderkey"), F.col("l_linenumber"), copy))


def invoice_item(raw, dom, spark: SparkSession) -> DataFrame:
    li = _numbered(raw, F.col("l_returnflag") != "A")
    return li.select(
        li.line_id.alias("InvoiceLineId"),
        li.l_orderkey.alias("Invoice"),
        li.l_partkey.alias("Item"),
        (li.l_partkey * 2 + li.l_linenumber % 2).alias("CaseSize"),
        li.l_quantity.cast(QTY).alias("StockQty"),
        li.l_extendedprice.cast(MONEY).alias("AdjustedTotal"),
    )


def invoice_rfc(raw, dom, spark: SparkSession) -> DataFrame:
    """A credit for half of every returned line, and a second one for a
    quarter where the line number is a multiple of three."""
    li = _numbered(raw, F.col("l_returnflag") == "R")
    parts = F.when(li.l_linenumber % 3 == 0, F.array(F.lit(2), F.lit(4))).otherwise(F.array(F.lit(2)))
    each = li.select("line_id", "l_quantity", F.explode(parts).alias("part"))
    return each.select(each.line_id.alias("InvoiceItem"), F.floor(each.l_quantity / each.part).cast(QTY).alias("StockQty"))


def usage_source(raw, dom, spark: SparkSession) -> DataFrame:
    o = raw("orders")
    return o.select(o.o_orderkey.alias("UsageSourceId"), _store_of(raw, o.o_custkey).alias("Store"),
                    o.o_orderdate.alias("UsageDate"))


def item_usage(raw, dom, spark: SparkSession) -> DataFrame:
    li = raw("lineitem").where(F.col("l_returnflag") == "A")
    p = raw("part").select("p_partkey", "p_size")
    # by shuffle: the planner would broadcast the parts by the few bytes of their file
    j = li.join(p.hint("merge"), li.l_partkey == p.p_partkey)
    qty = F.when(j.l_orderkey % 3 == 2, -j.l_quantity).otherwise(j.l_quantity)
    return j.select(
        j.l_orderkey.alias("UsageSource"),
        j.l_partkey.alias("Item"),
        qty.cast(QTY).alias("StockQty"),
        (j.p_size * F.lit(0.25).cast("decimal(3,2)")).cast(MONEY).alias("TrackingCost"),
    )


def waste(raw, dom, spark: SparkSession) -> DataFrame:
    o = raw("orders")
    return o.where(o.o_orderkey % 3 == 0).select(
        o.o_orderkey.alias("UsageSource"), o.o_orderdate.alias("WasteDate"))


def transfer_context(raw, dom, spark: SparkSession) -> DataFrame:
    o = raw("orders")
    return o.where(o.o_orderkey % 3 != 0).select(
        o.o_orderkey.alias("TransferContextId"), o.o_orderkey.alias("UsageSource"),
        _store_of(raw, o.o_custkey).alias("Store"))


def transfer(raw, dom, spark: SparkSession) -> DataFrame:
    o = raw("orders")
    return o.where(o.o_orderkey % 3 == 1).select(
        o.o_orderkey.alias("TransferId"), o.o_orderdate.alias("TransferDate"),
        o.o_orderkey.alias("Sender"), (o.o_orderkey + 1).alias("Receiver"))


def _inventory_key(raw) -> DataFrame:
    """(store, month) of each order, with the count id of that month."""
    o, n = raw("orders"), F.lit(len(raw.stores))
    return o.select(
        "o_orderkey",
        _store_of(raw, o.o_custkey).alias("Store"),
        F.year(o.o_orderdate).alias("y"),
        F.month(o.o_orderdate).alias("m"),
        F.last_day(o.o_orderdate).alias("month_end"),
        F.pmod(o.o_custkey, n).alias("place"), n.alias("stores"),
    ).withColumn("InventoryId", ((F.col("y") * 12 + F.col("m")) * F.col("stores") + F.col("place")).cast("int"))


def inventory(raw, dom, spark: SparkSession) -> DataFrame:
    k = _inventory_key(raw).select("InventoryId", "Store", "m", "month_end").distinct()
    close = k.month_end.cast(NTZ)
    return k.select(
        "InventoryId", "Store",
        F.date_add(k.month_end, 1).cast(NTZ).alias("OpenDate"),
        close.alias("CloseDate"),
        F.when(k.m == 7, F.lit(None).cast(NTZ)).otherwise(close).alias("Finalized"),
    )


def inventory_summary(raw, dom, spark: SparkSession) -> DataFrame:
    k = _inventory_key(raw).select("o_orderkey", "InventoryId")
    li = raw("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    j = li.join(k, li.l_orderkey == k.o_orderkey)
    g = j.groupBy("InventoryId", "l_partkey").agg(
        F.sum(j.l_quantity.cast(QTY)).alias("q"),
        F.count(F.lit(1)).alias("n"),
        F.sum(j.l_extendedprice.cast(VALUE)).alias("v"),
    )
    return g.select(
        g.InventoryId.alias("Inventory"), g.l_partkey.alias("Item"),
        g.q.cast(QTY).alias("QtyOnHand"), g.n.cast(QTY).alias("PreppedQty"),
        g.v.cast(VALUE).alias("TotalValue"),
    )


def requisition(raw, dom, spark: SparkSession) -> DataFrame:
    o = raw("orders")
    return o.select(
        o.o_orderkey.alias("RequisitionId"),
        _store_of(raw, o.o_custkey).alias("SendingStore"),
        _store_of(raw, o.o_custkey + 1).alias("ReceivingStore"),
        o.o_orderpriority.alias("Description"),
        F.when(o.o_orderkey % 4 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("note "), o.o_orderstatus)).alias("Notes"),
        o.o_orderdate.alias("DateRequired"),
    )


def requisition_status(raw, dom, spark: SparkSession) -> DataFrame:
    li = raw("lineitem")
    status = (F.when(li.l_returnflag == "N", "P").when(li.l_returnflag == "A", "A")
              .when(li.l_returnflag == "R", "F"))
    return li.select(li.l_orderkey.alias("Requisition"), status.alias("Status"),
                     li.l_shipdate.alias("EffectiveDate"), li.l_suppkey.alias("Employee"))


def requisition_item(raw, dom, spark: SparkSession) -> DataFrame:
    """One line per (order, line number); repeated rows are its history and
    the item is that of the row with the greatest part key."""
    g = raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"))
    return g.select(_line_id(g.l_orderkey, g.l_linenumber).alias("RequisitionItemId"),
                    g.l_orderkey.alias("Requisition"), g.part.alias("Item"))


def requisition_item_status(raw, dom, spark: SparkSession) -> DataFrame:
    li = raw("lineitem")
    return li.select(
        _line_id(li.l_orderkey, li.l_linenumber).alias("RequisitionItem"),
        li.l_suppkey.alias("RequisitionStatus"),
        li.l_quantity.cast(QTY).alias("Qty"),
        (li.l_suppkey % 5).cast("int").alias("Uom"),
    )


BUILDERS = {
    "Store": store,
    "Uom": uom,
    "Vendor": vendor,
    "Employee": employee,
    "Location": location,
    "ItemGroup": item_group,
    "Category": category,
    "Item": item,
    "ItemConversionFactor": item_conversion_factor,
    "CaseSize": case_size,
    "CaseSizeCost": case_size_cost,
    "ItemDetail": item_detail,
    "ItemUnitCost": item_unit_cost,
    "ItemQtyOnHand": item_qty_on_hand,
    "ItemLastReceived": item_last_received,
    "KeyItemDetail": key_item_detail,
    "Invoice": invoice,
    "InvoiceItem": invoice_item,
    "InvoiceRFC": invoice_rfc,
    "UsageSource": usage_source,
    "ItemUsage": item_usage,
    "Waste": waste,
    "TransferContext": transfer_context,
    "Transfer": transfer,
    "Inventory": inventory,
    "InventorySummary": inventory_summary,
    "Requisition": requisition,
    "RequisitionStatus": requisition_status,
    "RequisitionItem": requisition_item,
    "RequisitionItemStatus": requisition_item_status,
}

DOMAIN_TABLES = tuple(BUILDERS)
