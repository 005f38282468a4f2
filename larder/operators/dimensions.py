"""Dimension operators shared by the reports.

The small reference lists (``Uom``, ``Store``, ``Location``, ``Category``,
``ItemGroup``) are joined with plain equi-joins and no hint: Spark broadcasts
them from their estimated size, and AQE converts a join to a broadcast from
the measured size of a shuffled side.  Nothing here forces a broadcast of a
table whose size grows with the data (items, case sizes, vendors), and the
item tables of the search are kept from being broadcast (``by_shuffle``).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import PRODUCT, RATIO, contains_pattern, like, reporting_cost, reporting_qty
from ..sources import Catalog
from .keyed import by_shuffle
from .receipts import receipts


def lookup(df: DataFrame, dim: DataFrame, left_key: str, dim_key: str,
           take: Mapping[str, str], how: str = "inner", drop_key: bool = False) -> DataFrame:
    """Equi-join ``df.left_key = dim.dim_key`` and bring in ``dim`` columns
    renamed per ``take`` (``{dim_column: new_name}``).  With
    ``drop_key=True`` the left key column is dropped (used when a code
    replaces its id under the same name)."""
    # Positional internal names: two lookups of the same dimension columns
    # build the same plan, so Spark reuses one broadcast / exchange for both.
    tmp = {dst: f"__v{i}" for i, dst in enumerate(take.values())}
    d = dim.select(F.col(dim_key).alias("__k"),
                   *[F.col(src).alias(tmp[dst]) for src, dst in take.items()])
    out = df.join(d, df[left_key] == d["__k"], how).drop("__k")
    if drop_key:
        out = out.drop(left_key)
    for dst, t in tmp.items():
        out = out.withColumnRenamed(t, dst)
    return out


def with_category(c: Catalog, df: DataFrame, how: str = "inner",
                  group_col: str = "ItemGroup", name: str = "CategoryName") -> DataFrame:
    """Item -> group -> category name (inner in the ledger, pick sheet and
    search; left in the usage summary)."""
    out = lookup(df, c["ItemGroup"], group_col, "GroupId", {"Category": "__cat"}, how)
    return lookup(out, c["Category"], "__cat", "CategoryId", {"Name": name}, how).drop("__cat")


def with_uom_codes(c: Catalog, df: DataFrame, roles: Mapping[str, str],
                   how: str = "inner", field: str = "Uom") -> DataFrame:
    """Replace unit ids by unit codes, one role per column (the Uom list joined
    once per role: purchase, case, pak, reporting).  ``roles`` maps the id
    column to the output column."""
    out = df
    for id_col, out_col in roles.items():
        out = lookup(out, c["Uom"], id_col, "UomId", {field: out_col}, how, drop_key=True)
    return out


def packaging_units(c: Catalog, case_sizes: DataFrame, how: str = "inner") -> DataFrame:
    """Case size -> purchase, case and pak unit codes."""
    return with_uom_codes(c, case_sizes, {"PurchaseUom": "PurchaseUom", "CaseUom": "CaseUom",
                                          "PakUom": "PakUom"}, how)


def store_name(c: Catalog, store: int) -> Column:
    """Display name of one store as a scalar subquery (NULL when unknown).
    Evaluated once per query, not per row."""
    return c["Store"].where(F.col("StoreId") == F.lit(store)).select("Name").scalar()


def with_store_name(c: Catalog, df: DataFrame, store_col: str, name: str = "StoreName") -> DataFrame:
    """Display name of the store in ``store_col``, per row (left join)."""
    return lookup(df, c["Store"], store_col, "StoreId", {"Name": name}, "left")


def item_primary_location(c: Catalog, store: int, name: str = "Item_Location") -> DataFrame:
    """Item -> name of its primary storage location at ``store``.  The
    location join is left: an unknown location id gives a NULL name."""
    kid = c["KeyItemDetail"].where(F.col("Store") == store).select("Item", "PrimaryLocation")
    return lookup(kid, c["Location"], "PrimaryLocation", "LocationId", {"Name": name}, "left") \
        .select("Item", name)


def reporting_factor(c: Catalog, how: str = "inner", uom_field: str = "Uom",
                     uom_name: str = "ReportingUom") -> DataFrame:
    """Item -> reporting conversion factor and reporting unit (code or long
    name, per ``uom_field``)."""
    icf = c["ItemConversionFactor"].select("Item", "ReportingConversionFactor", "ReportingUom")
    return lookup(icf, c["Uom"], "ReportingUom", "UomId", {uom_field: uom_name}, how,
                  drop_key=True)


def reporting_units(c: Catalog) -> DataFrame:
    """Stock on hand and unit cost of every item and store in reporting
    units: quantities divided by the factor, costs multiplied by it."""
    f = reporting_factor(c)
    cost = c["ItemUnitCost"].where(F.col("Active") == 1).select("Item", "Store", "TrackingCost")
    j = c["ItemQtyOnHand"].join(cost, ["Item", "Store"]).join(f, "Item")
    factor = F.col("ReportingConversionFactor")
    return j.select("Item", "Store", "ReportingUom", reporting_qty(F.col("QtyOnHand"), factor).cast(RATIO).alias("QtyOnHand"),
                    reporting_cost(F.col("TrackingCost"), factor).cast(PRODUCT).alias("UnitCost"))


def item_order_codes(c: Catalog) -> DataFrame:
    """Item, description and every order code of the item."""
    items = c["Item"].select(F.col("ItemId").alias("Item"), F.col("Descrip").alias("ItemDescrip"))
    return c["CaseSize"].select("Item", "CaseSizeId", "OrderCode").join(items, "Item")


def item_store_names(c: Catalog, store: int) -> DataFrame:
    """Tracked items of every store with the store's name, and the name of one given store."""
    tracked = c["ItemDetail"].where(F.col("TrackInventory") == 1).select("Item", "Store")
    return with_store_name(c, tracked, "Store").withColumn("GivenStoreName", store_name(c, store))


def recent_supplier(c: Catalog, items: DataFrame | None = None) -> DataFrame:
    """Per item: supplier of its most recent invoice (vendors whose name
    starts with a numeric character are internal and skipped) and an order
    code of the item.

    The ranking key is the invoice date, so instead of pairing every case
    size of an item with every invoice line of that item and ranking the
    product, we pick the latest invoice per item and the case size per item
    separately and join the two one-row results.  Date and invoice id are one
    number (``receipts.receipt_rank``), so the supplier of the latest invoice
    is one hash aggregation with partial results.  Tie-breaks: newest date,
    then highest invoice id, then highest case-size id; an undated invoice
    loses to any dated one.  Items without a case size or an eligible invoice
    have no row.

    Over stored facts with a summary (``receipts.summarise``) only the lines
    of months outside the summary are read.  ``items`` (a frame with an
    ``Item`` column) restricts the result: each item depends on its own lines
    only, so only those lines are read on.
    """
    cases = c["CaseSize"].select("Item", "CaseSizeId", "OrderCode")
    if items is not None:
        cases = cases.join(items.select("Item").distinct(), "Item", "left_semi")
    latest = receipts(c, items).groupBy("Item").agg(F.max_by("Supplier", "Latest").alias("SupplierId"))
    newest = cases.groupBy("Item").agg(F.max("CaseSizeId").alias("CaseSizeId"))
    codes = newest.join(by_shuffle(c["CaseSize"].select("CaseSizeId", "OrderCode")), "CaseSizeId").select("Item", "OrderCode")
    names = c["Vendor"].select("SupplierId", F.col("Name").alias("SupplierName"))
    return latest.join(names, "SupplierId").select("Item", "SupplierName").join(by_shuffle(codes), "Item")


def item_search_filter(df: DataFrame, item_term: str | None, order_code_term: str | None,
                       descrip_col: str = "ItemDescrip", code_col: str = "OrderCode",
                       case_insensitive: bool = False) -> DataFrame:
    """Substring search: description case-folded, order code as stored; a
    ``None`` term disables its filter.  ``'%%'`` still requires a non-NULL
    value (so it drops rows without an order code)."""
    if item_term is not None:
        df = df.where(like(F.col(descrip_col), contains_pattern(item_term), fold_case=True))
    if order_code_term is not None:
        df = df.where(like(F.col(code_col), contains_pattern(order_code_term), case_insensitive=case_insensitive))
    return df
