"""Reports in Spark SQL over the registered domain tables.

``register`` makes a catalog's tables available as temporary views (with the
view ``RecentSupplier`` over the operator of that name) and the reports'
scalar functions as SQL functions of the session.  The functions are SQL
themselves: Spark puts their bodies into the calling plan, so a call costs
what the written-out expression or join costs, and no Python runs.

Statements take named parameter markers (``:store``).  A marker becomes a
literal before the statement is optimised, so the catch-all form
``:store IS NULL OR Store = :store`` folds away when the parameter is NULL
and is an ordinary pushed filter when it is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import NUMERIC_FIRST_CHAR
from ..operators.dimensions import recent_supplier
from ..operators.keyed import by_shuffle
from ..params import SearchParams
from ..sources import Catalog

#: Tables of the search that grow with the items: no statement broadcasts them.
ITEM_TABLES = ("Item", "ItemConversionFactor", "CaseSize", "CaseSizeCost", "ItemDetail", "ItemUnitCost", "ItemQtyOnHand",
               "ItemLastReceived")

FUNCTIONS = {
    # max: one name, or NULL for an unknown store, even if an id repeats
    "RetrieveStoreName(id INT) RETURNS STRING":
        "(SELECT max(s.Name) FROM Store s WHERE s.StoreId = RetrieveStoreName.id)",
    "ReportingQuantity(qty DECIMAL(11,3), factor DECIMAL(11,3)) RETURNS DECIMAL(26,15)": "qty / nullif(factor, 0)",
    "ReportingCost(cost DECIMAL(12,4), factor DECIMAL(11,3)) RETURNS DECIMAL(24,7)": "cost * factor",
    "StartsNumeric(name STRING) RETURNS BOOLEAN":
        "coalesce(substring(name, 1, 1) RLIKE '" + NUMERIC_FIRST_CHAR.replace("\\", "\\\\") + "', false)",
    # a term of a search box as a LIKE pattern; a backslash is an ordinary character
    "ContainsPattern(term STRING) RETURNS STRING": r"concat('%', replace(term, '\\', '\\\\'), '%')",
}

STORE_NAMES = """
SELECT Item, Store, RetrieveStoreName(Store) AS StoreName,
  (SELECT max(n) FROM (SELECT RetrieveStoreName(s.StoreId) AS n, s.StoreId FROM Store s) s WHERE s.StoreId = :store) AS GivenStoreName
FROM ItemDetail WHERE TrackInventory = 1
"""

ITEM_SEARCH = """
WITH packs AS (
  SELECT c.CaseSizeId, k.Store, c.CaseQty, c.PakQty, k.CaseCost, pu.Uom AS PurchaseUom, cu.Uom AS CaseUom, au.Uom AS PakUom
  FROM CaseSize c JOIN CaseSizeCost k ON k.CaseSize = c.CaseSizeId
  JOIN Uom pu ON pu.UomId = c.PurchaseUom JOIN Uom cu ON cu.UomId = c.CaseUom JOIN Uom au ON au.UomId = c.PakUom),
items AS (
  SELECT i.ItemId, i.Descrip, g.Name AS CategoryName, f.ReportingConversionFactor AS factor, u.Uom AS ReportingUom
  FROM Item i JOIN ItemGroup ig ON ig.GroupId = i.ItemGroup JOIN Category g ON g.CategoryId = ig.Category
  JOIN ItemConversionFactor f ON f.Item = i.ItemId JOIN Uom u ON u.UomId = f.ReportingUom
  WHERE :item IS NULL OR lower(i.Descrip) LIKE lower(ContainsPattern(:item)))
SELECT RetrieveStoreName(d.Store) AS StoreName, i.CategoryName, d.Item AS ItemId, i.Descrip AS ItemDescrip, s.SupplierName, s.OrderCode,
  p.CaseCost, p.CaseQty, p.PakQty, ReportingCost(c.TrackingCost, i.factor) AS UnitCost, p.PurchaseUom, p.CaseUom, p.PakUom,
  ReportingQuantity(q.QtyOnHand, i.factor) AS QtyOnHand, CAST(q.QtyOnHand * c.TrackingCost AS DECIMAL(13,2)) AS ApproxValue,
  r.LastReceived, i.ReportingUom
FROM ItemDetail d
JOIN ItemUnitCost c ON c.Item = d.Item AND c.Store = d.Store AND c.Active = 1
JOIN ItemQtyOnHand q ON q.Item = d.Item AND q.Store = d.Store
JOIN packs p ON p.CaseSizeId = d.CurrentCaseSize AND p.Store = d.Store
JOIN items i ON i.ItemId = d.Item
JOIN ItemLastReceived r ON r.Item = d.Item AND (:store IS NULL OR r.Store = :store)
LEFT JOIN RecentSupplier s ON s.Item = d.Item
WHERE d.TrackInventory = 1 AND (:store IS NULL OR d.Store = :store)
  AND (:code IS NULL OR s.OrderCode LIKE ContainsPattern(:code))
"""


def register(c: Catalog) -> None:
    """Views and functions of the catalog in its session; later calls replace earlier ones."""
    c.register_views()
    for name in ITEM_TABLES:
        by_shuffle(c[name]).createOrReplaceTempView(name)
    by_shuffle(recent_supplier(c)).createOrReplaceTempView("RecentSupplier")
    for head, body in FUNCTIONS.items():
        c.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")


def statement(c: Catalog, text: str, **parameters) -> DataFrame:
    """The rows of a statement over the catalog's views, with its named parameters bound."""
    register(c)
    return c.spark.sql(text, args=parameters)


def item_search(c: Catalog, p: SearchParams = SearchParams()) -> DataFrame:
    """R3 as one SQL statement (last receipt matched on the item alone, binary comparison of order codes)."""
    return statement(c, ITEM_SEARCH, store=p.store, item=p.item_term, code=p.order_code_term)


def store_names(c: Catalog, store: int) -> DataFrame:
    """Tracked items of every store with the store's name, and that of one given store."""
    return statement(c, STORE_NAMES, store=store)
