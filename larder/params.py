"""Report parameters and the fixed values the reports must reproduce."""

from __future__ import annotations

from dataclasses import dataclass

# Ledger activity type labels, in business order.
OPENING = "Opening Inventory"
TRANSFER_IN = "Transfer In"
TRANSFER_OUT = "Transfer Out"
PURCHASE = "Purchase"
WASTE = "Waste"
ENDING = "Ending Inventory"
SUBTOTAL = "Subtotal"

# Sort rank of each activity type; anything else ranks 99.
ACTIVITY_ORDER = {
    OPENING: 1,
    TRANSFER_IN: 2,
    TRANSFER_OUT: 3,
    PURCHASE: 4,
    WASTE: 5,
    ENDING: 6,
}
UNKNOWN_ACTIVITY_RANK = 99

# Pick sheet status code of a fulfilled request, flag texts,
# look-back window in days, and the search-all sentinel pattern.
FULFILLED = "F"
UOM_OK = "OK"
UOM_MISMATCH = "⚠️MISMATCH⚠️"
LOOKBACK_DAYS = 30
MATCH_ALL = "%%"

# Display names of the activity ledger columns.
LEDGER_DISPLAY = [
    ("ItemDescrip", "Item"),
    ("CategoryName", "Category"),
    ("ActivityDate", "Date"),
    ("ActivityTypeName", "Activity Type"),
    ("SupplierName", "Vendor/Store"),
    ("Amount", "Qty"),
    ("ReportingUom", "Reporting_UoM"),
    ("Value", "Activity Value $"),
    ("CaseCost", "CaseCost"),
    ("UnitCost", "UoM Cost"),
    ("PurchaseInfo", "Ref/Inv #"),
    ("OrderCode", "Vendor Code"),
    ("StoreName", "StoreName"),
]


@dataclass(frozen=True)
class Period:
    """One store over a closed period ``[start, end]`` (timestamps, no zone)."""

    store: int = 2
    start: str = "1999-03-01 00:00:00"
    end: str = "1999-03-31 00:00:00"


@dataclass(frozen=True)
class LedgerParams(Period):
    """Item activity ledger: period plus description / order-code LIKE
    patterns (``'%%'`` disables the order-code filter)."""

    item_like: str = MATCH_ALL
    order_code_like: str = MATCH_ALL
    # Comparisons written without LOWER follow the database collation in the
    # original; binary by default, UTF8_LCASE when True.
    case_insensitive: bool = False


@dataclass(frozen=True)
class PickSheetParams:
    """Pick sheet: requests sent by ``store`` required on or after ``as_of``
    minus ``lookback_days``.  ``as_of=None`` means now (the session's local
    timestamp, evaluated once per query)."""

    store: int = 2
    as_of: str | None = None
    lookback_days: int = LOOKBACK_DAYS
    mismatch_label: str = UOM_MISMATCH
    case_insensitive: bool = False  # unit codes compared under UTF8_LCASE when True


@dataclass(frozen=True)
class SearchParams:
    """Item search.  ``store=None`` lists every store; a ``None`` search term
    disables that filter.  ``last_received_scope='item'`` matches the
    last-received rows on the item alone when listing all stores (the
    original report's behaviour); ``'item_store'`` matches item and store."""

    store: int | None = None
    item_term: str | None = MATCH_ALL
    order_code_term: str | None = MATCH_ALL
    last_received_scope: str = "item"
    case_insensitive: bool = False  # order-code search under UTF8_LCASE when True
