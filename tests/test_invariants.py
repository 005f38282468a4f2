"""Invariants of the reports on the test data."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from conftest import SF_MID
from larder.operators import dimensions, ledger, requests
from larder.params import LedgerParams, Period, PickSheetParams
from larder.plans import reports
from larder.sources import Catalog

YEAR = LedgerParams(start="1999-01-01 00:00:00", end="1999-12-31 00:00:00")


def test_ledger_is_the_sum_of_its_branches(spark):
    c = Catalog.derived(spark, SF_MID)
    info = ledger.item_info(c, YEAR)
    # the lookup is unique per item on the test data, so no branch fans out
    assert info.count() == info.select("ItemId").distinct().count()
    parts = [ledger.ledger_opening_inventory(c, YEAR), ledger.ledger_purchases(c, YEAR),
             ledger.ledger_waste(c, YEAR), ledger.ledger_transfer_in(c, YEAR),
             ledger.ledger_transfer_out(c, YEAR), ledger.ledger_ending_inventory(c, YEAR)]
    counts = [p.count() for p in parts]
    assert all(n > 0 for n in counts), counts
    assert reports.item_activity_ledger(c, YEAR).count() == sum(counts)


def test_active_items_cover_every_event_branch(spark):
    c = Catalog.derived(spark, SF_MID)
    active = ledger.active_items(c, YEAR)
    for branch in (ledger.ledger_purchases, ledger.ledger_waste, ledger.ledger_transfer_in,
                   ledger.ledger_transfer_out):
        items = branch(c, YEAR).select("ItemId").distinct()
        assert items.join(active, "ItemId", "left_anti").count() == 0


def test_usage_equation_holds_on_rounded_columns(spark):
    c = Catalog.derived(spark, SF_MID)
    df = reports.item_usage_summary(c, Period(start="1999-01-01 00:00:00", end="1999-12-31 00:00:00"))
    rhs = (F.col("OpenInvQty") + F.col("PurchaseQty") + F.col("TransferOutQty") + F.col("TransferInQty")
           + F.col("WasteQty") - F.col("EndInvQty"))
    worst = df.select(F.max(F.abs(rhs - F.col("UsageQty"))).alias("d")).collect()[0].d
    assert worst is not None and worst <= D("0.004")


def test_recent_supplier_is_one_row_per_item(spark):
    c = Catalog.derived(spark, SF_MID)
    rs = dimensions.recent_supplier(c)
    assert rs.count() == rs.select("Item").distinct().count() > 0


def test_latest_status_keeps_ties(spark):
    c = Catalog.derived(spark, SF_MID)
    latest = requests.latest_requisition_status(c)
    per_req = latest.groupBy("Requisition").count()
    assert per_req.where("count > 1").count() > 0          # the data has tied latest rows
    assert per_req.count() == c["RequisitionStatus"].select("Requisition").distinct().count()


def test_pick_sheet_as_of_defaults_to_now(spark):
    c = Catalog.derived(spark, SF_MID)
    # the test data ends in 2001, so nothing is open within 30 days of today
    assert reports.stock_request_pick_sheet(c, PickSheetParams()).count() == 0
    assert reports.stock_request_pick_sheet(c, PickSheetParams(as_of="2001-07-31 00:00:00")).count() > 0
