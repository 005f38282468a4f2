"""Edge cases of the reports' semantics, each on a tiny hand-made table."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from larder.functions import like, mismatch_flag, reporting_qty, starts_numeric
from larder.operators.catalogue import item_catalogue
from larder.operators.keyed import rows_at_max, top_one
from larder.operators.ledger import count_events
from larder.operators.movements import period_purchases
from larder.operators.usage import movement_filter, usage_balance
from larder.params import LedgerParams, Period, PickSheetParams, SearchParams
from larder.plans.reports import item_search
from larder.sources import Catalog


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_numeric_first_character(spark):
    names = ["7 Acme", "$ Acme", "Acme", None, "", "-x", "€uro", ".dot", "+1", "a7"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r[0] for r in df.select(starts_numeric(F.col("name"))).collect()]
    assert got == [True, True, False, False, False, True, True, True, True, False]


def test_rows_at_max_keeps_ties_and_drops_null_keys(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 3, "c"), (None, 9, "d"), (2, None, "e"),
                                (2, 1, "f")], "k int, d int, tag string")
    got = sorted(r.tag for r in rows_at_max(df, "k", "d").collect())
    assert got == ["a", "b", "f"]


def test_top_one_is_deterministic(spark):
    df = spark.createDataFrame([(1, 10, 1, "old"), (1, 20, 2, "x"), (1, 20, 3, "newest"), (2, None, 9, "n"),
                                (2, 5, 1, "dated")], "item int, date int, id int, name string")
    got = {r.item: r.name for r in top_one(df, "item", ["date", "id"], ["name"]).collect()}
    assert got == {1: "newest", 2: "dated"}


def test_zero_factor_gives_null_not_error(spark):
    df = spark.createDataFrame([(D("5.000"), D("0.000")), (D("5.000"), D("2.000"))],
                               "q decimal(11,3), f decimal(11,3)")
    got = [r[0] for r in df.select(reporting_qty(F.col("q"), F.col("f"))).collect()]
    assert got[0] is None and got[1] == D("2.5")


def test_like_catch_all_still_rejects_null(spark):
    df = spark.createDataFrame([("OC-1",), (None,), ("oc-12",)], "c string")
    assert df.where(like(F.col("c"), "%%")).count() == 2
    assert df.where(like(F.col("c"), "%oc-1%", fold_case=True)).count() == 2
    assert df.where(like(F.col("c"), "%oc-1%")).count() == 1


def test_mismatch_flag(spark):
    df = spark.createDataFrame([("EA", "ea"), ("EA", "EA"), (None, "EA")], "a string, b string")
    got = [r[0] for r in df.select(mismatch_flag(F.col("a"), F.col("b"), "MISMATCH")).collect()]
    assert got == ["MISMATCH", "OK", "OK"]


def test_quantity_rounding_to_zero_is_filtered(spark):
    """A movement of 0.0004 reporting units rounds to 0.000 and drops out."""
    row = dict(Item=1, ItemDescrip="x", Supplier=None, OrderCode=None, Category_Name=None, Item_Location=None,
               UOM=None, ReportingConversionFactor=D("1.000"), open_qoh=None, open_prep=None, open_val=None,
               close_qoh=None, close_prep=None, close_val=None, InvoiceSum=D("0.0004"), InvoiceValue=None,
               TransferOutQty=None, TransferInQty=None, WasteQty=None)
    schema = ("Item bigint, ItemDescrip string, Supplier string, OrderCode string, Category_Name string, "
              "Item_Location string, UOM string, ReportingConversionFactor decimal(11,3), "
              "open_qoh decimal(18,3), open_prep decimal(18,3), open_val decimal(18,4), "
              "close_qoh decimal(18,3), close_prep decimal(18,3), close_val decimal(18,4), "
              "InvoiceSum decimal(18,4), InvoiceValue decimal(18,4), TransferOutQty decimal(18,3), "
              "TransferInQty decimal(18,3), WasteQty decimal(18,3)")
    big = dict(row, Item=2, InvoiceSum=D("0.0005"))
    df = spark.createDataFrame([row, big], schema)
    bal = usage_balance(df)
    assert movement_filter(bal).select("ItemId").collect()[0][0] == 2
    got = {r.ItemId: r.PurchaseQty for r in bal.collect()}
    assert got == {1: D("0.000"), 2: D("0.001")}


def test_several_credits_repeat_the_line(spark, table):
    """Each credit against a line repeats the line: quantity nets each
    credit, but the invoiced value is counted once per credit."""
    c = Catalog.frames(spark, {
        "Invoice": table("Invoice", [(1, 2, ts("1999-03-05 00:00:00"), "INV-1", 3)]),
        "InvoiceItem": table("InvoiceItem", [(11, 1, 7, 14, D("10.000"), D("100.0000"))]),
        "InvoiceRFC": table("InvoiceRFC", [(11, D("2.000")), (11, D("3.000"))]),
    })
    r = period_purchases(c, Period(2, "1999-03-01", "1999-03-31")).collect()
    assert [(x.Item, x.InvoiceSum, x.InvoiceValue) for x in r] == [(7, D("15.000"), D("200.0000"))]


def test_period_end_at_midnight_excludes_later_events(spark, table):
    c = Catalog.frames(spark, {
        "Invoice": table("Invoice", [(1, 2, ts("1999-03-31 00:00:00"), "INV-1", 3),
                                     (2, 2, ts("1999-03-31 10:00:00"), "INV-2", 3)]),
        "InvoiceItem": table("InvoiceItem", [(11, 1, 7, 14, D("1.000"), D("1.0000")),
                                             (21, 2, 8, 16, D("1.000"), D("1.0000"))]),
        "InvoiceRFC": table("InvoiceRFC", []),
    })
    items = [r.Item for r in period_purchases(c, Period(2, "1999-03-01", "1999-03-31")).collect()]
    assert items == [7]


def test_count_inside_period_on_both_ends_appears_twice(spark, table):
    c = Catalog.frames(spark, {
        "Inventory": table("Inventory", [(1, 2, ts("1999-03-01 00:00:00"), ts("1999-03-31 00:00:00"),
                                          ts("1999-03-31 00:00:00")),
                                         (2, 2, ts("1999-03-02 00:00:00"), ts("1999-03-30 00:00:00"), None)]),
        "InventorySummary": table("InventorySummary", [(1, 7, D("1.000"), D("0.000"), D("1.0000")),
                                                       (2, 7, D("5.000"), D("0.000"), D("5.0000"))]),
    })
    active = spark.createDataFrame([(7,)], "ItemId bigint")
    rows = count_events(c, LedgerParams(2, "1999-03-01", "1999-03-31"), active).collect()
    # the unfinalised count (2) is ignored; count 1 opens and closes in the period
    assert sorted(r.ActivityTypeName for r in rows) == ["Ending Inventory", "Opening Inventory"]


def test_all_store_search_repeats_rows_per_last_received_store(spark, small_catalog):
    by_item = item_catalogue(small_catalog, SearchParams(store=None)).count()
    by_item_store = item_catalogue(small_catalog, SearchParams(store=None, last_received_scope="item_store")).count()
    assert by_item > by_item_store > 0
    one = item_catalogue(small_catalog, SearchParams(store=2)).count()
    one_scoped = item_catalogue(small_catalog, SearchParams(store=2, last_received_scope="item_store")).count()
    assert one == one_scoped


def test_order_code_catch_all_drops_items_without_code(spark, small_catalog):
    all_rows = item_search(small_catalog, SearchParams(store=2, order_code_term=None))
    coded = item_search(small_catalog, SearchParams(store=2))
    n_null = all_rows.where(F.col("OrderCode").isNull()).count()
    assert n_null > 0
    assert coded.count() == all_rows.count() - n_null


def test_hot_key_selection_matches_brute_force(spark):
    """One key holds a third of the rows: the aggregate-based selections give
    the same answer as a plain per-key scan."""
    import random
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        k = 0 if i % 3 == 0 else rnd.randrange(1, 200)
        rows.append((k, rnd.randrange(0, 50), i))
    df = spark.createDataFrame(rows, "k int, d int, id int").repartition(8)
    best = {}
    for k, d, i in rows:
        best[k] = max(best.get(k, (-1, -1)), (d, i))
    got = {r.k: r.id for r in top_one(df, "k", ["d", "id"], ["id"]).collect()}
    assert got == {k: v[1] for k, v in best.items()}
    top_d = {k: v[0] for k, v in best.items()}
    want = sorted(i for k, d, i in rows if d == top_d[k])
    assert sorted(r.id for r in rows_at_max(df, "k", "d").collect()) == want


def test_unit_cost_from_value(spark):
    from larder.functions import unit_cost_from_value
    df = spark.createDataFrame([(D("10.0000"), D("4.000")), (D("1.0000"), D("0.000")), (D("3.0000"), None)],
                               "v decimal(12,4), q decimal(11,3)")
    got = [r[0] for r in df.select(unit_cost_from_value(F.col("v"), F.col("q")).cast("decimal(12,4)")).collect()]
    assert got == [D("2.5000"), None, None]


def test_case_insensitive_option(spark, small_catalog):
    """Comparisons that follow the database collation are binary by default
    and case-insensitive on request ('EA' vs 'ea' units; order-code search)."""
    from larder.params import PickSheetParams
    from larder.plans.reports import stock_request_pick_sheet
    base = PickSheetParams(as_of="2001-07-31 00:00:00")
    exact = stock_request_pick_sheet(small_catalog, base)
    folded = stock_request_pick_sheet(small_catalog, PickSheetParams(as_of=base.as_of, case_insensitive=True))
    n_exact_ok = exact.where(F.col("UomMismatchFlag") == "OK").count()
    n_folded_ok = folded.where(F.col("UomMismatchFlag") == "OK").count()
    assert exact.count() == folded.count()
    assert n_folded_ok > n_exact_ok
    upper = item_search(small_catalog, SearchParams(store=2, order_code_term="OC-1")).count()
    lower_ci = item_search(small_catalog, SearchParams(store=2, order_code_term="oc-1", case_insensitive=True)).count()
    lower_bin = item_search(small_catalog, SearchParams(store=2, order_code_term="oc-1")).count()
    assert upper == lower_ci > 0 and lower_bin == 0


def _usage_catalog(spark, table, usage_date, waste_date):
    return Catalog.frames(spark, {
        "UsageSource": table("UsageSource", [(1, 2, ts(usage_date))]),
        "ItemUsage": table("ItemUsage", [(1, 7, D("2.000"), D("1.5000"))]),
        "Waste": table("Waste", [(1, ts(waste_date))]),
        "TransferContext": table("TransferContext", []),
        "Transfer": table("Transfer", []),
        "Store": table("Store", [(2, "S2", "S2")]),
        "Item": table("Item", [(7, "bolt", 1)]),
    })


def test_ledger_waste_filters_by_usage_date_but_reports_waste_date(spark, table):
    from larder.operators.ledger import usage_events
    c = _usage_catalog(spark, table, "1999-03-05 00:00:00", "1999-04-10 00:00:00")
    rows = usage_events(c, LedgerParams(2, "1999-03-01", "1999-03-31"), ("Waste",)).collect()
    assert [(r.ItemId, r.ActivityDate, r.q) for r in rows] == [(7, ts("1999-04-10 00:00:00"), D("2.000"))]
    # the usage summary filters waste by its own date instead: nothing in March
    from larder.operators.movements import period_waste
    assert period_waste(c, Period(2, "1999-03-01", "1999-03-31")).count() == 0
    assert period_waste(c, Period(2, "1999-04-01", "1999-04-30")).collect()[0].WasteQty == D("-2.000")


def test_lookup_rows_repeat_ledger_rows(spark, table):
    """A non-unique item lookup (two active unit costs) repeats the item's
    ledger rows, one per lookup row."""
    from larder.operators.ledger import INFO_COLUMNS, ledger_waste
    c = _usage_catalog(spark, table, "1999-03-05 00:00:00", "1999-03-06 00:00:00")
    info_schema = ("ItemId bigint, OrderCode string, CaseCost decimal(12,4), CaseQty decimal(11,3), "
                   "PakQty decimal(11,3), TrackingCost decimal(12,4), ReportingConversionFactor decimal(11,3), "
                   "PurchaseUom string, CaseUom string, PakUom string, ReportingUom string, CategoryName string")
    info = spark.createDataFrame(
        [(7, "OC-14", D("1.0000"), D("1.000"), D("1.000"), cost, D("2.000"), "EA", "CS", "EA", "EA", "CAT-1")
         for cost in (D("1.0000"), D("2.0000"))], info_schema).select(*INFO_COLUMNS)
    rows = ledger_waste(c, LedgerParams(2, "1999-03-01", "1999-03-31"), info).collect()
    assert sorted(r.UnitCost for r in rows) == [D("2.0000"), D("4.0000")]
    assert {r.Amount for r in rows} == {D("-1.000")}


def test_pick_sheet_window_has_no_upper_bound(spark, table):
    from larder.operators.requests import candidate_requisitions
    c = Catalog.frames(spark, {"Requisition": table("Requisition", [
        (1, 2, 3, "1-URGENT", None, ts("2001-06-30 23:59:59")),
        (2, 2, 3, "1-URGENT", None, ts("2001-07-01 00:00:00")),
        (3, 2, 3, "1-URGENT", None, ts("2002-01-01 00:00:00")),
        (4, 1, 3, "1-URGENT", None, ts("2001-07-15 00:00:00"))])})
    got = sorted(r.RequisitionId for r in candidate_requisitions(
        c, PickSheetParams(store=2, as_of="2001-07-31 00:00:00")).collect())
    assert got == [2, 3]


def test_like_character_classes_and_backslash(spark):
    df = spark.createDataFrame([("a[b]c",), ("abc",), ("adc",), ("a\\xc",), ("a%c",), ("a.c",), ("A\\XC",)], "c string")

    def got(pattern, **options):
        return [r.c for r in df.where(like(F.col("c"), pattern, **options)).collect()]

    assert got("a[b]c") == ["abc"] and got("a[^b]c") == ["adc", "a%c", "a.c"] and got("a[a-c]_") == ["abc"]
    assert got("%[[]b]%") == ["a[b]c"] and got("a[.]c") == ["a.c"] and got("a[%]c") == ["a%c"] and got("a[b") == []
    assert got("%a\\x%") == ["a\\xc"] and got("%\\%") == ["a\\xc", "A\\XC"]
    assert got("A\\x%", fold_case=True) == ["a\\xc", "A\\XC"] and got("A[B]C", fold_case=True) == ["abc"]


def test_currency_signs_are_numeric(spark):
    df = spark.createDataFrame([("¢1",), ("₪2",), ("₩3",), ("a₪",), ("％",)], "name string")
    assert [r[0] for r in df.select(starts_numeric(F.col("name"))).collect()] == [True, True, True, False, False]


def test_two_counts_on_one_date_keep_their_rows(spark, table):
    """Every count of the date is attached to every item: an item with a line
    in one of two counts has its line and an empty row."""
    from larder.operators.movements import period_movements, with_counts
    day, later = ts("1999-03-01 00:00:00"), ts("1999-04-30 00:00:00")
    c = Catalog.frames(spark, {
        "Invoice": table("Invoice", []), "InvoiceItem": table("InvoiceItem", []), "InvoiceRFC": table("InvoiceRFC", []),
        "UsageSource": table("UsageSource", []), "ItemUsage": table("ItemUsage", []), "Waste": table("Waste", []),
        "TransferContext": table("TransferContext", []), "Transfer": table("Transfer", []),
        "Inventory": table("Inventory", [(1, 2, day, later, None), (2, 2, day, later, later), (3, 1, day, later, later)]),
        "InventorySummary": table("InventorySummary", [
            (1, 7, D("10.000"), D("0.000"), D("1.0000")), (2, 7, D("99.000"), D("1.000"), D("2.0000")),
            (1, 8, D("5.000"), D("0.000"), D("3.0000")), (3, 9, D("4.000"), D("0.000"), D("3.0000"))]),
    })
    rows = with_counts(c, Period(2, "1999-03-01", "1999-03-31"), period_movements(c, Period(2, "1999-03-01", "1999-03-31")))
    assert sorted((r.Item, r.open_qoh is None, r.open_qoh or 0) for r in rows.collect()) == [
        (7, False, D("10.000")), (7, False, D("99.000")), (8, False, D("5.000")), (8, True, 0)]
    assert all(r.close_qoh is None for r in rows.collect())
    from larder.operators.movements import COUNT_LINE
    bare = spark.createDataFrame([(7,), (8,)], "Item bigint").select(
        "Item", *(F.lit(None).cast(f"array<{COUNT_LINE}>").alias(f"{side}_lines") for side in ("open", "close")))
    none = with_counts(c, Period(2, "2000-03-01", "2000-03-31"), bare)
    assert sorted((r.Item, r.open_qoh) for r in none.collect()) == [(7, None), (8, None)]


def test_lookup_rows_that_differ_in_category_sum_events(spark, table):
    from larder.operators.ledger import INFO_COLUMNS, ledger_waste
    c = _usage_catalog(spark, table, "1999-03-05 00:00:00", "1999-03-06 00:00:00")
    info = spark.createDataFrame(
        [(7, "OC-14", D("1.0000"), D("1.000"), D("1.000"), D("1.0000"), D("2.000"), "EA", "CS", "EA", "EA", cat)
         for cat in ("CAT-1", "CAT-2")],
        "ItemId bigint, OrderCode string, CaseCost decimal(12,4), CaseQty decimal(11,3), PakQty decimal(11,3), "
        "TrackingCost decimal(12,4), ReportingConversionFactor decimal(11,3), PurchaseUom string, CaseUom string, "
        "PakUom string, ReportingUom string, CategoryName string").select(*INFO_COLUMNS)
    rows = ledger_waste(c, LedgerParams(2, "1999-03-01", "1999-03-31"), info).collect()
    assert [(r.Amount, r.Value) for r in rows] == [(D("-2.000"), D("-6.0000"))]


def test_fixture_tables_hold_every_input_row(spark):
    from conftest import SF_MID
    c = Catalog.derived(spark, SF_MID)
    raw = spark.read.parquet(f"{SF_MID}/lineitem.parquet")
    lines, credits = c["InvoiceItem"], c["InvoiceRFC"]
    assert lines.count() == lines.select("InvoiceLineId").distinct().count() == raw.where("l_returnflag <> 'A'").count()
    columns = [F.col("Invoice"), F.col("Item"), F.col("StockQty").cast("double"), F.col("AdjustedTotal").cast("double")]
    made = lines.select(*columns)
    source = raw.where("l_returnflag <> 'A'").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    assert made.exceptAll(source).count() == 0
    assert credits.join(lines, credits.InvoiceItem == lines.InvoiceLineId, "left_anti").count() == 0
    per = credits.groupBy("InvoiceItem").count()
    assert per.count() == raw.where("l_returnflag = 'R'").count() and per.where("count > 1").count() > 0
    suppliers = spark.read.parquet(f"{SF_MID}/supplier.parquet").count()
    assert c["Invoice"].select("Supplier").distinct().count() == c["CaseSize"].select("Supplier").distinct().count() == suppliers
    assert c["ItemDetail"].select("Store").distinct().count() == spark.read.parquet(f"{SF_MID}/region.parquet").count()


def test_materialize_needs_a_shared_folder(spark):
    import pytest
    from larder.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
