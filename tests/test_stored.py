"""Stored layout, receipt summary, kept ledger, staged steps and SQL entries."""

import datetime as dt
import glob
import os
import shutil
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from larder.operators import kept_ledger, ledger, movements, receipts, stages
from larder.operators.dimensions import recent_supplier
from larder.params import LedgerParams, Period, SearchParams
from larder.plans import reports, sql
from larder.sources import Catalog, layout, materialize

MARCH = dict(store=2, start="1999-03-01 00:00:00", end="1999-03-31 00:00:00")
LINES = ("InvoiceItem", "InvoiceRFC", "ItemUsage", "InventorySummary")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


FACTS = list(layout.PLACES)


@pytest.fixture(scope="module")
def stored_root(spark, small_catalog):
    return materialize(small_catalog, tempfile.mkdtemp(prefix="larder-layout-"), names=FACTS)


def test_stored_tables_hold_the_same_rows(spark, small_catalog, stored_root):
    c = Catalog.over(small_catalog, stored_root, FACTS)
    for name in ("InvoiceItem", "InvoiceRFC", "ItemUsage", "Inventory", "RequisitionItemStatus"):
        assert sorted(c[name].columns) == sorted(small_catalog[name].columns), name
        assert rows(c[name].select(small_catalog[name].columns)) == rows(small_catalog[name]), name
        assert c.placed(name).where(f"{layout.MONTH} IS NULL OR {layout.STORE} IS NULL").count() == 0


def test_whole_years_and_months_in_one_table(spark, small_catalog, table):
    heads = [(k, k % 2, dt.datetime(1998 + k // 24, 1 + k // 2 % 12, 3), str(k), 1) for k in range(72)]
    root = tempfile.mkdtemp(prefix="larder-years-")
    old, new = (table("Invoice", [h for h in heads if (h[2].year < 2000) == x]) for x in (True, False))
    layout.write({"Invoice": old}, ["Invoice"], root, by_year=True)
    layout.append(layout.placed("Invoice", new, None), root, "Invoice")
    c = Catalog.parquet(spark, root)
    assert {r[0] for r in c.placed("Invoice").select(layout.MONTH).distinct().collect()} == {199800, 199900, *range(200001, 200013)}
    for start, end in (("1998-05-01", "1998-06-01"), ("1999-12-01", "2000-02-01"), ("2000-03-01", "2000-03-31"), ("1997-01-01", None), (None, "1998-01-09")):
        near = F.col("InvoiceDate").between(F.lit(start or "1900-01-01").cast("timestamp_ntz"), F.lit(end or "2999-01-01").cast("timestamp_ntz"))
        assert rows(c.of_period("Invoice", 1, start, end).where(near).select("InvoiceId")) == rows(
            old.unionByName(new).where(near & (F.col("Store") == 1)).select("InvoiceId"))
    assert c.of_period("Invoice", 0, "2000-03-01", "2000-03-31").count() == 1


@pytest.mark.parametrize("report", ["ledger", "usage", "sheet"])
def test_a_report_reads_only_the_files_of_its_store_and_months(spark, small_catalog, stored_root, report):
    """Line files of all other partitions are made unreadable: the rows must not change."""
    def run(c):
        if report == "ledger":
            return reports.item_activity_ledger(c, LedgerParams(**MARCH))
        if report == "usage":
            return reports.item_usage_summary(c, Period(**MARCH), include_hidden=True)
        from larder.plans.registry import PICK
        return reports.stock_request_pick_sheet(c, PICK)

    root = tempfile.mkdtemp(prefix="larder-cut-")
    shutil.copytree(stored_root, root, dirs_exist_ok=True)
    c = Catalog.over(small_catalog, root, FACTS)
    if report == "usage":
        receipts.summarise(c)  # else the recent supplier reads every line
    for name in layout.PLACES:
        c.placed(name)  # schemas are read before the files go bad
    damaged = kept = 0
    names, first = (("RequisitionStatus", "RequisitionItemStatus"), 200107) if report == "sheet" else (LINES, 199903)
    # the other end of a transfer may be used in another month than the transfer's
    used = {tuple(r) for r in movements._usage_roles(c, Period(**MARCH)).select(layout.STORE, layout.MONTH).collect()} if report == "usage" else set()
    for name in names:
        for path in glob.glob(f"{root}/{name}/{layout.STORE}=*/{layout.MONTH}=*/*.parquet"):
            store, month = (int(x.split("=")[1]) for x in path.split("/")[-3:-1])
            wanted = store == 2 and (month >= first if report == "sheet" else month == first or name == "InventorySummary" and month in (199903, 199904))
            wanted |= name == "ItemUsage" and (store, month) in used
            kept += wanted
            if not wanted:
                damaged += 1
                with open(path, "wb") as f:
                    f.write(b"not a table")
    assert damaged > 5 * kept > 0
    assert rows(run(c)) == rows(run(small_catalog))


def test_partition_filters_are_in_the_plan(spark, small_catalog, stored_root):
    c = Catalog.over(small_catalog, stored_root, FACTS)
    for df in (reports.item_activity_ledger(c, LedgerParams(**MARCH)), reports.item_usage_summary(c, Period(**MARCH))):
        scans = [x for x in plan(df).splitlines() if "FileScan parquet" in x and "/InvoiceRFC]" in x]
        assert scans and all(f"({layout.STORE}" in x.split("PartitionFilters:")[1] and f"({layout.MONTH}" in x.split("PartitionFilters:")[1] for x in scans)
    usage = [x for x in plan(reports.item_usage_summary(c, Period(**MARCH))).splitlines() if "FileScan parquet" in x and "/ItemUsage]" in x]
    assert usage and all("ubquery" in x.split("PartitionFilters:")[1] for x in usage)


def test_events_dated_away_from_their_source(spark, small_catalog, table):
    """Waste and transfers whose dates are in another month (or store) than their usage source, undated sources, orphan lines."""
    march, june = dt.datetime(1999, 3, 5), dt.datetime(1999, 6, 7)
    frames = {name: small_catalog[name] for name in layout.PLACES}
    frames["UsageSource"] = table("UsageSource", [(1, 2, june), (2, 2, None), (3, 1, march), (4, 2, march)])
    frames["Waste"] = table("Waste", [(1, march), (2, march), (4, june), (99, march)])
    frames["TransferContext"] = table("TransferContext", [(30, 3, 2), (31, 4, 1), (32, 1, 2)])
    frames["Transfer"] = table("Transfer", [(500, march, 30, 31), (501, june, 31, 32)])
    frames["ItemUsage"] = table("ItemUsage", [(s, i, Decimal(q), Decimal(1)) for s in (1, 2, 3, 4, 98) for i, q in ((7, 2 * s), (8, 1))])
    plain = Catalog.frames(spark, frames)
    c = Catalog.parquet(spark, materialize(plain, tempfile.mkdtemp(prefix="larder-odd-"), names=list(frames)))
    for start, end in (("1999-03-01", "1999-03-31"), ("1999-06-01", "1999-06-30"), ("1998-01-01", "1998-02-01")):
        p = Period(store=2, start=start, end=end)
        assert rows(movements.usage_lines(c, p)) == rows(movements.usage_lines(plain, p))
        q = LedgerParams(store=2, start=start, end=end)
        assert rows(ledger.usage_activity(c, q)) == rows(ledger.usage_activity(plain, q))
    assert rows(movements.usage_lines(c, Period(**MARCH)))  # not all empty


# ------------------------------------------------------------- receipts

def test_rank_orders_by_date_then_id(spark):
    days = [None, dt.datetime(1, 1, 1), dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(1970, 1, 1), dt.datetime(1999, 3, 1, 4, 5, 6, 7),
            dt.datetime(1999, 3, 1, 4, 5, 6, 8), dt.datetime(9999, 12, 31, 23, 59, 59)]
    ids = [-(1 << 63), -1, 0, 5, (1 << 63) - 1]
    made = spark.createDataFrame([(d, i) for d in days for i in ids], "d timestamp_ntz, i bigint")
    ranked = made.select("d", "i", receipts.receipt_rank(F.col("d"), F.col("i")).alias("r")).collect()
    by_rank = [(r.d, r.i) for r in sorted(ranked, key=lambda r: r.r)]
    assert by_rank == [(d, i) for d in days for i in ids] and len({r.r for r in ranked}) == len(ranked)


@pytest.fixture
def purchases(spark, table, small_catalog):
    """Invoices of three items and their vendors; a function that stores the given ones."""
    day = lambda m, d=1: dt.datetime(2000, m, d)
    vendors = table("Vendor", [(1, "Acme"), (2, "7 Internal"), (3, "Bolt"), (4, None)])
    cases = table("CaseSize", [(k, k, 1, f"OC-{k}", Decimal(1), Decimal(1), 0, 0, 0) for k in (10, 11, 12)])
    heads = [(100, 2, day(1), "a", 1), (101, 2, day(2), "b", 3), (102, 1, day(2), "c", 2), (103, 2, None, "d", 1), (104, 1, day(3), "e", 4)]
    lines = [(k * 10 + i, k, 10 + i, 1, Decimal(1), Decimal(1)) for k, *_ in heads for i in range(3) if (k, i) not in ((101, 1), (104, 0))]

    def make(chosen):
        return Catalog.frames(spark, {"Vendor": vendors, "CaseSize": cases, "Invoice": table("Invoice", [h for h in heads if h[0] in chosen]),
                                      "InvoiceItem": table("InvoiceItem", [x for x in lines if x[1] in chosen])})
    return make


def stored(spark, plain):
    names = ["InvoiceItem"]
    return Catalog.over(plain, materialize(plain, tempfile.mkdtemp(prefix="larder-buys-"), names=names), names)


def test_summary_and_newest_lines_give_the_same_supplier(spark, purchases):
    want = rows(recent_supplier(purchases({100, 101, 102, 103, 104})))
    c = stored(spark, purchases({100, 101, 102, 103, 104}))
    assert rows(recent_supplier(c)) == want
    receipts.summarise(c, [0, 200001])
    assert receipts.months(receipts.summary(c)) == [0, 200001] and rows(recent_supplier(c)) == want
    receipts.summarise(c)
    assert rows(recent_supplier(c)) == want
    scans = [x for x in plan(receipts.receipts(c)).splitlines() if "FileScan" in x]
    assert any(receipts.FOLDER in x for x in scans)


@pytest.mark.parametrize("in_time", [set(), {100, 103}, {101, 104}, {104}])
def test_late_invoices_fold_in_whatever_their_month(spark, purchases, in_time):
    every = {100, 101, 102, 103, 104}
    want, late = rows(recent_supplier(purchases(every))), purchases(every - in_time)
    c = stored(spark, purchases(in_time))
    receipts.summarise(c)
    for _ in range(2):  # a repeated run adds nothing
        receipts.append_invoices(c, late["Invoice"], late["InvoiceItem"])
        assert rows(c["InvoiceItem"]) == rows(purchases(every)["InvoiceItem"]) and rows(c["Invoice"]) == rows(purchases(every)["Invoice"])
        assert rows(recent_supplier(c)) == want


def test_a_failed_append_leaves_right_reports_and_can_be_repeated(spark, purchases, monkeypatch):
    every = {100, 101, 102, 103, 104}
    late, before = purchases({101, 102}), rows(recent_supplier(purchases({100, 103, 104})))
    write = layout.append
    for broken in ("InvoiceItem", "Invoice", "summary"):
        c = stored(spark, purchases({100, 103, 104}))
        receipts.summarise(c)

        def failing(rows_, root, name, broken=broken):
            if name == broken:
                raise OSError("lost")
            write(rows_, root, name)

        with monkeypatch.context() as m:
            m.setattr(layout, "append", failing)
            if broken == "summary":
                m.setattr(receipts, "_write", lambda *_: (_ for _ in ()).throw(OSError("lost")))
                m.setattr(receipts, "summarise", lambda *_: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                receipts.append_invoices(c, late["Invoice"], late["InvoiceItem"])
        c.refresh()
        assert rows(recent_supplier(c)) == (rows(recent_supplier(purchases(every))) if broken == "summary" else before)
        receipts.append_invoices(c, late["Invoice"], late["InvoiceItem"])
        assert rows(recent_supplier(c)) == rows(recent_supplier(purchases(every)))
        assert rows(c["InvoiceItem"]) == rows(purchases(every)["InvoiceItem"])


def test_eligibility_is_that_of_the_reader(spark, purchases, table):
    c = stored(spark, purchases({100, 101, 102}))
    receipts.summarise(c)
    c.placed("Vendor")
    c._frames["Vendor"] = c._plain["Vendor"] = table("Vendor", [(1, "Acme"), (2, "Renamed"), (3, "9 now internal")])
    assert {r.Item: r.SupplierName for r in recent_supplier(c).collect()} == {10: "Renamed", 11: "Renamed", 12: "Renamed"}


# ---------------------------------------------------------- kept ledger

def test_periods_are_kept_once_and_failures_keep_the_old_rows(spark, small_catalog):
    root = os.path.join(tempfile.mkdtemp(prefix="larder-kept-"), "ledger")
    march, april = LedgerParams(**MARCH), LedgerParams(store=2, start="1999-04-01 00:00:00", end="1999-04-30 23:59:59")
    for p in (march, april, march):
        kept_ledger.append_period(small_catalog, p, root)
    kept = kept_ledger.kept_ledger(spark, root)
    one = ledger.activity_ledger(small_catalog, march).withColumn("k", F.lit(19990301000000))
    two = ledger.activity_ledger(small_catalog, april).withColumn("k", F.lit(19990401000000))
    want = rows(one.unionByName(two))
    assert want and rows(kept.select(*ledger.LEDGER_COLUMNS, F.col("PeriodStart").alias("k"))) == want

    bad = one.drop("k").withColumn("ItemDescrip", F.when(F.col("ItemId") >= 0, F.raise_error(F.lit("lost"))).otherwise("x"))
    with pytest.raises(Exception, match="lost"):
        kept_ledger.write_period(bad, march.store, march.start, march.end, root)
    assert rows(kept_ledger.kept_ledger(spark, root).select(*ledger.LEDGER_COLUMNS, F.col("PeriodStart").alias("k"))) == want

    kept_ledger.write_period(one.drop("k").limit(0), march.store, march.start, march.end, root)  # the period has become empty
    assert rows(kept_ledger.kept_ledger(spark, root).select(*ledger.LEDGER_COLUMNS, F.col("PeriodStart").alias("k"))) == rows(two)
    assert "isnotnull(LedgerStore" in plan(kept_ledger.kept_ledger(spark, root).where("LedgerStore = 2")).split("PartitionFilters:")[1]


def test_a_kept_period_over_large_tables_is_the_same(spark, small_catalog):
    """Headers, lines and events are written on the way: rows as of the lazy ledger."""
    p = LedgerParams(store=2, start="1999-01-01 00:00:00", end="1999-12-31 00:00:00")
    root = os.path.join(tempfile.mkdtemp(prefix="larder-kept-"), "ledger")
    kept_ledger.append_period(small_catalog, p, root, staged=True)
    got = rows(kept_ledger.kept_ledger(spark, root).select(*ledger.LEDGER_COLUMNS))
    assert got and got == rows(ledger.activity_ledger(small_catalog, p, staged=False))
    assert "/larder-events-" in plan(ledger.activity_ledger(small_catalog, p, staged=True, apart=True))


def test_a_kept_period_is_never_a_part_of_its_items(small_catalog):
    with pytest.raises(ValueError):
        kept_ledger.append_period(small_catalog, LedgerParams(item_like="%ring%"), "/nowhere")


# --------------------------------------------------------- staged steps

def test_staged_ledger_reads_lookup_and_lines_once(spark, small_catalog):
    p = LedgerParams(store=2, start="1999-01-01 00:00:00", end="1999-12-31 00:00:00")
    staged, lazy = (reports.item_activity_ledger(small_catalog, p, staged=x) for x in (True, False))
    text = plan(staged)
    assert rows(staged) == rows(lazy)
    assert all(f"/larder-{name}-" in text for name in ("item-info", "purchases", "usage"))
    # of the line facts only the credits and the count lines are left to read, once each
    assert sum("FileScan parquet" in x and "/lineitem.parquet" in x for x in text.splitlines()) == 2


def test_staging_follows_the_bytes_read(spark, small_catalog, monkeypatch):
    info = ledger.item_info(small_catalog, LedgerParams(**MARCH))
    assert stages.stage_if_large(info) is info
    monkeypatch.setattr(stages, "STAGE_BYTES", 1)
    assert rows(stages.stage_if_large(info)) == rows(info) and "larder-stage-" in plan(stages.stage_if_large(info))


# ------------------------------------------------------------------ SQL

def test_sql_functions_are_inlined(spark, small_catalog):
    text = plan(sql.store_names(small_catalog, 2))
    assert "Python" not in text and "RetrieveStoreName" not in text
    got = {r.Store: r.StoreName for r in sql.store_names(small_catalog, 2).collect()}
    assert got == {r.StoreId: r.Name for r in small_catalog["Store"].collect() if r.StoreId in got}
    unknown = sql.statement(small_catalog, "SELECT RetrieveStoreName(:id) AS n, StartsNumeric(:v) AS s, ReportingQuantity(1, 0) AS q", id=99, v="$ x")
    assert tuple(unknown.head()) == (None, True, None)


def test_sql_search_as_the_frame_form(small_catalog):
    for p in (SearchParams(), SearchParams(store=1), SearchParams(item_term=None, order_code_term=None),
              SearchParams(store=2, item_term="RING", order_code_term="OC-1"), SearchParams(store=2, item_term=None, order_code_term="C-2")):
        assert rows(sql.item_search(small_catalog, p)) == rows(reports.item_search(small_catalog, p)), p


def test_sql_parameters_fold_at_planning(small_catalog):
    disabled = sql.item_search(small_catalog, SearchParams(item_term=None, order_code_term=None))
    text = disabled._jdf.queryExecution().optimizedPlan().toString()
    assert " LIKE " not in text and "Contains(" not in text and ":store" not in text
    enabled = sql.item_search(small_catalog, SearchParams(store=2, item_term="ring", order_code_term=None))
    assert "Contains(lower(p_name" in plan(enabled).replace("#", "") or "Contains(lower(" in plan(enabled)
