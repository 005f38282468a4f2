"""Registered queries: name -> (Spark plan builder, oracle SQL builder).

Parameters are the fixture defaults (store 2; March 1999, or all of 1999
for the ``_year`` variants; pick sheet as of 2001-07-31).  Each plan reads
the whole test tables through ``Catalog.derived``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import catalogue, dimensions, ledger, movements, requests, stages, usage
from ..params import LedgerParams, Period, PickSheetParams, SearchParams
from ..sources import Catalog
from . import oracle, reports, sql, stores

LEDGER = LedgerParams()
LEDGER_YEAR = LedgerParams(start="1999-01-01 00:00:00", end="1999-12-31 00:00:00")
LEDGER_SEARCH = LedgerParams(start="1999-01-01 00:00:00", end="1999-12-31 00:00:00",
                             item_like="%ring%", order_code_like="%oc-1%")
PERIOD = Period()
PERIOD_YEAR = Period(start="1999-01-01 00:00:00", end="1999-12-31 00:00:00")
PICK = PickSheetParams(as_of="2001-07-31 00:00:00")
PICK_CI = PickSheetParams(as_of="2001-07-31 00:00:00", case_insensitive=True)
SEARCH_ALL = SearchParams()
SEARCH_STORE = SearchParams(store=2)
SEARCH_TERMS = SearchParams(store=2, item_term="ring", order_code_term="OC-1")
LEDGER_CODES = LedgerParams(start="1999-01-01 00:00:00", end="1999-12-31 00:00:00", order_code_like="%OC-1%")
LEDGER_CODES_CI = LedgerParams(start="1999-01-01 00:00:00", end="1999-12-31 00:00:00", item_like="%ring%",
                               order_code_like="%oc-1%", case_insensitive=True)
LEDGER_CODED = LedgerParams(start="1999-01-01 00:00:00", end="1999-12-31 00:00:00", order_code_like="%")
LEDGER_STORE_1 = LedgerParams(store=1, start="1999-01-01 00:00:00", end="1999-06-30 00:00:00")
KEPT = [LEDGER, LedgerParams(store=1, start="1999-04-01 00:00:00", end="1999-05-31 23:59:59"),
        LedgerParams(start="1999-04-01 00:00:00", end="1999-04-30 23:59:59")]
SEARCH_NO_TERMS = SearchParams(store=2, item_term=None, order_code_term=None)
SEARCH_ITEM_STORE = SearchParams(last_received_scope="item_store")
SEARCH_TERMS_CI = SearchParams(store=2, item_term="ring", order_code_term="oc-1", case_insensitive=True)


@dataclass(frozen=True)
class Query:
    plan: Callable[[Catalog], DataFrame]
    sql: Callable[[], str] | None
    doc: str = ""


def _branch(fn, name):
    return Query(lambda c: fn(c, LEDGER), lambda: oracle.ledger_branch(LEDGER, name),
                 f"ledger branch: {name}")


REGISTRY: dict[str, Query] = {
    # reports
    "item_activity_ledger": Query(lambda c: reports.item_activity_ledger(c, LEDGER),
                                  lambda: oracle.item_activity_ledger(LEDGER), "R1"),
    "item_activity_ledger_year": Query(lambda c: reports.item_activity_ledger(c, LEDGER_YEAR),
                                       lambda: oracle.item_activity_ledger(LEDGER_YEAR), "R1, all of 1999"),
    "item_activity_ledger_search": Query(lambda c: reports.item_activity_ledger(c, LEDGER_SEARCH),
                                         lambda: oracle.item_activity_ledger(LEDGER_SEARCH),
                                         "R1 with item and order-code patterns"),
    "stock_request_pick_sheet": Query(lambda c: reports.stock_request_pick_sheet(c, PICK),
                                      lambda: oracle.stock_request_pick_sheet(PICK), "R2"),
    "stock_request_pick_sheet_ci": Query(lambda c: reports.stock_request_pick_sheet(c, PICK_CI),
                                         lambda: oracle.stock_request_pick_sheet(PICK_CI),
                                         "R2, unit codes compared case-insensitively"),
    "item_search": Query(lambda c: reports.item_search(c, SEARCH_ALL),
                         lambda: oracle.item_search(SEARCH_ALL), "R3, all stores"),
    "item_search_store": Query(lambda c: reports.item_search(c, SEARCH_STORE),
                               lambda: oracle.item_search(SEARCH_STORE), "R3, one store"),
    "item_search_terms": Query(lambda c: reports.item_search(c, SEARCH_TERMS),
                               lambda: oracle.item_search(SEARCH_TERMS), "R3 with search terms"),
    "item_search_terms_ci": Query(lambda c: reports.item_search(c, SEARCH_TERMS_CI),
                                  lambda: oracle.item_search(SEARCH_TERMS_CI),
                                  "R3 with a case-insensitive order-code term"),
    "item_usage_summary": Query(lambda c: reports.item_usage_summary(c, PERIOD),
                                lambda: oracle.item_usage_summary(PERIOD), "R4"),
    "item_usage_summary_year": Query(lambda c: reports.item_usage_summary(c, PERIOD_YEAR, include_hidden=True),
                                     lambda: oracle.item_usage_summary(PERIOD_YEAR, include_hidden=True),
                                     "R4, all of 1999, hidden columns shown"),
    "item_activity_ledger_codes": Query(lambda c: reports.item_activity_ledger(c, LEDGER_CODES),
                                        lambda: oracle.item_activity_ledger(LEDGER_CODES),
                                        "R1, order codes in their stored case (purchases match)"),
    "item_activity_ledger_codes_ci": Query(lambda c: reports.item_activity_ledger(c, LEDGER_CODES_CI),
                                           lambda: oracle.item_activity_ledger(LEDGER_CODES_CI),
                                           "R1, order codes compared case-insensitively"),
    "item_activity_ledger_coded": Query(lambda c: reports.item_activity_ledger(c, LEDGER_CODED),
                                        lambda: oracle.item_activity_ledger(LEDGER_CODED),
                                        "R1, pattern '%': items without an order code drop out"),
    "item_search_no_terms": Query(lambda c: reports.item_search(c, SEARCH_NO_TERMS),
                                  lambda: oracle.item_search(SEARCH_NO_TERMS), "R3, search terms disabled"),
    "item_search_item_store": Query(lambda c: reports.item_search(c, SEARCH_ITEM_STORE),
                                    lambda: oracle.item_search(SEARCH_ITEM_STORE), "R3, last receipt per item and store"),
    # reports over facts in the stored layout, through staged steps, and in SQL
    "item_activity_ledger_stored": Query(
        lambda c: reports.item_activity_ledger(stores.stored_facts(c, stores.LEDGER_FACTS), LEDGER_STORE_1, staged=True),
        lambda: oracle.item_activity_ledger(LEDGER_STORE_1), "R1 over the stored layout, each line fact read once"),
    "item_activity_ledger_staged": Query(lambda c: reports.item_activity_ledger(c, LEDGER_YEAR, staged=True),
                                         lambda: oracle.item_activity_ledger(LEDGER_YEAR), "R1 with its lookup and lines written once"),
    "item_lookup_staged": Query(lambda c: stages.stage(ledger.item_info(c, LEDGER)), lambda: oracle.item_info(LEDGER), "D2 as a stored table"),
    "item_usage_summary_stored": Query(
        lambda c: reports.item_usage_summary(stores.stored_facts(c, stores.USAGE_FACTS, summary=True), PERIOD),
        lambda: oracle.item_usage_summary(PERIOD), "R4 over the stored layout and the receipt summary"),
    "stock_request_pick_sheet_stored": Query(
        lambda c: reports.stock_request_pick_sheet(stores.stored_facts(c, stores.REQUEST_FACTS), PICK),
        lambda: oracle.stock_request_pick_sheet(PICK), "R2 over the stored layout"),
    "item_search_folded": Query(
        lambda c: reports.item_search(stores.late_invoices(c), SEARCH_STORE),
        lambda: oracle.item_search(SEARCH_STORE), "R3 from the receipt summary, late invoices folded in, and the newest month's lines"),
    "recent_supplier_folded": Query(lambda c: dimensions.recent_supplier(stores.late_invoices(c)), oracle.recent_supplier,
                                    "D16 from the receipt summary, late invoices folded in, and the newest month's lines"),
    "kept_ledger": Query(lambda c: stores.kept_periods(c, KEPT), lambda: oracle.kept_ledger(KEPT), "append sink: periods kept, one of them run twice"),
    "item_search_sql": Query(lambda c: sql.item_search(c, SEARCH_TERMS), lambda: oracle.item_search(SEARCH_TERMS),
                             "R3 in SQL with parameter markers"),
    "item_search_sql_all": Query(lambda c: sql.item_search(c, SearchParams(item_term=None, order_code_term=None)),
                                 lambda: oracle.item_search(SearchParams(item_term=None, order_code_term=None)),
                                 "R3 in SQL, every filter disabled"),
    "store_name_sql": Query(lambda c: sql.store_names(c, PERIOD.store), lambda: oracle.item_store_names(PERIOD.store),
                            "D27 as a SQL function"),
    # ledger operators
    "activity_ledger_output": Query(
        lambda c: reports.ledger_output(ledger.activity_ledger(c, LEDGER_STORE_1), ledger.item_info(c, LEDGER_STORE_1)),
        lambda: oracle.item_activity_ledger(LEDGER_STORE_1), "D9, another store"),
    "activity_ledger_subtotals": Query(lambda c: ledger.activity_ledger(c, LEDGER_YEAR, with_subtotals=True),
                                       lambda: oracle.activity_with_subtotals(LEDGER_YEAR), "ledger rows and D10 rows"),
    "active_items": Query(lambda c: ledger.active_items(c, LEDGER), lambda: oracle.active_items(LEDGER), "D1"),
    "item_info": Query(lambda c: ledger.item_info(c, LEDGER), lambda: oracle.item_info(LEDGER), "D2"),
    "ledger_opening_inventory": _branch(ledger.ledger_opening_inventory, "opening"),
    "ledger_purchases": _branch(ledger.ledger_purchases, "purchases"),
    "ledger_waste": _branch(ledger.ledger_waste, "waste"),
    "ledger_transfer_in": _branch(ledger.ledger_transfer_in, "transfer_in"),
    "ledger_transfer_out": _branch(ledger.ledger_transfer_out, "transfer_out"),
    "ledger_ending_inventory": _branch(ledger.ledger_ending_inventory, "ending"),
    "activity_subtotal": Query(lambda c: ledger.activity_subtotal(ledger.activity_ledger(c, LEDGER_YEAR)),
                               lambda: oracle.activity_subtotal(LEDGER_YEAR), "D10"),
    "ledger_unit_cost": Query(lambda c: ledger.ledger_unit_cost(ledger.activity_ledger(c, LEDGER_YEAR)),
                              lambda: oracle.ledger_unit_cost(LEDGER_YEAR), "D11"),
    # pick sheet operators
    "latest_requisition_status": Query(lambda c: requests.latest_requisition_status(c),
                                       oracle.latest_requisition_status, "D12"),
    "latest_item_status": Query(lambda c: requests.latest_item_status(c), oracle.latest_item_status, "D13"),
    "open_requests": Query(lambda c: requests.open_requests(c, PICK), lambda: oracle.open_requests(PICK), "D14"),
    "uom_mismatch_flag": Query(lambda c: requests.uom_mismatches(c, PICK), lambda: oracle.uom_mismatches(PICK), "D15"),
    # shared dimension operators
    "item_search_filter": Query(
        lambda c: dimensions.item_search_filter(dimensions.item_order_codes(c), "ring", "OC-1"),
        lambda: oracle.item_search_filter("ring", "OC-1"), "D18"),
    "store_name": Query(lambda c: dimensions.item_store_names(c, PERIOD.store), lambda: oracle.item_store_names(PERIOD.store), "D27"),
    "reporting_units": Query(dimensions.reporting_units, oracle.reporting_units, "D28"),
    "recent_supplier": Query(dimensions.recent_supplier, oracle.recent_supplier, "D16"),
    "item_catalogue": Query(lambda c: catalogue.item_catalogue(c, SEARCH_ALL),
                            lambda: oracle.item_catalogue(SEARCH_ALL), "D17"),
    "item_category": Query(lambda c: dimensions.with_category(c, c["Item"].select("ItemId", "ItemGroup"))
                           .select("ItemId", "CategoryName"), oracle.item_category, "D29"),
    "item_primary_location": Query(lambda c: dimensions.item_primary_location(c, PERIOD.store),
                                   lambda: oracle.item_primary_location(PERIOD.store), "D30"),
    "packaging_units": Query(lambda c: dimensions.packaging_units(
        c, c["CaseSize"].select("CaseSizeId", "PurchaseUom", "CaseUom", "PakUom")),
        oracle.packaging_units, "D31"),
    "reporting_factor": Query(lambda c: dimensions.reporting_factor(c), oracle.reporting_factor, "D28 inputs"),
    # usage summary operators
    "period_opening_inventory": Query(lambda c: movements.period_opening_inventory(c, PERIOD),
                                      lambda: oracle.period_count(PERIOD, "OpenDate"), "D19"),
    "period_closing_inventory": Query(lambda c: movements.period_closing_inventory(c, PERIOD),
                                      lambda: oracle.period_count(PERIOD, "CloseDate"), "D20"),
    "period_purchases": Query(lambda c: movements.period_purchases(c, PERIOD_YEAR),
                              lambda: oracle.period_purchases(PERIOD_YEAR), "D21"),
    "period_transfer_out": Query(lambda c: movements.period_transfer_out(c, PERIOD_YEAR),
                                 lambda: oracle.period_movement(PERIOD_YEAR, "TOut", "TransferOutQty"), "D22"),
    "period_transfer_in": Query(lambda c: movements.period_transfer_in(c, PERIOD_YEAR),
                                lambda: oracle.period_movement(PERIOD_YEAR, "TIn", "TransferInQty"), "D23"),
    "period_waste": Query(lambda c: movements.period_waste(c, PERIOD_YEAR),
                          lambda: oracle.period_movement(PERIOD_YEAR, "Wst", "WasteQty"), "D24"),
    "movement_filter": Query(lambda c: usage.movement_filter(usage.usage_table(c, PERIOD_YEAR, all_items=True)),
                             lambda: oracle.movement_filter(PERIOD_YEAR), "D26 over every item"),
    "item_usage_balance": Query(lambda c: usage.usage_table(c, PERIOD, all_items=True),
                                lambda: oracle.item_usage_balance(PERIOD), "D25 over every item"),
}


def spark_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    query = REGISTRY[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query.plan(Catalog.derived(spark, sf_dir))

    run.__name__ = name
    run.__doc__ = query.doc
    return run


def oracle_statements() -> dict[str, str]:
    return {name: q.sql() for name, q in REGISTRY.items() if q.sql is not None}
