"""Run one report from the command line.

    python -m larder ledger  --source /root/testdata/sf0.01 --store 2 --start 1999-03-01 --end 1999-03-31
    python -m larder usage   --source /root/testdata/sf0.01 --store 2 --start 1999-03-01 --end 1999-03-31
    python -m larder picksheet --source /root/testdata/sf0.01 --store 2 --as-of "2001-07-31 00:00:00"
    python -m larder search  --source /root/testdata/sf0.01 [--store 2] [--item ring] [--order-code OC-1]

``--source`` is a folder of test tables (domain derived on the fly) or, with
``--warehouse``, a folder written by ``larder.sources.materialize``.  The
result is shown (``--show N``) or written with ``--out PATH`` (Parquet, or
CSV with ``--format csv``) — the report's result set, as the original
scripts return it.  ``--explain`` prints the formatted physical plan instead.
"""

from __future__ import annotations

import argparse
import sys

from .params import MATCH_ALL, LedgerParams, Period, PickSheetParams, SearchParams


def _parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="python -m larder", description=__doc__.split("\n\n")[0])
    ap.add_argument("report", choices=["ledger", "usage", "picksheet", "search"])
    ap.add_argument("--source", required=True, help="test-table folder, or warehouse folder with --warehouse")
    ap.add_argument("--warehouse", action="store_true", help="--source is a materialized domain folder")
    ap.add_argument("--store", type=int)
    ap.add_argument("--start")
    ap.add_argument("--end")
    ap.add_argument("--item", help="description pattern / search term")
    ap.add_argument("--order-code", help="order-code pattern / search term")
    ap.add_argument("--as-of", help="pick sheet reference time (default: now)")
    ap.add_argument("--all-stores-last-received", choices=["item", "item_store"], default="item")
    ap.add_argument("--subtotals", action="store_true", help="ledger: add one subtotal row per item")
    ap.add_argument("--out", help="write the result here instead of showing it")
    ap.add_argument("--format", choices=["parquet", "csv"], default="parquet")
    ap.add_argument("--show", type=int, default=50)
    ap.add_argument("--explain", action="store_true", help="print the formatted physical plan instead of running")
    return ap


def build(args, catalog):
    from .plans import reports

    def period_kwargs():
        if args.store is None or not args.start or not args.end:
            raise SystemExit("--store, --start and --end are required for this report")
        return dict(store=args.store, start=args.start, end=args.end)

    if args.report == "ledger":
        p = LedgerParams(**period_kwargs(), item_like=args.item or MATCH_ALL,
                         order_code_like=args.order_code or MATCH_ALL)
        return reports.item_activity_ledger(catalog, p, with_subtotals=args.subtotals)
    if args.report == "usage":
        return reports.item_usage_summary(catalog, Period(**period_kwargs()))
    if args.report == "picksheet":
        if args.store is None:
            raise SystemExit("--store is required for the pick sheet")
        return reports.stock_request_pick_sheet(catalog, PickSheetParams(store=args.store, as_of=args.as_of))
    p = SearchParams(store=args.store, item_term=args.item if args.item is not None else MATCH_ALL,
                     order_code_term=args.order_code if args.order_code is not None else MATCH_ALL,
                     last_received_scope=args.all_stores_last_received)
    return reports.item_search(catalog, p)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from .sources import Catalog

    spark = SparkSession.builder.appName(f"larder-{args.report}").getOrCreate()
    catalog = (Catalog.parquet(spark, args.source) if args.warehouse
               else Catalog.derived(spark, args.source))
    df = build(args, catalog)
    if args.explain:
        df.explain("formatted")
    elif args.out:
        writer = df.write.mode("overwrite")
        (writer.option("header", True).csv(args.out) if args.format == "csv" else writer.parquet(args.out))
    else:
        df.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
