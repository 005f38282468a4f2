"""The written-warehouse path gives the same reports as the derived path."""

import tempfile

from conftest import SF_SMALL
from larder.plans.registry import REGISTRY
from larder.sources import Catalog, materialize


def test_reports_over_materialized_domain_match(spark):
    derived = Catalog.derived(spark, SF_SMALL)
    root = materialize(derived, tempfile.mkdtemp(prefix="larder-wh-"), by_year=True)
    stored = Catalog.parquet(spark, root)
    for name in ["item_usage_summary_year", "item_activity_ledger_year", "stock_request_pick_sheet",
                 "item_search_store"]:
        a = REGISTRY[name].plan(derived)
        b = REGISTRY[name].plan(stored)
        # Parquet reads every column back as nullable; names and types must match
        assert [(f.name, f.dataType) for f in a.schema] == [(f.name, f.dataType) for f in b.schema], name
        assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr), name


def test_store_partitioned_headers_prune_directories(spark):
    root = materialize(Catalog.derived(spark, SF_SMALL), tempfile.mkdtemp(prefix="larder-wh-"), names=["Invoice"])
    inv = Catalog.parquet(spark, root).of_period("Invoice", 2)
    plan = inv._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(PartStore" in plan and "(PartStore" in plan
