"""Plan-shape checks: the properties the reports rely on at scale."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from larder.plans.registry import REGISTRY

# entries that write stored tables while they are built have their plan checks in test_stored.py
WRITES = ("_stored", "_staged", "_folded", "kept_ledger")
QUERIES = {name: q for name, q in entry.queries().items() if name in REGISTRY and not name.endswith(WRITES)}
REPORTS = ["item_activity_ledger", "stock_request_pick_sheet", "item_search", "item_usage_summary"]


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_or_python_in_plan(spark, name):
    plan = physical(QUERIES[name](spark, SF_SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
                "FlatMapGroupsInPandas", "MapInPandas"):
        assert bad not in plan, f"{name}: {bad}"


@pytest.mark.parametrize("name", ["recent_supplier", "latest_requisition_status", "latest_item_status",
                                  "item_usage_summary", "stock_request_pick_sheet"])
def test_per_key_selection_is_an_aggregate_not_a_window(spark, name):
    """A window partitioned by a hot key puts all its rows in one task; the
    per-key picks are partial aggregations instead."""
    plan = physical(QUERIES[name](spark, SF_SMALL))
    for line in plan.splitlines():  # the line table numbers the rows of one (order, line number), a handful each
        assert "windowspecdefinition" not in line or "windowspecdefinition(l_orderkey" in line, line
    assert "partial_max" in plan


@pytest.mark.parametrize("name", ["recent_supplier", "item_search", "item_usage_summary"])
def test_recent_supplier_is_hash_aggregated(spark, name):
    assert "SortAggregate" not in physical(QUERIES[name](spark, SF_SMALL))


def test_period_filters_reach_the_scan(spark):
    plan = physical(QUERIES["item_usage_summary"](spark, SF_SMALL))
    assert "GreaterThanOrEqual(o_orderdate,1999-03-01T00:00)" in plan


def test_pick_sheet_look_back_reaches_the_scan(spark):
    plan = physical(QUERIES["stock_request_pick_sheet"](spark, SF_SMALL))
    assert "GreaterThanOrEqual(o_orderdate,2001-07-01T00:00)" in plan


def test_scan_reads_only_needed_columns(spark):
    plan = physical(QUERIES["period_waste"](spark, SF_SMALL))
    for line in plan.splitlines():
        if "FileScan parquet" in line and "lineitem" in line:
            assert "l_extendedprice" not in line and "l_shipdate" not in line


def scans(plan: str, table: str) -> int:
    return sum("FileScan parquet" in line and f"/{table}.parquet" in line for line in plan.splitlines())


@pytest.mark.parametrize("name,most", [("item_usage_summary", 6), ("stock_request_pick_sheet", 7), ("recent_supplier", 2), ("item_activity_ledger", 8)])
def test_line_scans(spark, name, most):
    assert scans(physical(QUERIES[name](spark, SF_SMALL)), "lineitem") <= most


def test_waste_alone_reads_no_transfer_contexts(spark):
    plan = physical(QUERIES["ledger_waste"](spark, SF_SMALL))
    assert plan.count("(o_orderkey") >= 1 and "other_ctx" not in plan


def broadcast_subtrees(plan: str):
    """The lines below each broadcast exchange."""
    lines = plan.splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((m for m in range(k + 1, len(lines)) if depth[m] <= depth[k]), len(lines))
            yield "\n".join(lines[k: end])


@pytest.mark.parametrize("name", ["item_search", "item_search_item_store", "item_catalogue", "item_search_sql_all"])
def test_search_broadcasts_no_item_table(spark, name):
    """Item tables are small files of many rows: held by the driver they end it."""
    subtrees = list(broadcast_subtrees(physical(QUERIES[name](spark, SF_SMALL))))
    assert subtrees
    for tree in subtrees:
        assert "p_partkey" not in tree and "l_partkey" not in tree, tree


def lines_cut_first(plan: str) -> list[bool]:
    """For each scan of the line table: whether the first exchange or semi join above it is a broadcast semi join."""
    lines = plan.splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    out = []
    for k, line in enumerate(lines):
        if "FileScan parquet" in line and "/lineitem.parquet" in line:
            above, low = [], depth[k]
            for m in range(k - 1, -1, -1):  # from the scan up to the root
                if depth[m] < low:
                    above.append(lines[m])
                    low = depth[m]
            out.append("BroadcastHashJoin" in next(x for x in above if "Exchange" in x or "LeftSemi" in x))
    return out


@pytest.mark.parametrize("report", ["stock_request_pick_sheet", "open_requests"])
def test_pick_sheet_cuts_large_line_tables_before_their_shuffle(spark, small_catalog, report):
    """With the few requests of the look-back written, no exchange takes a whole line table."""
    from larder.operators.requests import open_requests
    from larder.plans.registry import PICK
    from larder.plans.reports import stock_request_pick_sheet
    run = {"stock_request_pick_sheet": stock_request_pick_sheet, "open_requests": open_requests}[report]
    limit = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(limit)
    spark.conf.set(limit, "2k")  # less than the keys of all orders are estimated at, more than the written ones
    try:
        staged, lazy = run(small_catalog, PICK, staged=True), run(small_catalog, PICK, staged=False)
        cut, uncut = lines_cut_first(physical(staged)), lines_cut_first(physical(lazy))
        assert len(cut) >= 2 and all(cut) and not any(uncut), (cut, uncut)
        assert sorted(map(str, staged.collect())) == sorted(map(str, lazy.collect()))
    finally:
        spark.conf.set(limit, old)


@pytest.mark.parametrize("staged", [False, True])
def test_kept_ledger_broadcasts_no_item_table(spark, small_catalog, staged):
    """The ledger of a kept period holds no table of items in the driver, whatever its file's bytes."""
    from larder.operators.ledger import activity_ledger
    from larder.plans.registry import KEPT
    subtrees = list(broadcast_subtrees(physical(activity_ledger(small_catalog, KEPT[0], staged=staged))))
    assert subtrees
    for tree in subtrees:
        assert "p_partkey" not in tree and "l_partkey" not in tree, tree


def test_kept_ledger_writes_usage_without_broadcasting_parts(spark, small_catalog):
    from larder.operators.ledger import usage_activity
    from larder.plans.registry import KEPT
    for staged in (False, True):
        assert not any("p_partkey" in tree for tree in broadcast_subtrees(physical(usage_activity(small_catalog, KEPT[0], staged=staged))))


def test_kept_ledger_cuts_large_line_tables_before_their_shuffle(spark, small_catalog):
    """With the headers of the period written, purchased and used lines are cut where they are read."""
    from larder.operators import ledger
    from larder.plans.registry import KEPT
    lines = [lambda staged: ledger._store_purchases(small_catalog, KEPT[0], staged),
             lambda staged: ledger.usage_activity(small_catalog, KEPT[0], staged=staged)]
    limit = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(limit)
    spark.conf.set(limit, "3k")  # less than the keys of all orders are estimated at, more than the written ones
    try:
        for make in lines:
            cut, uncut = lines_cut_first(physical(make(True))), lines_cut_first(physical(make(False)))
            assert cut == [True] and uncut == [False], (cut, uncut)
            assert sorted(map(str, make(True).collect())) == sorted(map(str, make(False).collect()))
    finally:
        spark.conf.set(limit, old)
