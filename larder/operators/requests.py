"""Stock request (requisition) operators for the pick sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import days_before, mismatch_flag
from ..params import FULFILLED, UOM_OK, PickSheetParams
from ..sources import Catalog, layout
from .dimensions import with_uom_codes
from .keyed import rows_at_max
from .stages import STAGE_BYTES, read_bytes, stage

#: The tables that are cut to the requests a report can show.
LINE_TABLES = ("RequisitionStatus", "RequisitionItem", "RequisitionItemStatus")


def latest_requisition_status(c: Catalog, requisitions: DataFrame | None = None) -> DataFrame:
    """Status rows at the latest effective date of each requisition (ties
    kept).  With ``requisitions`` (a frame with ``Requisition``) the history
    is first cut to those requisitions — the latest status of a requisition
    depends only on its own history, so this is exact and keeps the
    aggregation to the requests a report can show."""
    hist = c["RequisitionStatus"] if requisitions is None else c.of_headers("RequisitionStatus", requisitions)
    hist = hist.select("Requisition", "Status", "EffectiveDate", "Employee")
    if requisitions is not None:
        hist = hist.join(requisitions.select("Requisition"), "Requisition", "left_semi")
    return rows_at_max(hist, "Requisition", "EffectiveDate")


def latest_item_status(c: Catalog, lines: DataFrame | None = None, headers: DataFrame | None = None) -> DataFrame:
    """Line-status rows carrying the highest status id of each requisition
    line (ties kept); optionally cut to ``lines`` (``RequisitionItem``) and to
    the partitions of ``headers``."""
    hist = c["RequisitionItemStatus"] if headers is None else c.of_headers("RequisitionItemStatus", headers)
    hist = hist.select("RequisitionItem", "Qty", "Uom", "RequisitionStatus")
    if lines is not None:
        hist = hist.join(lines.select("RequisitionItem"), "RequisitionItem", "left_semi")
    return rows_at_max(hist, "RequisitionItem", "RequisitionStatus")


def request_lines(c: Catalog, requisitions: DataFrame, staged: bool = False) -> tuple[DataFrame, DataFrame]:
    """The lines of ``requisitions`` (a frame with ``Requisition``) and their
    latest status rows.  Over the stored layout a line lies in the partition
    of its requisition, and its history in that of the line.  ``staged``: the
    lines are written once, as the requests are (``staged_candidates``)."""
    carried = [x for x in c.partition_columns("Requisition", "RequisitionItem") if x in requisitions.columns]
    rows = c.placed("RequisitionItem")
    if carried:
        rows = layout.within(rows, requisitions)
    lines = (rows.select(F.col("RequisitionItemId").alias("RequisitionItem"), "Requisition", "Item", *carried)
             .join(requisitions.select("Requisition"), "Requisition", "left_semi"))
    if staged:
        lines = stage(lines, "request-lines")
    bounds = requisitions.select(*carried) if carried else lines
    return lines, latest_item_status(c, lines, bounds)


def candidate_requisitions(c: Catalog, p: PickSheetParams) -> DataFrame:
    """Requests sent by the store and required on or after ``as_of`` minus
    the look-back (no upper bound: future dates are included)."""
    since = days_before(p.as_of, p.lookback_days)
    return c.of_period("Requisition", p.store, since).where((F.col("SendingStore") == p.store) & (F.col("DateRequired") >= since))


def large_lines(c: Catalog) -> bool:
    """Whether cutting the line tables repays writing what they are cut to."""
    return sum(read_bytes(c[name]) for name in LINE_TABLES) > STAGE_BYTES


def staged_candidates(c: Catalog, p: PickSheetParams, staged: bool) -> DataFrame:
    """The candidates, with ``Requisition`` as their key, written once if ``staged``.

    The planner knows nothing of how few requests a look-back leaves, so over
    the lazy candidates it shuffles every line table whole for each of its
    readers.  A written table has an exact size: where it is small the lines
    are cut to it where they are read, and only what is left is shuffled."""
    req = candidate_requisitions(c, p).withColumnRenamed("RequisitionId", "Requisition")
    return stage(req, "requests") if staged else req


def open_requests(c: Catalog, p: PickSheetParams, staged: bool | None = None) -> DataFrame:
    """Candidate requests whose latest status is not fulfilled, one row per
    latest status row."""
    req = staged_candidates(c, p, large_lines(c) if staged is None else staged)
    latest = latest_requisition_status(c, req).where(F.col("Status") != FULFILLED)
    return req.join(latest, "Requisition").drop(layout.STORE, layout.MONTH)


def uom_mismatches(c: Catalog, p: PickSheetParams) -> DataFrame:
    """Every requisition line status with the unit it was requested in, the
    item's reporting unit and whether they differ."""
    lines = c["RequisitionItem"].select(F.col("RequisitionItemId").alias("RequisitionItem"), "Item")
    units = c["ItemConversionFactor"].select("Item", "ReportingUom")
    j = c["RequisitionItemStatus"].select("RequisitionItem", F.col("Uom").alias("RequestUom")).join(lines, "RequisitionItem").join(units, "Item")
    j = with_uom_codes(c, j, {"RequestUom": "RequestUom", "ReportingUom": "ReportingUom"})
    flag = mismatch_flag(F.col("RequestUom"), F.col("ReportingUom"), p.mismatch_label, UOM_OK, p.case_insensitive)
    return j.select("RequisitionItem", "RequestUom", "ReportingUom", flag.alias("UomMismatchFlag"))
