"""Stored forms of a catalog that the registered queries run over.

Each writes the whole tables it names under the shared folder and returns
what a deployment would keep between runs; nothing is left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import kept_ledger, receipts
from ..operators.stages import stage
from ..params import LedgerParams
from ..session import shared_folder
from ..sources import Catalog, layout, materialize

PURCHASE_FACTS = ("InvoiceItem",)
LEDGER_FACTS = ("InvoiceRFC", "ItemUsage", "Waste", "TransferContext", "Transfer", "InventorySummary")
USAGE_FACTS = LEDGER_FACTS
REQUEST_FACTS = ("RequisitionStatus", "RequisitionItemStatus")
#: Invoices whose id this divides reach the store late.
LATE = 5


def stored_facts(c: Catalog, names: Sequence[str], summary: bool = False) -> Catalog:
    """``c`` with the named facts in the stored layout; with the receipt summary if asked."""
    # the test tables have some ten rows a store and month
    out = Catalog.over(c, materialize(c, names=names, by_year=True), names)
    if summary:
        receipts.summarise(out)
    return out


def late_invoices(c: Catalog) -> Catalog:
    """Purchases as they build up: the invoices in time are stored and
    summarised, but for the newest month; then the late ones are appended,
    twice over, as after a failed run."""
    late = F.col("InvoiceId") % LATE == 0
    heads, lines = stage(c["Invoice"], "invoices"), stage(c["InvoiceItem"], "lines")
    late_heads = heads.where(late)
    in_time = Catalog.frames(c.spark, {
        "Invoice": heads.where(~late), "InvoiceItem": lines.join(late_heads, F.col("Invoice") == F.col("InvoiceId"), "left_anti")})
    root = materialize(in_time, names=PURCHASE_FACTS, by_year=True)
    out = Catalog.over(c, root, PURCHASE_FACTS)
    months = sorted(r[0] for r in out.placed("Invoice").select(layout.MONTH).distinct().collect())
    receipts.summarise(out, months[:-1])
    late_lines = lines.join(late_heads.select(F.col("InvoiceId").alias("Invoice")), "Invoice", "left_semi")
    for _ in range(2):
        receipts.append_invoices(out, late_heads, late_lines)
    return out


def kept_periods(c: Catalog, periods: Sequence[LedgerParams]) -> DataFrame:
    """A kept ledger after all periods have been run, the first of them twice."""
    root = f"{shared_folder(c.spark)}/larder-ledger-{uuid.uuid4().hex}"
    for p in [*periods, periods[0]]:
        kept_ledger.append_period(c, p, root)
    return kept_ledger.kept_ledger(c.spark, root)
