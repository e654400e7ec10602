"""The rule program: extractions and enterprise tables to the exception table."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.model import MIN_CONFIDENCE
from ledgerlens.operators import eav, rules
from ledgerlens.session import stage


def invoice_vendor(t: dict[str, DataFrame]) -> DataFrame:
    return rules.resolve_vendor(eav.invoice_header(t["extractions"]), t["vendors"])


def run_rules(t: dict[str, DataFrame], as_of: dt.date, threshold: float = MIN_CONFIDENCE, run_ts: Column | None = None) -> DataFrame:
    """All exceptions of all invoices.

    Results used more than once are written: resolved invoices, lines over their order or receipt, and the output of the
    first seven rules, which the discount rule excludes.
    """
    iv = stage(invoice_vendor(t), "invoice_vendor")
    flagged = stage(
        reduce(DataFrame.unionByName, [
            rules.bank_mismatch(iv, t["vendors"]),
            rules.duplicate(iv, t["payments"]),
            rules.unknown_vendor(iv),
            rules.no_po(iv, t["purchase_orders"]),
            rules.line_overages(iv, eav.invoice_lines(t["extractions"]), t["po_lines"], t["goods_receipts"]),
            rules.low_confidence(t["extractions"], iv, threshold),
        ]),
        "flagged",
    )
    found = flagged.unionByName(rules.discount_window(iv, flagged, as_of))
    return found.withColumn("created_at", run_ts if run_ts is not None else F.current_timestamp())
