"""Edge cases of the rules on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens.model import DOCUMENT_SCHEMAS, ERP_SCHEMAS
from ledgerlens.operators import eav, rules
from ledgerlens.plans.exceptions import run_rules

AS_OF = dt.date(2026, 10, 8)
HEADER = {"vendor_name": "Acme", "vendor_tax_id": "12-3456789", "invoice_number": "INV-1", "invoice_date": "2026-09-01", "po_number": "PO-1",
          "payment_terms": "Net 30", "bank_name": "First", "bank_account": "0045 12", "total": "100.00"}


@pytest.fixture(scope="module")
def build(spark):
    def make(docs, vendors=None, lines=(), pos=None, po_lines=(), receipts=(), payments=()):
        rows = []
        for doc_id, change in docs.items():
            conf = change.pop("_confidence", {})
            for f, v in {**HEADER, **change}.items():
                rows.append((doc_id, f, None, v, conf.get(f, 0.97), 1, None, None, "m", None))
        for doc_id, n, f, v in lines:
            rows.append((doc_id, f, n, v, 0.97, 1, None, None, "m", None))
        vendors = vendors or [("V1", "Acme", "a", "12-3456789", "First", "012", "004512", "Net 30", "active")]
        frames = {"vendors": vendors, "purchase_orders": pos if pos is not None else [("PO-1", "V1", None, "b", "open")], "po_lines": po_lines,
                  "goods_receipts": receipts, "payments": payments}
        t = {n: spark.createDataFrame(list(r), ERP_SCHEMAS[n]) for n, r in frames.items()}
        t["extractions"] = spark.createDataFrame(rows, DOCUMENT_SCHEMAS["extractions"])
        return t

    return make


def found(t, **kw):
    return sorted((r.doc_id, r.rule_code) for r in run_rules(t, AS_OF, **kw).collect())


def test_clean_invoice_and_missing_account_give_nothing(build):
    assert found(build({"A": {}, "B": {"bank_account": None}})) == []


def test_bank_mismatch_compares_digits_and_shows_the_notice(build):
    t = build({"A": {"bank_account": "99-1", "bank_change_notice": "changed"}})
    (row,) = run_rules(t, AS_OF).collect()
    assert row.rule_code == "BANK_MISMATCH" and row.detail.endswith('. Invoice includes a "bank details changed" notice.')
    assert row.detail.startswith("Invoice asks for payment to First acct 99-1; vendor master has First acct 004512")


def test_digitless_tax_ids_match_nothing(build):
    t = build({"A": {"vendor_tax_id": "n/a", "vendor_name": "Nobody"}}, vendors=[("V9", "X", "a", "--", "First", "0", "004512", "Net 30", "active")],
              pos=[("PO-1", "V9", None, "b", "open")])
    assert found(t) == [("A", "UNKNOWN_VENDOR")]


def test_shared_names_fan_out_and_are_reported(build):
    v = [("V1", "Acme", "a", "1", "First", "0", "004512", "Net 30", "active"), ("V2", " ACME ", "a", "2", "First", "0", "004512", "Net 30", "active")]
    t = build({"A": {"vendor_tax_id": None}}, vendors=v)
    iv = rules.resolve_vendor(eav.invoice_header(t["extractions"]), t["vendors"])
    assert sorted(r.vendor_id for r in iv.collect()) == ["V1", "V2"]
    assert [(r.key, r.value) for r in rules.ambiguous_vendor_keys(t["vendors"]).collect()] == [("name", "acme")]


def test_unknown_vendor_gets_no_po_check(build):
    assert found(build({"A": {"vendor_name": "Zed", "vendor_tax_id": None, "po_number": None}})) == [("A", "UNKNOWN_VENDOR")]


def test_missing_and_foreign_orders(build):
    t = build({"A": {"po_number": None}, "B": {"po_number": " po-1 "}, "C": {"po_number": "PO-2"}},
              pos=[("PO-1", "V1", None, "b", "open"), ("PO-2", "V7", None, "b", "open")])
    assert {r.doc_id: r.detail for r in run_rules(t, AS_OF).collect()} == {
        "A": "Invoice does not reference a purchase order", "C": "PO PO-2 does not exist for this vendor"}


def test_duplicate_ignores_case_and_spaces(build):
    paid = [("P1", "V1", " inv-1", None, None, dt.date(2026, 8, 1), "ACH")]
    t = build({"A": {}}, payments=paid)
    t["payments"] = t["payments"].withColumn("amount", F.lit("100.00").cast("decimal(12,2)"))
    (row,) = run_rules(t, AS_OF).collect()
    assert row.detail == "Invoice INV-1 was already paid: P1 on 2026-08-01 for 100.00"


LINE = [("A", 1, "sku", "S1"), ("A", 1, "quantity", "5"), ("A", 1, "unit_price", "12.50")]


def test_each_receipt_is_compared_alone_unless_summed(build):
    receipts = [("R1", "PO-1", 1, "S1", 2, None), ("R2", "PO-1", 1, "S1", 3, None)]
    t = build({"A": {}}, lines=LINE, receipts=receipts)
    assert found(t) == [("A", "QTY_OVER_RECEIPT")] * 2
    billed = rules.billed_lines(rules.resolve_vendor(eav.invoice_header(t["extractions"]), t["vendors"]), eav.invoice_lines(t["extractions"]))
    assert rules.qty_over_receipt(billed, t["goods_receipts"], sum_receipts=True).count() == 0


def test_missing_sku_is_not_matched(build):
    receipts = [("R1", "PO-1", 1, None, 0, None)]
    assert found(build({"A": {}}, lines=[("A", 1, "description", "thing"), ("A", 1, "quantity", "5")], receipts=receipts)) == []


def test_low_confidence_is_strict_and_ignores_unlocated_fields(build):
    t = build({"A": {"_confidence": {"total": 0.85, "bank_account": 0.0, "po_number": None, "vendor_name": 0.1}}})
    rows = run_rules(t, AS_OF).collect()
    assert [(r.evidence_field, r.amount_at_risk) for r in rows] == [("bank_account", None)]
    assert rows[0].detail == 'bank_account read as "0045 12" with confidence 0.00'
    iv = rules.resolve_vendor(eav.invoice_header(t["extractions"]), t["vendors"])
    assert rules.low_confidence(t["extractions"], iv, unlocated_is_low=True).count() == 2


def test_discount_window_skips_flagged_and_takes_future_dates(build):
    offer = {"payment_terms": "2/10 Net 30"}
    t = build({"A": {**offer, "invoice_date": "2026-09-28"}, "B": {**offer, "invoice_date": "2026-09-27"}, "C": {**offer, "invoice_date": "2027-01-01"},
               "D": {**offer, "invoice_date": "2026-10-01", "po_number": None}})
    assert found(t) == [("A", "DISCOUNT_WINDOW"), ("C", "DISCOUNT_WINDOW"), ("D", "NO_PO")]


def test_malformed_values_become_null_and_are_reported(build):
    t = build({"A": {"total": "twelve", "invoice_date": "someday"}})
    (h,) = eav.invoice_header(t["extractions"]).collect()
    assert h.total is None and h.invoice_date is None
    assert sorted(r.field_name for r in eav.rejects(t["extractions"]).collect()) == ["invoice_date", "total"]


def test_lines_meet_records_once_whatever_vendors_match(spark):
    iv = spark.createDataFrame([("d", v, "n", "po-1") for v in ("V1", "V2", "V2")] + [("e", None, "m", None)],
                               "doc_id string, vendor_id string, invoice_number string, po_number string")
    lines = spark.createDataFrame([("d", 1, "a", "A", 3, 2), ("e", 1, "a", "A", 3, 2)],
                                  "doc_id string, line_no int, sku string, description string, quantity int, unit_price int")
    agreed = spark.createDataFrame([("PO-1", "a", 1)], "po_number string, sku string, unit_price int")
    received = spark.createDataFrame([("PO-1", "a", 2, "GR")], "po_number string, sku string, qty_received int, receipt_id string")
    over = rules.line_overages(iv, lines, agreed, received)
    assert sorted((r.rule_code, r.vendor_id) for r in over.collect()) == [
        (rule, v) for rule in ("PRICE_OVER_PO", "QTY_OVER_RECEIPT") for v in ("V1", "V2", "V2")]
