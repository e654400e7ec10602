"""Vendor resolution and the eight exception rules. Each rule returns the columns of the ``exceptions`` table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import code_key, digits, name_key
from ledgerlens.model import ACTION, KEY_FIELDS, MIN_CONFIDENCE, PAYMENT_DAYS, PRIORITY
from ledgerlens.session import stage

AMOUNT = "decimal(12,2)"


def resolve_vendor(header: DataFrame, vendors: DataFrame) -> DataFrame:
    """Invoices with the vendor matched by tax id digits, else by name; several matches give several rows.

    Invoices without a key (no tax id, one without digits, a blank name) get one of their own that no vendor can have:
    they stay unmatched without all meeting in one task. Vendors without a key match nothing by it. Whether vendors are broadcast is left to their measured size.
    """
    own = F.concat(F.lit("\u0001"), F.col("doc_id"))
    h = header.withColumn("tax_key", F.coalesce(F.nullif(digits(F.col("vendor_tax_id")), F.lit("")), own)).withColumn(
        "name_key", F.coalesce(F.nullif(name_key(F.col("vendor_name")), F.lit("")), own))
    by_tax = vendors.select(digits(F.col("tax_id")).alias("tax_key"), F.col("vendor_id").alias("tax_vendor")).filter("tax_key <> ''")
    by_name = vendors.select(name_key(F.col("name")).alias("name_key"), F.col("vendor_id").alias("name_vendor")).filter("name_key <> ''")
    return (
        h.join(by_tax, "tax_key", "left").join(by_name, "name_key", "left")
        .withColumn("vendor_id", F.coalesce("tax_vendor", "name_vendor"))
        .drop("tax_key", "name_key", "tax_vendor", "name_vendor")
    )


def ambiguous_vendor_keys(vendors: DataFrame) -> DataFrame:
    """Tax ids and names shared by several vendors: they multiply the rows of ``resolve_vendor``."""
    keys = vendors.select(F.inline(F.array(
        F.struct(F.lit("tax_id").alias("key"), digits(F.col("tax_id")).alias("value")),
        F.struct(F.lit("name").alias("key"), name_key(F.col("name")).alias("value")),
    )))
    return keys.filter("value IS NOT NULL").groupBy("key", "value").agg(F.count("*").alias("vendors")).filter("vendors > 1")


def _exception(df: DataFrame, rule: str, detail: Column, amount: Column, evidence: Column) -> DataFrame:
    return df.select(
        "doc_id", F.col("vendor_id"), "invoice_number", F.lit(rule).alias("rule_code"), detail.alias("detail"),
        amount.cast(AMOUNT).alias("amount_at_risk"), F.lit(PRIORITY[rule]).alias("priority"), F.lit(ACTION[rule]).alias("action"),
        evidence.alias("evidence_field"),
    )


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def bank_mismatch(iv: DataFrame, vendors: DataFrame) -> DataFrame:
    on_file = vendors.select("vendor_id", F.col("bank_name").alias("file_bank"), F.col("bank_account").alias("file_account"))
    hit = iv.filter("vendor_id IS NOT NULL AND bank_account IS NOT NULL").join(on_file, "vendor_id").filter(
        digits(F.col("bank_account")) != digits(F.col("file_account")))
    notice = F.when(F.col("bank_change_notice").isNotNull(), '. Invoice includes a "bank details changed" notice.').otherwise("")
    detail = F.concat(
        F.lit("Invoice asks for payment to "), F.coalesce("bank_name", F.lit("?")), F.lit(" acct "), "bank_account",
        F.lit("; vendor master has "), "file_bank", F.lit(" acct "), "file_account", notice)
    return _exception(hit, "BANK_MISMATCH", detail, F.col("total"), F.lit("bank_account"))


def duplicate(iv: DataFrame, payments: DataFrame) -> DataFrame:
    paid = payments.select(
        "vendor_id", code_key(F.col("invoice_number")).alias("number_key"), "payment_id", "paid_date", F.col("amount").alias("paid"))
    hit = iv.filter("vendor_id IS NOT NULL AND invoice_number IS NOT NULL").withColumn(
        "number_key", code_key(F.col("invoice_number"))).join(paid, ["vendor_id", "number_key"])
    detail = F.concat(
        F.lit("Invoice "), "invoice_number", F.lit(" was already paid: "), "payment_id", F.lit(" on "), _text("paid_date"),
        F.lit(" for "), _text("paid"))
    return _exception(hit, "DUPLICATE", detail, F.col("total"), F.lit("invoice_number"))


def unknown_vendor(iv: DataFrame) -> DataFrame:
    detail = F.concat(
        F.lit('No vendor master record for "'), F.coalesce("vendor_name", F.lit("?")), F.lit('" (tax ID '),
        F.coalesce("vendor_tax_id", F.lit("?")), F.lit(")"))
    return _exception(iv.filter("vendor_id IS NULL"), "UNKNOWN_VENDOR", detail, F.col("total"), F.lit("vendor_name"))


def no_po(iv: DataFrame, purchase_orders: DataFrame) -> DataFrame:
    """Invoices of known vendors without a matching order. Those that name no order need no join."""
    known = iv.filter("vendor_id IS NOT NULL")
    unnamed = known.filter("po_number IS NULL")
    on_file = purchase_orders.select(F.col("po_number").alias("po_key"), "vendor_id")
    unmatched = known.filter("po_number IS NOT NULL").withColumn("po_key", code_key(F.col("po_number"))).join(
        on_file, ["po_key", "vendor_id"], "left_anti").drop("po_key")
    detail = F.when(F.col("po_number").isNull(), "Invoice does not reference a purchase order").otherwise(
        F.concat(F.lit("PO "), "po_number", F.lit(" does not exist for this vendor")))
    return _exception(unnamed.unionByName(unmatched), "NO_PO", detail, F.col("total"), F.lit("po_number"))


def billed_lines(iv: DataFrame, lines: DataFrame) -> DataFrame:
    """Invoice lines that name an order and a sku, with the invoice's vendor and number: input of the two line rules."""
    heads = iv.filter("po_number IS NOT NULL").select(
        "doc_id", "vendor_id", "invoice_number", code_key(F.col("po_number")).alias("po_key"))
    return heads.join(lines.filter("sku IS NOT NULL"), "doc_id")


def price_over_po(billed: DataFrame, po_lines: DataFrame) -> DataFrame:
    agreed = po_lines.select(F.col("po_number").alias("po_key"), "sku", F.col("unit_price").alias("agreed"))
    return _priced_over(billed.join(agreed, ["po_key", "sku"]))


def _priced_over(joined: DataFrame) -> DataFrame:
    hit = joined.filter("unit_price > agreed")
    detail = F.concat(
        F.coalesce("sku", "description"), F.lit(": billed "), _text("unit_price"), F.lit(" vs PO "), _text("agreed"), F.lit(" x "),
        _text(F.col("quantity").cast("int")))
    evidence = F.concat(F.lit("line:"), _text("line_no"), F.lit(":unit_price"))
    return _exception(hit, "PRICE_OVER_PO", detail, (F.col("unit_price") - F.col("agreed")) * F.col("quantity"), evidence)


def qty_over_receipt(billed: DataFrame, goods_receipts: DataFrame, sum_receipts: bool = False) -> DataFrame:
    """Billed quantity above what was received; every receipt is compared alone unless ``sum_receipts``."""
    received = goods_receipts.select(F.col("po_number").alias("po_key"), "sku", "qty_received", "receipt_id")
    if sum_receipts:
        received = received.groupBy("po_key", "sku").agg(
            F.sum("qty_received").alias("qty_received"), F.min("receipt_id").alias("receipt_id"))
    return _billed_over(billed.join(received, ["po_key", "sku"]))


def _billed_over(joined: DataFrame) -> DataFrame:
    hit = joined.filter("quantity > qty_received")
    detail = F.concat(
        F.coalesce("sku", "description"), F.lit(": billed "), _text(F.col("quantity").cast("int")), F.lit(", received "),
        _text("qty_received"), F.lit(" ("), "receipt_id", F.lit(")"))
    evidence = F.concat(F.lit("line:"), _text("line_no"), F.lit(":quantity"))
    return _exception(hit, "QTY_OVER_RECEIPT", detail, (F.col("quantity") - F.col("qty_received")) * F.col("unit_price"), evidence)


def line_overages(iv: DataFrame, lines: DataFrame, po_lines: DataFrame, goods_receipts: DataFrame) -> DataFrame:
    """``price_over_po`` and ``qty_over_receipt`` by one join with the records of both kinds, so the lines move once.

    The join does not depend on the vendor, so an invoice takes part once, however many vendors it matches; only the lines
    found meet its vendors. They are written: they are few, and both rules describe them.
    """
    once = iv.select("doc_id", "invoice_number", "po_number").distinct().withColumn("vendor_id", F.lit(None).cast("string"))
    billed = billed_lines(once, lines).drop("vendor_id")
    agreed = po_lines.select(F.col("po_number").alias("po_key"), "sku", F.col("unit_price").alias("agreed"))
    received = goods_receipts.select(F.col("po_number").alias("po_key"), "sku", "qty_received", "receipt_id")
    over = billed.join(agreed.unionByName(received, allowMissingColumns=True), ["po_key", "sku"]).filter(
        "unit_price > agreed OR quantity > qty_received")
    over = stage(over.join(iv.select("doc_id", "vendor_id"), "doc_id"), "lines_over")
    return _priced_over(over).unionByName(_billed_over(over))


def low_confidence(extractions: DataFrame, iv: DataFrame, threshold: float = MIN_CONFIDENCE, unlocated_is_low: bool = False) -> DataFrame:
    """Key header fields read below the threshold; a field that was not found on the page counts only on request."""
    low = F.col("confidence") < threshold
    if unlocated_is_low:
        low = low | (F.col("confidence").isNull() & F.col("field_value").isNotNull())
    fields = extractions.filter(F.col("line_no").isNull() & F.col("field_name").isin(KEY_FIELDS) & low).select(
        "doc_id", "field_name", "field_value", "confidence")
    hit = fields.join(iv.select("doc_id", "vendor_id", "invoice_number"), "doc_id")
    shown = F.coalesce(_text(F.col("confidence").cast("decimal(4,2)")), F.lit("unknown")) if unlocated_is_low else _text(F.col("confidence").cast("decimal(4,2)"))
    detail = F.concat("field_name", F.lit(' read as "'), "field_value", F.lit('" with confidence '), shown)
    return _exception(hit, "LOW_CONFIDENCE", detail, F.lit(None), F.col("field_name"))


def discount_window(iv: DataFrame, flagged: DataFrame, as_of: dt.date) -> DataFrame:
    """Invoices that no other rule flagged and whose early-payment discount can still be taken."""
    open_offer = iv.filter(F.col("payment_terms").startswith("2/10") & (F.col("invoice_date") >= F.date_sub(F.lit(as_of), PAYMENT_DAYS)))
    clean = open_offer.join(flagged.select("doc_id"), "doc_id", "left_anti")
    detail = F.concat(
        F.lit("Terms "), "payment_terms", F.lit(": pay by "), _text(F.date_add("invoice_date", PAYMENT_DAYS)), F.lit(" to save 2%"))
    return _exception(clean, "DISCOUNT_WINDOW", detail, F.col("total") * F.lit("0.02").cast("decimal(3,2)"), F.lit("payment_terms"))
