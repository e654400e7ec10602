"""What the invoice says against what the record says, for every exception of the queue."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.text import code_key, label_text, same_text
from ledgerlens.model import HEADER_FIELDS, PAYMENT_DAYS
from ledgerlens.operators.eav import header_text, line_text
from ledgerlens.operators.numbering import numbered
from ledgerlens.session import stage

CHUNK = 100  # order numbers in one text of a candidate list


def candidate_orders(exceptions: DataFrame, purchase_orders: DataFrame) -> DataFrame:
    """All orders of the vendors that have a NO_PO exception, one row per order."""
    vendors = exceptions.filter("rule_code = 'NO_PO'").select("vendor_id").distinct()
    return purchase_orders.join(vendors, "vendor_id", "left_semi").select("vendor_id", "po_number")


def candidate_pos(exceptions: DataFrame, purchase_orders: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per vendor with a NO_PO exception its sorted order numbers as text, or "(none)".

    (vendor_id, chunk, n_orders, candidates): a text holds ``chunk`` orders, so a vendor of any size is listed in full
    and no task collects more than that.
    """
    vendors = exceptions.filter("rule_code = 'NO_PO'").select("vendor_id").distinct()
    placed = numbered(candidate_orders(exceptions, purchase_orders), "vendor_id", ["po_number"], "place")
    lists = placed.groupBy("vendor_id", F.floor((F.col("place") - 1) / chunk).cast("int").alias("chunk")).agg(
        F.count("*").alias("n_orders"), F.array_join(F.sort_array(F.collect_list("po_number")), ", ").alias("listed"))
    return vendors.join(lists, "vendor_id", "left").select(
        "vendor_id", F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce("n_orders", F.lit(0).cast("bigint")).alias("n_orders"),
        F.coalesce("listed", F.lit("(none)")).alias("candidates"))


def _row(what: Column | str, invoice: Column, record: Column, source: str, ok: bool | None = None) -> Column:
    return F.struct(
        (F.lit(what) if isinstance(what, str) else what).alias("what"), invoice.cast("string").alias("invoice"),
        record.cast("string").alias("record"), F.lit(source).alias("source"), F.lit(ok).cast("boolean").alias("decided"))


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def _rows(df: DataFrame, items: Column, first: Column | None = None) -> DataFrame:
    """The rows of each exception; whether the two sides agree is decided once they are rows."""
    kept = ["doc_id", "rule_code", "evidence_field", "detail"]
    listed = df.select(*kept, (F.lit(0) if first is None else first).alias("first"), F.posexplode(items).alias("pos", "r"))
    return listed.select(
        *kept, (F.col("pos") + F.col("first")).alias("pos"), "r.what", "r.invoice", "r.record", "r.source",
        F.coalesce("r.decided", same_text(F.col("r.invoice"), F.col("r.record"))).alias("ok"))


def _key(kind: str, *parts: Column) -> Column:
    """The key under which a record of some kind is looked up; NULL if a part is."""
    return F.concat(F.lit(kind), *[x for p in parts for x in (F.lit("\u0001"), p)])


def _records(t: dict[str, DataFrame]) -> DataFrame:
    """(key, rank, r0, r1, r2): what is on file under the key of a vendor, payment, order line or receipt, as text.

    Of several records of a key the first by ``rank`` counts.
    """
    def of(table: str, key: Column, rank: list[Column], *values: Column) -> DataFrame:
        texts = [v.cast("string").alias(f"r{i}") for i, v in enumerate((*values, *[F.lit(None)] * (4 - len(values))))]
        order = [F.lit(None).cast(kind).alias(f"o{i}") if i >= len(rank) or rank[i] is None else rank[i].cast(kind).alias(f"o{i}")
                 for i, kind in enumerate(("int", "string", "string"))]
        return t[table].select(key.alias("key"), F.struct(*order).alias("rank"), *texts)

    c = F.col
    return reduce(DataFrame.unionByName, [
        of("vendors", _key("vendor", c("vendor_id")), [None, c("bank_account"), c("routing_number")], c("bank_name"), c("routing_number"), c("bank_account")),
        of("payments", _key("payment", c("vendor_id"), code_key(c("invoice_number"))), [None, c("payment_id"), c("invoice_number")],
           c("invoice_number"), c("amount"), c("invoice_date"), F.concat("payment_id", F.lit(" on "), _text("paid_date"))),
        of("po_lines", _key("order", c("po_number"), c("sku")), [c("line_no")], c("description"), c("unit_price"), c("qty")),
        of("goods_receipts", _key("receipt", c("po_number"), c("sku")), [c("line_no"), c("receipt_id")], c("receipt_id"), c("qty_received"), c("received_date")),
    ])


def comparison(exceptions: DataFrame, t: dict[str, DataFrame], as_of: dt.date) -> DataFrame:
    """Rows (what, invoice, record, source, ok) in display order for each exception.

    Set-based: the queue gets its invoices' text and the key of the record it is held against, once; all records lie
    in one table by key, cut to the queue's keys before they are reduced to the first of each, and one join brings both
    together. Field rows are cut to the queue's documents and lines before they are pivoted.
    """
    own = exceptions.withColumn("line_no", F.regexp_extract("evidence_field", r"^line:(\d+):", 1).try_cast("int")).drop("invoice_number")
    on_line = F.col("rule_code").isin("PRICE_OVER_PO", "QTY_OVER_RECEIPT")
    low, own = own.filter("rule_code = 'LOW_CONFIDENCE'"), own.filter("rule_code <> 'LOW_CONFIDENCE'")
    header = header_text(t["extractions"].join(own.select("doc_id").distinct(), "doc_id", "left_semi"), HEADER_FIELDS)
    lines = line_text(t["extractions"].join(own.filter(on_line).select("doc_id", "line_no").distinct(), ["doc_id", "line_no"], "left_semi"))
    order = code_key(F.col("po_number"))
    rule = F.col("rule_code")
    key = (
        F.when(rule == "BANK_MISMATCH", _key("vendor", F.col("vendor_id")))
        .when(rule == "DUPLICATE", _key("payment", F.col("vendor_id"), code_key(F.col("invoice_number"))))
        .when(rule == "PRICE_OVER_PO", _key("order", order, F.col("sku")))
        .when(rule == "QTY_OVER_RECEIPT", _key("receipt", order, F.col("sku"))))
    whole = own.filter(~on_line).join(header, "doc_id", "left").unionByName(
        own.filter(on_line).join(header, "doc_id", "left").join(lines, ["doc_id", "line_no"], "left"), allowMissingColumns=True)
    e = stage(whole.withColumn("key", key), "queue_texts")

    wanted = e.select("key").where("key IS NOT NULL").distinct()
    first = F.min_by(F.struct("r0", "r1", "r2", "r3"), "rank").alias("r")
    records = _records(t).join(wanted, "key", "left_semi").groupBy("key").agg(first).select("key", "r.*")
    none = F.array().cast("array<struct<what:string,invoice:string,record:string,source:string,decided:boolean>>")
    notice = F.col("bank_change_notice")
    item = F.concat("sku", F.lit(" "), F.coalesce("description", F.lit("")))
    held = e.filter("key IS NOT NULL").join(records, "key", "left").unionByName(
        e.filter(rule.isin("BANK_MISMATCH", "DUPLICATE", "PRICE_OVER_PO", "QTY_OVER_RECEIPT") & F.col("key").isNull()), allowMissingColumns=True)
    on_file = _rows(held, F.when(rule == "BANK_MISMATCH", F.concat(
        F.array(_row("Bank", F.col("bank_name"), F.col("r0"), "vendors"),
                _row("Routing (ABA)", F.col("routing_number"), F.col("r1"), "vendors"),
                _row("Account", F.col("bank_account"), F.col("r2"), "vendors")),
        F.when(notice != "", F.array(_row("Change notice on invoice", notice, F.lit("(none on file)"), "vendors", False))).otherwise(none)))
        .when(rule == "DUPLICATE", F.array(
            _row("Invoice number", F.col("invoice_number"), F.col("r0"), "payments"),
            _row("Amount", F.col("total"), F.col("r1"), "payments"),
            _row("Invoice date", F.col("invoice_date"), F.col("r2"), "payments"),
            _row("Paid", F.lit("(this invoice)"), F.col("r3"), "payments", False)))
        .when(rule == "PRICE_OVER_PO", F.array(
            _row("Item", item, F.concat("sku", F.lit(" "), "r0"), "po_lines"),
            _row("Unit price", F.col("unit_price"), F.col("r1"), "po_lines", False),
            _row("Quantity", F.col("quantity"), F.col("r2"), "po_lines")))
        .otherwise(F.array(
            _row("Item", item, F.concat("sku", F.lit(" (receipt "), "r0", F.lit(")")), "goods_receipts", True),
            _row("Quantity", F.col("quantity"), F.col("r1"), "goods_receipts", False),
            _row("Received on", F.lit(""), F.col("r2"), "goods_receipts", True))))

    lists = candidate_pos(exceptions, t["purchase_orders"]).select("vendor_id", "chunk", "candidates")
    no_po = _rows(e.filter(rule == "NO_PO").join(lists, "vendor_id", "left"), F.array(
        _row("PO number", F.coalesce(F.nullif("po_number", F.lit("")), F.lit("(none)")), F.col("candidates"), "purchase_orders", False),
    ), F.col("chunk"))

    read = t["extractions"].filter("line_no IS NULL").select("doc_id", F.col("field_name").alias("evidence_field"), "field_value", "confidence")
    read = read.join(low.select("doc_id", "evidence_field").distinct(), ["doc_id", "evidence_field"], "left_semi")
    shown = F.coalesce("confidence", F.lit(0.0)).cast("decimal(4,2)").cast("string")
    uncertain = _rows(low.join(read, ["doc_id", "evidence_field"], "left"), F.array(
        _row(label_text(F.col("evidence_field")), F.col("field_value"), F.concat(F.lit("confidence "), shown), "extractions", False)))

    pay_by = F.date_add(F.col("invoice_date").try_cast("date"), PAYMENT_DAYS).cast("string")
    alone = _rows(e.filter(rule.isin("DISCOUNT_WINDOW", "UNKNOWN_VENDOR")), F.when(rule == "DISCOUNT_WINDOW", F.array(
        _row("Terms", F.col("payment_terms"), F.lit("2% if paid within 10 days"), "vendors", True),
        _row("Invoice date", F.col("invoice_date"), F.concat(F.lit("pay by "), pay_by, F.lit(f" (today {as_of.isoformat()})")), "", True),
        _row("Savings", F.col("total"), F.format_number("amount_at_risk", 2), "", True))).otherwise(F.array(
            _row("Vendor", F.col("vendor_name"), F.lit("(no match)"), "vendors", False),
            _row("Tax ID", F.col("vendor_tax_id"), F.lit("(no match)"), "vendors", False))))
    return reduce(DataFrame.unionByName, [on_file, no_po, uncertain, alone])
