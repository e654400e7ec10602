"""The accounts-payable tables as deterministic views over the TPC-H-like tables ``supplier``, ``orders``, ``lineitem``.

One invoice per order that has lines. Issues are planted by arithmetic on the order key, so the expected results can be
stated in SQL over the same base tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.numbering import numbered
from ledgerlens.session import stage

AS_OF = dt.date(2001, 7, 25)
MODEL = "reader-1"
READ_AT = "2001-07-25 06:00:00"
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]

_cache: dict[tuple[str, str], Tables] = {}


def _text(c: Column) -> Column:
    return c.cast("string")


def _vendors(supplier: DataFrame) -> DataFrame:
    s = F.col("s_suppkey")
    return supplier.select(
        F.concat(F.lit("V"), _text(s)).alias("vendor_id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("Nation "), _text(F.col("s_nationkey"))).alias("address"),
        F.concat(_text(10 + s % 90), F.lit("-"), _text(1000000 + (s * 7919) % 9000000)).alias("tax_id"),
        F.concat(F.lit("Bank "), _text(s % 6)).alias("bank_name"),
        F.concat(F.lit("0"), _text(10000000 + (s * 31337) % 90000000)).alias("routing_number"),
        _text(F.lit(10000000000) + s * 104729).alias("bank_account"),
        F.when(s % 4 == 3, "2/10 Net 30").otherwise("Net 30").alias("payment_terms"),
        F.lit("active").alias("status"),
    )


def _billed(orders: DataFrame, lineitem: DataFrame, n_vendors: Column) -> DataFrame:
    lines = numbered(lineitem.select("l_orderkey", *LINE_ORDER), "l_orderkey", LINE_ORDER)
    heads = orders.select(
        F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % n_vendors).alias("vendor"),
        F.to_date("o_orderdate").alias("order_date"),
    )
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(12,2)")
    return heads.join(lines, "l_orderkey").select(
        F.col("l_orderkey").alias("k"), "vendor", "order_date", "line_no", F.col("l_partkey").alias("part"),
        F.col("l_quantity").cast("int").alias("qty"), price.alias("unit_price"), F.to_date("l_shipdate").alias("ship_date"),
    )


def _sku() -> Column:
    return F.concat(F.lit("SKU-"), _text(F.col("part"))).alias("sku")


def _description() -> Column:
    return F.concat(F.lit("Part "), _text(F.col("part"))).alias("description")


def _doc_id() -> Column:
    return F.concat(F.lit("B"), _text(F.col("k"))).alias("doc_id")


def _invoice_lines(billed: DataFrame, doc_id: Column | None = None) -> DataFrame:
    over = (F.col("k") + F.col("line_no")) % 43 == 6
    price = F.when(over, F.col("unit_price") + F.lit("1.25").cast("decimal(12,2)")).otherwise(F.col("unit_price"))
    return billed.select(
        _doc_id() if doc_id is None else doc_id, "k", "vendor", "order_date", "line_no", _sku(), _description(), "qty", price.cast("decimal(12,2)").alias("unit_price"),
        (price * F.col("qty")).cast("decimal(12,2)").alias("amount"),
    )


def _heads(inv_lines: DataFrame, vendors: DataFrame) -> DataFrame:
    """A row for each invoice, with its vendor's master data."""
    heads = inv_lines.groupBy("k", "vendor", "order_date").agg(
        F.sum("amount").cast("decimal(12,2)").alias("total"), F.count("*").cast("int").alias("n_lines")
    ).withColumn("vendor_id", F.concat(F.lit("V"), _text(F.col("vendor")))).drop("vendor")
    return heads.join(vendors.drop("status"), "vendor_id")


def _truth(heads: DataFrame, doc_id: Column | None = None) -> DataFrame:
    k = F.col("k")
    unlisted, by_name = k % 31 == 3, k % 7 == 0
    return heads.select(
        _doc_id() if doc_id is None else doc_id, "k", "vendor_id", "n_lines",
        F.when(unlisted, F.concat(F.lit("Unlisted "), _text(k)))
        .when(by_name, F.concat(F.lit("  "), F.upper("name"), F.lit(" "))).otherwise(F.col("name")).alias("vendor_name"),
        F.col("address").alias("vendor_address"),
        F.when(~unlisted & ~by_name, F.replace(F.col("tax_id"), F.lit("-"), F.lit(" "))).alias("vendor_tax_id"),
        F.concat(F.lit("INV-"), _text(k)).alias("invoice_number"),
        F.col("order_date").alias("invoice_date"),
        F.date_add("order_date", 30).alias("due_date"),
        F.when(k % 37 == 4, None).when(k % 41 == 4, F.concat(F.lit("PO-X"), _text(k)))
        .otherwise(F.concat(F.lit("po-"), _text(k))).alias("po_number"),
        "payment_terms", F.lit("USD").alias("currency"), "bank_name", "routing_number",
        F.when(k % 97 == 5, None).when(k % 23 == 1, F.concat(F.lit("9"), F.col("bank_account")))
        .otherwise(F.col("bank_account")).alias("bank_account"),
        F.when(k % 46 == 1, "Our bank details have changed.").alias("bank_change_notice"),
        F.col("total").alias("subtotal"), F.lit("0.00").cast("decimal(12,2)").alias("tax"), "total",
    )


# Header fields in the order of their confidence index; the last ones are never uncertain.
SCORED_FIELDS = ["vendor_name", "vendor_tax_id", "invoice_number", "invoice_date", "po_number", "payment_terms",
                 "bank_name", "bank_account", "bank_change_notice", "total"]
PLAIN_FIELDS = ["due_date", "vendor_address", "currency", "routing_number", "subtotal", "tax"]


def _confidence(value: Column, k: Column, i: Column) -> Column:
    return F.when(value.isNull() | ((k * 13 + i * 7) % 211 == 0), None).when((k * 31 + i * 17) % 199 < 3, 0.41).otherwise(0.97)


def _extractions(heads: DataFrame, billed: DataFrame, parts: int) -> DataFrame:
    """Field rows from one ``inline`` per side, so neither side is scanned more than once.

    The narrow rows are dealt by document, so the wide field rows made of them lie by document without having moved, in
    ``parts`` tasks of bounded size. Confidence and place are derived from the row's field afterwards, so a reader that does
    not ask for them does not pay for them.
    """

    def entry(name: str, i: int, column: str, scored: bool = True) -> Column:
        return F.struct(F.lit(name).alias("field_name"), F.lit(i).alias("i"), F.lit(scored).alias("scored"), _text(F.col(column)).alias("field_value"))

    header = [entry(f, i, f) for i, f in enumerate(SCORED_FIELDS)] + [entry(f, -1, f, False) for f in PLAIN_FIELDS]
    line = [entry(f, 16 + i, c) for i, (f, c) in enumerate([("sku", "sku"), ("description", "description"), ("quantity", "qty"),
                                                            ("unit_price", "unit_price"), ("amount", "amount")])]

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("doc_id", _doc_id()).repartition(parts, "doc_id")

    number = F.coalesce("line_no", F.lit(0))  # a line has a number: readers of header fields skip the lines unread
    page = F.floor((F.col("line_no") - 1) / 20) + 1
    heads, billed = dealt(heads), dealt(billed)
    rows = _truth(heads, F.col("doc_id")).select(
        "doc_id", "k", F.lit(None).cast("int").alias("line_no"), F.lit(1).cast("int").alias("on_page"), F.inline(F.array(*header))
    ).unionByName(_invoice_lines(billed, F.col("doc_id")).select(
        "doc_id", "k", number.alias("line_no"), page.cast("int").alias("on_page"), F.inline(F.array(*line))))
    known = F.when(F.col("scored"), _confidence(F.col("field_value"), F.col("k"), F.col("i"))).when(F.col("field_value").isNotNull(), 0.97).cast("double")
    return rows.select(
        "doc_id", "field_name", "line_no", "field_value", known.alias("confidence"), F.when(known.isNotNull(), F.col("on_page")).alias("page"),
        F.when(known.isNotNull(), "[0.1, 0.2, 0.5, 0.25]").alias("bbox"), F.lit(None).cast("string").alias("quote"), F.lit(MODEL).alias("model"),
        F.lit(READ_AT).cast("timestamp").alias("extracted_at"),
    )


def _documents(truth: DataFrame) -> DataFrame:
    k = F.col("k")
    name = F.concat("doc_id", F.lit("_"), "vendor_id", F.lit("_"), "invoice_number", F.lit(".pdf"))
    done = k % 13 != 5
    landed = F.lit("2001-07-24 08:30:00").cast("timestamp")
    return truth.select(
        "doc_id", name.alias("file_name"), F.concat(F.lit("landing/"), name).alias("s3_uri"),
        F.sha2(name, 256).alias("sha256"), (F.col("n_lines").cast("bigint") * 900 + 20000).alias("size_bytes"),
        F.when(k % 19 == 3, "upload").otherwise("batch").alias("source"), landed.alias("ingested_at"),
        F.when(done, "processed").otherwise("pending").alias("status"),
        F.when(done, F.lit(READ_AT).cast("timestamp")).alias("processed_at"),
    )


def _payments(truth: DataFrame) -> DataFrame:
    return truth.filter(F.col("k") % 29 == 2).select(
        F.concat(F.lit("PAY-"), _text(F.col("k"))).alias("payment_id"), "vendor_id",
        F.concat(F.lit(" "), F.lower("invoice_number")).alias("invoice_number"), "invoice_date",
        F.col("total").alias("amount"), F.date_add("invoice_date", 18).alias("paid_date"), F.lit("ACH").alias("payment_method"),
    )


def misread(extractions: DataFrame) -> DataFrame:
    """The extractions with one character changed in every value whose key hits the misread rule."""
    k = F.expr("substring(doc_id, 2)").cast("bigint")
    i = F.length("field_name") + F.coalesce("line_no", F.lit(0))
    return extractions.withColumn(
        "field_value",
        F.when((k * 19 + i) % 251 == 0, F.concat(F.lit("8"), F.expr("substring(field_value, 2)"))).otherwise(F.col("field_value")),
    )


LINES_OF_A_PART = 250_000  # invoice lines whose field rows one task makes


class Tables(Mapping):
    """The stored tables of one input folder, by name. Each is derived when it is first asked for.

    Written to the shared folder is what takes a shuffle to derive: the billed lines and the invoices with their vendors. All
    tables are projections of these two, so they cost no space and readers compute the columns they ask for only.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.source = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        self.cores = spark.sparkContext.defaultParallelism
        self.made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        return self.kept(name, lambda: TABLES[name](self))

    def __iter__(self):
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.made:
            self.made[name] = make()
        return self.made[name]

    def billed(self) -> DataFrame:
        def make() -> DataFrame:
            n_vendors = F.lit(self.source("supplier").count())
            return stage(_billed(self.source("orders"), self.source("lineitem"), n_vendors), "billed", keep=True)

        return self.kept("billed", make)

    def heads(self) -> DataFrame:
        return self.kept("heads", lambda: stage(_heads(self["inv_lines"], self["vendors"]), "heads", keep=True))


def _purchase_orders(t: Tables) -> DataFrame:
    return t["truth"].select(
        _po_number(), "vendor_id", F.date_sub("invoice_date", 21).alias("po_date"), F.concat(F.lit("Buyer "), _text(F.col("k") % 7)).alias("buyer"),
        F.lit("open").alias("status"))


def _po_number() -> Column:
    return F.concat(F.lit("PO-"), _text(F.col("k"))).alias("po_number")


def _goods_receipts(t: Tables) -> DataFrame:
    short = (F.col("k") + F.col("line_no")) % 47 == 7
    return t.billed().select(
        F.concat(F.lit("GR-"), _text(F.col("k")), F.lit("-"), _text(F.col("line_no"))).alias("receipt_id"), _po_number(), "line_no", _sku(),
        F.when(short, F.col("qty") - 1).otherwise(F.col("qty")).alias("qty_received"), F.col("ship_date").alias("received_date"))


def _field_rows(t: Tables) -> DataFrame:
    return _extractions(t.heads(), t.billed(), max(t.cores, -(-t.billed().count() // LINES_OF_A_PART)))


TABLES: dict[str, Callable[[Tables], DataFrame]] = {
    "vendors": lambda t: _vendors(t.source("supplier")),
    "inv_lines": lambda t: _invoice_lines(t.billed()),
    "truth": lambda t: _truth(t.heads()),
    "purchase_orders": _purchase_orders,
    "po_lines": lambda t: t.billed().select(_po_number(), "line_no", _sku(), _description(), "qty", "unit_price"),
    "goods_receipts": _goods_receipts,
    "payments": lambda t: _payments(t["truth"]),
    "extractions": _field_rows,
    "documents": lambda t: _documents(t["truth"]),
}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The stored tables for one input folder, once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _cache:
        _cache[key] = Tables(spark, sf_dir)
    return _cache[key]
