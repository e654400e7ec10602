"""The ranked action queue and what is shown next to each entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.model import PRIORITY_NAMES, RULES


def queue_order() -> list[Column]:
    """Priority, then amount; the rest makes the order total."""
    return [F.col("priority").asc(), F.col("amount_at_risk").desc_nulls_last(), F.col("doc_id").asc(), F.col("rule_code").asc(),
            F.col("evidence_field").asc(), F.col("detail").asc_nulls_first()]


def queue(exceptions: DataFrame, vendors: DataFrame, documents: DataFrame) -> DataFrame:
    """Exceptions with vendor name, source and file. Rows without a vendor get a key of their own, so they spread."""
    v = vendors.select(F.col("vendor_id").alias("vendor_key"), F.col("name").alias("vendor_name"))
    key = F.coalesce("vendor_id", F.concat(F.lit("\u0001"), "doc_id"))
    return (
        exceptions.withColumn("vendor_key", key).join(v, "vendor_key", "left").drop("vendor_key")
        .join(documents.select("doc_id", "source", "file_name"), "doc_id", "left")
    )


def ranked_queue(exceptions: DataFrame, vendors: DataFrame, documents: DataFrame) -> DataFrame:
    return queue(exceptions, vendors, documents).orderBy(*queue_order())


def document_list(documents: DataFrame, header: DataFrame) -> DataFrame:
    head = header.select("doc_id", "vendor_name", "invoice_number", "total")
    return documents.join(head, "doc_id", "left").select(
        "doc_id", "file_name", "s3_uri", "sha256", "source", "status", F.col("ingested_at").cast("string").alias("ingested_at"),
        F.col("processed_at").cast("string").alias("processed_at"), "vendor_name", "invoice_number", "total").orderBy("doc_id")


def _rule_map(position: int) -> Column:
    return F.create_map(*[F.lit(x) for r in RULES for x in (r[0], r[position])])


def with_rule_labels(exceptions: DataFrame) -> DataFrame:
    """Exceptions with the label, comparison, tone and priority name of their rule (an eight-entry constant map)."""
    names = F.create_map(*[F.lit(x) for item in PRIORITY_NAMES.items() for x in item])
    code = F.col("rule_code")
    return exceptions.withColumns({
        "label": _rule_map(1)[code], "how": _rule_map(2)[code], "tone": _rule_map(3)[code], "priority_name": names[F.col("priority")]})


def other_issues(exceptions: DataFrame) -> DataFrame:
    """For each exception the other issues of its document, by rule with their number.

    Issues are counted per document and rule first, so a document with very many exceptions meets at most eight rows
    instead of all its other exceptions.
    """
    per_rule = exceptions.groupBy("doc_id", "rule_code").agg(F.count("*").alias("n"))
    per_doc = per_rule.groupBy("doc_id").agg(F.collect_list(F.struct("rule_code", "n")).alias("by_rule"))
    label = _rule_map(1)
    own = exceptions.select("doc_id", "rule_code", "evidence_field", "detail")
    return (
        own.join(per_doc, "doc_id").select(own["doc_id"], own["rule_code"], "evidence_field", "detail", F.explode("by_rule").alias("o"))
        .withColumn("n_others", F.col("o.n") - (F.col("o.rule_code") == F.col("rule_code")).cast("bigint"))
        .filter("n_others > 0")
        .select("doc_id", "rule_code", "evidence_field", "detail", F.col("o.rule_code").alias("other_rule"),
                label[F.col("o.rule_code")].alias("other_label"), "n_others"))


def clean_invoices(documents: DataFrame, exceptions: DataFrame, header: DataFrame) -> DataFrame:
    """Processed documents without any exception: ready to pay on their due date."""
    return (
        documents.filter("status = 'processed'").select("doc_id").join(exceptions.select("doc_id"), "doc_id", "left_anti")
        .join(header.select("doc_id", "invoice_number", "due_date", "total"), "doc_id", "left"))


def first_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, as a partial + final aggregation (no window over the key)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")
