"""Field rows (entity-attribute-value) to typed invoices and lines, and annotation JSON to field rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import bind, rows_of
from ledgerlens.functions.text import canonical_value, checked_value
from ledgerlens.model import ANNOTATION_DDL, HEADER_FIELDS, LINE_FIELDS, schema
from ledgerlens.operators.evidence import locate_values

HEADER_COLUMNS = ["vendor_name", "vendor_tax_id", "invoice_number", "invoice_date", "due_date", "po_number",
                  "payment_terms", "bank_name", "bank_account", "bank_change_notice", "total"]
HEADER_TYPES = {"invoice_date": "date", "due_date": "date", "total": "decimal(12,2)"}
LINE_TYPES = {"quantity": "decimal(12,2)", "unit_price": "decimal(12,2)", "amount": "decimal(12,2)"}


def _pivot(rows: DataFrame, keys: list[str], fields: list[str], types: dict[str, str]) -> DataFrame:
    """One partial + final aggregation; text that is no date or amount becomes NULL (see ``rejects``)."""

    def value(f: str) -> Column:
        text = F.max(F.when(F.col("field_name") == f, F.col("field_value")))
        return (text.try_cast(types[f]) if f in types else text).alias(f)

    return rows.filter(F.col("field_name").isin(fields)).groupBy(*keys).agg(*[value(f) for f in fields])


def header_text(extractions: DataFrame, fields: list[str] = HEADER_COLUMNS) -> DataFrame:
    """Header fields of each invoice as text."""
    return _pivot(extractions.filter("line_no IS NULL"), ["doc_id"], fields, {})


def invoice_header(extractions: DataFrame) -> DataFrame:
    return _pivot(extractions.filter("line_no IS NULL"), ["doc_id"], HEADER_COLUMNS, HEADER_TYPES)


def invoice_lines(extractions: DataFrame) -> DataFrame:
    return _pivot(extractions.filter("line_no IS NOT NULL"), ["doc_id", "line_no"], LINE_FIELDS, LINE_TYPES)


def line_text(extractions: DataFrame) -> DataFrame:
    return _pivot(extractions.filter("line_no IS NOT NULL"), ["doc_id", "line_no"], LINE_FIELDS, {})


def rejects(extractions: DataFrame) -> DataFrame:
    """Field rows whose text does not convert to the type the rules need."""
    types = {**HEADER_TYPES, **LINE_TYPES}
    bad = F.lit(False)
    for f, t in types.items():
        bad = bad | ((F.col("field_name") == f) & F.col("field_value").isNotNull() & F.col("field_value").try_cast(t).isNull())
    return extractions.filter(F.col("field_name").isin(list(types)) & bad).select("doc_id", "field_name", "line_no", "field_value")


def annotation_groups(annotation: Column) -> Column:
    """Values to look up: the header fields as one group, and each line item as a group under its row key."""

    def field(name: str, line: Column, value: Column) -> Column:
        return F.struct(F.lit(name).alias("field_name"), line.alias("line_no"), value.alias("value"))

    header = F.struct(
        F.lit(None).cast("string").alias("row_key"),
        F.array(*[field(f, F.lit(None).cast("int"), annotation[f]) for f in HEADER_FIELDS]).alias("fields"))
    items = F.transform(
        F.coalesce(annotation["line_items"], F.array()),
        lambda item, n: F.struct(
            F.when(item["sku"] != "", item["sku"]).otherwise(item["description"]).alias("row_key"),
            F.array(*[field(f, (n + 1).cast("int"), item[f]) for f in LINE_FIELDS]).alias("fields")))
    return F.concat(F.array(header), items)


def parsed_annotation(c: Column) -> Column:
    return F.from_json(F.coalesce(c, F.lit("{}")), schema(ANNOTATION_DDL))


def flatten_annotation(responses: DataFrame) -> DataFrame:
    """Field rows of each response, without evidence."""
    groups = bind(parsed_annotation(F.col("document_annotation")), annotation_groups)
    return (
        rows_of(responses, groups, "g", "doc_id")
        .select("doc_id", "g.row_key", F.explode("g.fields").alias("r"))
        .select("doc_id", "r.field_name", "r.line_no", canonical_value(F.col("r.field_name"), F.col("r.value")).alias("field_value"), "row_key")
    )


def extract(responses: DataFrame, extracted_at: Column | None = None) -> DataFrame:
    """Responses to rows of the ``extractions`` table: every field with its page, box and confidence.

    Reads each response once and shuffles nothing, because pages and annotation are in the same row.
    """
    groups = bind(parsed_annotation(F.col("document_annotation")), annotation_groups)
    return locate_values(responses.select("doc_id", "model", "pages", groups.alias("groups")), ["doc_id", "model"]).select(
        "doc_id", "field_name", "line_no", canonical_value(F.col("field_name"), F.col("value")).alias("field_value"), "confidence", "page",
        F.when(F.col("bbox").isNotNull(), F.concat(F.lit("["), F.array_join(F.col("bbox").cast("array<string>"), ", "), F.lit("]"))).alias("bbox"),
        F.lit(None).cast("string").alias("quote"), "model",
        (extracted_at if extracted_at is not None else F.current_timestamp()).alias("extracted_at"),
    )


def check_values(reviews: DataFrame) -> DataFrame:
    """Reviewer values in stored form, or the reason they were refused, as columns ``value`` and ``error``."""
    checked = checked_value(F.col("field_name"), F.col("value"))
    return reviews.withColumn("checked", checked).withColumn("value", F.col("checked.value")).withColumn(
        "error", F.col("checked.error")).drop("checked")


def list_extractions(extractions: DataFrame) -> DataFrame:
    """Fields for display: header fields first, then line by line."""
    return extractions.select("doc_id", "field_name", "line_no", "field_value", "confidence", "page", "model").orderBy(
        "doc_id", F.col("line_no").asc_nulls_first(), "field_name"
    )


def select_documents(documents: DataFrame, status: str | None = None, ids: list[str] | None = None) -> DataFrame:
    """Documents by status or id, ordered; both filters reach the scan."""
    if status is not None:
        documents = documents.filter(F.col("status") == status)
    if ids is not None:
        documents = documents.filter(F.col("doc_id").isin(ids))
    return documents.select("doc_id", "file_name", "s3_uri", "sha256").orderBy("doc_id")
