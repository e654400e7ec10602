"""Column expressions over field values: canonical text, validation, printed variants, comparison forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.model import DATE_FIELDS, MAX_UPLOAD_BYTES, MONEY_FIELDS

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
SAFE_NAME_LENGTH = 100
#: The word "invoice", perhaps a mark for "number" and a colon, then an identifier of three or more characters.
LABELLED_NUMBER = r"(?i)invoice\s*(?:(?:number|no[.]?|#)\s*)?(?:[:]\s*)?([a-z0-9](?:-|[a-z0-9]){2,})"


# The characters that count as whitespace at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Without leading and trailing whitespace of any kind (SQL ``trim`` without characters removes spaces only).

    Trimming tests each character of the text against the list, so text that neither begins nor ends with one is left out.
    """
    at_end = F.lit(WHITESPACE).contains(F.left(c, F.lit(1))) | F.lit(WHITESPACE).contains(F.right(c, F.lit(1)))
    return F.when(at_end, F.btrim(c, F.lit(WHITESPACE))).otherwise(c)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def name_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def code_key(c: Column) -> Column:
    return F.upper(F.trim(c))


def money(c: Column) -> Column:
    return c.try_cast("decimal(12,2)")


def iso_date(c: Column) -> Column:
    """A date when the text is exactly YYYY-MM-DD and such a day exists, else NULL."""
    return F.when(c.rlike(ISO_DATE), c.try_cast("date"))


def plain_number(c: Column) -> Column:
    """Text of a quantity: whole numbers without decimals, others without trailing zeros."""
    d = c.try_cast("decimal(24,6)")
    whole = d.cast("bigint")
    return F.when(d == whole, whole.cast("string")).otherwise(F.regexp_replace(d.cast("string"), r"\.?0+$", ""))


def canonical_value(field: Column, value: Column) -> Column:
    """The text stored for a value: money with two decimals, whole quantities without any, other text stripped."""
    return F.when(value.isNull() | (value == ""), None).otherwise(
        F.when(field.isin(MONEY_FIELDS), money(value).cast("string"))
        .when(field == "quantity", plain_number(value))
        .otherwise(strip(value))
    )


def label_text(c: Column) -> Column:
    """``bank_account`` -> ``Bank account``."""
    t = F.replace(c, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.left(t, F.lit(1))), F.lower(F.substr(t, F.lit(2))))


def checked_value(field: Column, value: Column) -> Column:
    """struct(value, error): a reviewer's value in stored form, or why it cannot be stored for this field."""
    v = strip(value)
    amount = F.bround(F.regexp_replace(v, "[,$]", "").try_cast("decimal(38,10)"), 2).cast("decimal(30,2)").cast("string")
    day = F.date_format(iso_date(v), "yyyy-MM-dd")
    # The three messages.
    is_money, is_date = field.isin(MONEY_FIELDS), field.isin(DATE_FIELDS)
    empty = v.isNull() | (v == "")
    stored = F.when(~empty, F.when(is_money, amount).when(is_date, day).otherwise(v))
    error = (
        F.when(empty, "Enter a value.")
        .when(is_money & amount.isNull(), F.concat(label_text(field), F.lit(" must be an amount, for example 2273.60.")))
        .when(is_date & day.isNull(), F.concat(label_text(field), F.lit(" must be a date as YYYY-MM-DD.")))
    )
    return F.struct(stored.alias("value"), error.alias("error"))


def printed_variants(field: Column, value: Column) -> Column:
    """The ways a value may be printed on a page, in order of preference; empty for a missing value."""
    m = money(value)
    d = iso_date(value)
    as_date = F.array(*[F.date_format(d, p) for p in ("MM/dd/yyyy", "MMMM dd, yyyy", "yyyy-MM-dd", "MMM dd, yyyy")])
    variants = (
        F.when(value.isNull() | (value == ""), F.array().cast("array<string>"))
        .when(field.isin(MONEY_FIELDS), F.array(F.format_number(m, 2), m.cast("string")))
        .when(field == "quantity", F.array(plain_number(value)))
        .when(field.isin(DATE_FIELDS), F.when(d.isNotNull(), as_date).otherwise(F.array(value)))
        .otherwise(F.array(strip(value)))
    )
    return F.filter(variants, lambda v: v.isNull() | (strip(v) != ""))  # a blank value is printed nowhere


def compare_norm(c: Column) -> Column:
    """Comparison form for scoring: numbers to two decimals (thousands separators dropped), other text lower-cased."""
    s = strip(c)
    n = F.replace(s, F.lit(","), F.lit(""))
    number = F.when(n.rlike(NUMBER), n.try_cast("double").try_cast("decimal(38,2)").cast("string"))
    return F.when(c.isNull(), "").otherwise(F.coalesce(number, F.lower(s)))


def same_text(a: Column, b: Column) -> Column:
    return F.lower(strip(F.coalesce(a, F.lit("")))) == F.lower(strip(F.coalesce(b, F.lit(""))))


def safe_file_name(c: Column) -> Column:
    """Base name with unusual characters replaced, at most 100 characters, ending in ``.pdf``."""
    base = F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"[^A-Za-z0-9._-]+", "_")
    base = F.left(base, F.lit(SAFE_NAME_LENGTH))
    return F.when(F.lower(base).endswith(".pdf"), base).otherwise(F.concat(base, F.lit(".pdf")))


def file_problem(doc_id: Column, content: Column, size: Column) -> Column:
    """Why a file must not be landed, or NULL when it may."""
    return (
        F.when(~doc_id.rlike(r"^[A-Za-z0-9_-]{1,64}$"), "Invalid doc_id.")
        .when(size > MAX_UPLOAD_BYTES, "The PDF is larger than 25 MB.")
        .when(~content.startswith("%PDF-"), "That file isn't a PDF.")
    )


def fallback_fields(text: Column) -> Column:
    """struct(vendor_name, invoice_number) read from raw text: the first line with content, a labelled number."""
    vendor = F.element_at(F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), strip), lambda l: l != ""), 1)
    number = F.regexp_extract(text, LABELLED_NUMBER, 1)
    return F.struct(
        F.coalesce(vendor, F.lit("Unknown vendor")).alias("vendor_name"),
        F.when(number != "", number).alias("invoice_number"),
    )
