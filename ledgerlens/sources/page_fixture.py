"""Reader responses (pages, blocks, tables, word confidences, annotation) derived row by row from ``documents``.

Five lines of text make a page: the first is its title, the last its footer, the second becomes a pipe table of
word pairs. The first page also prints an invoice number, a date and a total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.functions import bind
from ledgerlens.model import RESPONSE_DDL, schema
from ledgerlens.operators.metrics import page_scores
from ledgerlens.session import spread

LINES_PER_PAGE = 5
WIDTH, HEIGHT, DPI = 1700, 2203, 200
DATE_PATTERNS = ["MM/dd/yyyy", "MMMM dd, yyyy", "yyyy-MM-dd", "MMM dd, yyyy"]
ABSENT = "zzabsentzz"
WORDS = "array<struct<text:string,confidence:double,start_index:int>>"


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, r"[\s|]+", " "), " "), lambda w: w != "")


def _items(line: Column) -> Column:
    """Word pairs of a line as table items."""
    def item(words: Column, i: Column) -> Column:
        a, b = words[i * 2], words[i * 2 + 1]
        price = (F.length(b) * F.lit("1234.50").cast("decimal(12,2)")).cast("decimal(12,2)")
        return F.struct(a.alias("sku"), b.alias("description"), F.length(a).alias("quantity"), price.alias("unit_price"),
                        (price * F.length(a)).cast("decimal(12,2)").alias("amount"))

    return bind(
        _tokens(line),
        lambda words: F.when(
            F.size(words) >= 2, F.transform(F.sequence(F.lit(0), (F.size(words) / 2).cast("int") - 1), lambda i: item(words, i))
        ).otherwise(F.array().cast("array<struct<sku:string,description:string,quantity:int,unit_price:decimal(12,2),amount:decimal(12,2)>>")),
    )


def _table_text(items: Column) -> Column:
    rows = F.transform(items, lambda t: F.concat(
        F.lit("| "), t["sku"], F.lit(" | "), t["description"], F.lit(" | "), t["quantity"].cast("string"), F.lit(" | "),
        F.format_number(t["unit_price"], 2), F.lit(" |")))
    return F.array_join(F.concat(F.array(F.lit("| Item | Description | Qty | Price |"), F.lit("|---|---|---|---|")), rows), "\n")


RUN = 16  # pieces whose places are summed up in one go


def _starts(pieces: Column) -> Column:
    """Where each of the pieces between single blanks begins: runs of pieces are summed up first, then each from its start."""
    def sums(lengths: Column, first: Column) -> Column:
        return F.aggregate(lengths, F.array(first), lambda at, n: F.array_append(at, F.element_at(at, -1) + n))

    def of_runs(runs: Column) -> Column:
        firsts = sums(F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, n: a + n)), F.lit(0))
        return bind(firsts, lambda at: F.flatten(F.transform(runs, lambda r, i: F.slice(sums(r, F.get(at, i)), F.lit(1), F.size(r)))))

    lengths = F.transform(pieces, lambda w: F.length(w) + 1)
    return bind(lengths, lambda ns: bind(
        F.transform(F.sequence(F.lit(0), F.floor((F.size(ns) - 1) / RUN).cast("int")), lambda i: F.slice(ns, i * RUN + 1, F.lit(RUN))), of_runs))


def _words(text: Column, seed: Column, step: int) -> Column:
    """Tokens of ``text`` with their offset and a confidence computed from it."""
    pieces = F.split(F.regexp_replace(text, r"[\s|]", " "), " ")
    placed = bind(pieces, lambda ws: F.arrays_zip(ws.alias("text"), _starts(ws).alias("start")))
    link = lambda w: w.startswith("[tbl-") & w.rlike(r"^\[tbl-\d+\.md\]\(tbl-\d+\.md\)$")
    kept = F.filter(placed, lambda w: (w["text"] != "") & w["text"].rlike(r"[\p{L}\p{N}_]") & ~link(w["text"]))
    return F.transform(kept, lambda w: F.struct(
        w["text"].alias("text"), (((seed + w["start"] * step) % 1000).cast("double") / 1000).alias("confidence"), w["start"].alias("start_index")))


def build(documents: DataFrame, words: bool = True, keep: list[str] | None = None) -> DataFrame:
    """The response of each document. Without ``words`` the lists of words and the scores made of them are NULL, for readers
    of text and layout only; columns named in ``keep`` stay beside the response."""
    key = F.col("doc_id")
    scored = _words if words else lambda *_: F.lit(None).cast(WORDS)
    lines = F.filter(F.split("text", "\n"), lambda l: F.trim(l) != "")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (key % 365).cast("int"))
    printed_day = F.element_at(F.array(*[F.date_format(day, p) for p in DATE_PATTERNS]), (key % 4).cast("int") + 1)
    total = ((key % 9000 + 1) * F.lit("1.25").cast("decimal(12,2)")).cast("decimal(12,2)")
    keep = keep or []
    d = documents.select("doc_id", "text", *[c for c in keep if c != "text"], lines.alias("ls"), day.alias("day"), printed_day.alias("printed_day"), total.alias("total"))
    info = F.concat(F.lit("Invoice No. INV-"), key.cast("string"), F.lit("\nDate: "), F.col("printed_day"),
                    F.lit("\nTotal due: "), F.format_number("total", 2))
    n = LINES_PER_PAGE
    page_list = bind(F.col("ls"), lambda ls: F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(ls) / n).cast("int") - 1, F.lit(0))),
        lambda p: F.struct(p.alias("index"), F.slice(ls, p * n + 1, n).alias("ls")),
    ))
    with_items = F.transform(page_list, lambda p: F.struct(
        p["index"].alias("index"), p["ls"].alias("ls"),
        F.when(F.size(p["ls"]) > 2, _items(p["ls"][1])).alias("items")))

    def block(kind: Column, content: Column, y0: Column, y1: Column) -> Column:
        return F.struct(kind.alias("type"), content.alias("content"), F.lit(100).alias("top_left_x"), y0.cast("int").alias("top_left_y"),
                        F.lit(1600).alias("bottom_right_x"), y1.cast("int").alias("bottom_right_y"))

    def blocks(p: Column) -> Column:
        m = F.size(p["ls"])
        of_lines = F.transform(p["ls"], lambda l, j: block(
            F.when(j == 0, "title").when(j == m - 1, "footer").when(p["items"].isNotNull() & (j == 1), "table").otherwise("text"),
            F.when(j == 0, F.concat(F.lit("# "), l)).when(p["items"].isNotNull() & (j == 1), _table_text(p["items"])).otherwise(l),
            275 + j * 330, 605 + j * 330))
        return F.when(p["index"] == 0, F.concat(F.array(block(F.lit("text"), info, F.lit(55), F.lit(220))), of_lines)).otherwise(of_lines)

    with_blocks = F.transform("page_items", lambda p: F.struct(
        p["index"].alias("index"), blocks(p).alias("blocks"),
        F.concat(F.lit("tbl-"), p["index"].cast("string"), F.lit(".md")).alias("table_id")))
    with_text = F.transform("page_blocks", lambda p: F.struct(
        p["index"].alias("index"), p["blocks"].alias("blocks"), p["table_id"].alias("table_id"),
        F.array_join(F.transform(p["blocks"], lambda b: F.when(
            b["type"] == "table", F.concat(F.lit("["), p["table_id"], F.lit("]("), p["table_id"], F.lit(")"))).otherwise(b["content"])), "\n\n").alias("markdown"),
        F.transform(F.filter(p["blocks"], lambda b: b["type"] == "table"), lambda b: F.struct(
            p["table_id"].alias("id"), b["content"].alias("content"),
            scored(b["content"], key * 29 + p["index"] * 11, 13).alias("word_confidence_scores"))).alias("tables")))
    with_words = F.transform("page_text", lambda p: F.struct(
        p["index"].alias("index"), p["markdown"].alias("markdown"), p["tables"].alias("tables"), p["blocks"].alias("blocks"),
        scored(p["markdown"], key * 31 + p["index"] * 7, 17).alias("words")))

    def page(p: Column) -> Column:
        return bind(page_scores(p["words"], p["tables"]) if words else F.lit(None).cast("struct<average:double,minimum:double>"), lambda scores: F.struct(
            p["index"].alias("index"), p["markdown"].alias("markdown"), p["tables"].alias("tables"), p["blocks"].alias("blocks"),
            F.struct(F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit(DPI).alias("dpi")).alias("dimensions"),
            F.struct(scores["average"].alias("average_page_confidence_score"), scores["minimum"].alias("minimum_page_confidence_score"),
                     p["words"].alias("word_confidence_scores")).alias("confidence_scores")))

    annotation = F.struct(
        F.trim(F.try_element_at("ls", F.lit(1))).alias("vendor_name"), F.concat(F.lit("INV-"), key.cast("string")).alias("invoice_number"),
        F.col("day").alias("invoice_date"), F.nullif(F.regexp_extract("text", r"\p{L}{6,}", 0), F.lit("")).alias("po_number"),
        F.lit("USD").alias("currency"), F.col("total").alias("total"),
        F.flatten(F.transform("page_items", lambda p: F.coalesce(p["items"], F.array()))).alias("line_items"))
    built = (
        d.withColumn("page_items", with_items).withColumn("page_blocks", with_blocks).withColumn("page_text", with_text)
        .withColumn("page_words", with_words)
        .select(F.concat(F.lit("D"), key.cast("string")).alias("doc_id"), F.lit("reader-1").alias("model"),
                F.lit(None).cast("double").alias("_seconds"), F.to_json(annotation).alias("document_annotation"),
                F.transform("page_words", page).alias("pages"), *keep)
    )
    return built.select(*[F.col(f.name).cast(f.dataType) for f in schema(RESPONSE_DDL)], *keep)


def responses(spark: SparkSession, sf_dir: str, words: bool = True, keep: list[str] | None = None) -> DataFrame:
    """The responses for one input folder. They are derived where they are read: words with their scores take ten times
    the space of the text, and to write and read them again takes longer than to derive them."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return build(spread(documents, waves=4), words, keep)  # a long document takes longer than its share of the text
