"""Words a reviewer should look at: the least certain ones of a document, and low-confidence spans of a page.

Everything reads the page arrays in place, row by row, so none of it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import bind, rows_of
from ledgerlens.functions.layout import inline_tables
from ledgerlens.functions.text import WHITESPACE, strip
from ledgerlens.model import MIN_CONFIDENCE

# ---- fixed values: what counts as a clean word, and placeholders that must stay whole ------------------------------
CLEAN_WORD = r"^[\p{L}\p{N}_$%.,;:'\"()/&-]+$"
HAS_WORD_CHARACTER = r"[\p{L}\p{N}_]"
PLACEHOLDER = r"!?\[[^\]]*\]\([^)]*\)"
CONTEXT = 50
OPEN, SEP, CLOSE = "\ue000", "\ue001", "\ue002"


def page_words(p: Column) -> Column:
    return F.coalesce(p["confidence_scores"]["word_confidence_scores"], F.array())


def least_certain(responses: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` least certain clean words of each document with their context on the page."""

    def of_page(p: Column, i: Column) -> Column:
        clean = F.filter(page_words(p), lambda w: strip(w["text"]).rlike("[A-Za-z0-9]") & strip(w["text"]).rlike(CLEAN_WORD))
        return F.transform(
            clean,
            lambda w, k: F.struct(w["confidence"].alias("confidence"), i.cast("int").alias("page_pos"), k.alias("word_pos"),
                                  w["start_index"].alias("start_index"), w["text"].alias("text")),
        )

    def shown(w: Column) -> Column:
        page = F.col("pages")[w["page_pos"]]
        start = w["start_index"]
        first = F.greatest(start - CONTEXT, F.lit(0))
        context = F.substring(page["markdown"], first + 1, start + F.length(w["text"]) + CONTEXT - first)
        return F.struct(
            (page["index"] + 1).alias("page"), strip(w["text"]).alias("word"), w["confidence"].alias("confidence"),
            F.concat(F.lit("…"), F.replace(context, F.lit("\n"), F.lit(" ")), F.lit("…")).alias("context"))

    worst = F.slice(F.sort_array(F.flatten(F.transform("pages", of_page))), 1, n)
    # The context is cut out before the words become rows, so no row carries the pages.
    return responses.select("doc_id", F.posexplode_outer(F.transform(worst, shown)).alias("pos", "w")).where("pos is not null").select(
        "doc_id", (F.col("pos") + 1).alias("rank"), "w.page", "w.word", "w.confidence", "w.context")


def _placeholders(markdown: Column) -> Column:
    """array<struct<s, e>>: the spans of all placeholders, found one after the other."""
    found = F.regexp_extract_all(markdown, F.lit(PLACEHOLDER), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        s = F.position(t, markdown, acc["at"] + 1) - 1
        return F.struct((s + F.length(t)).alias("at"),
                        F.array_append(acc["spans"], F.struct(s.alias("s"), (s + F.length(t)).alias("e"))).alias("spans"))

    return F.aggregate(found, start, step, lambda acc: acc["spans"])


def low_spans(p: Column, threshold: float) -> Column:
    """array<struct<start_index, end_index, word, confidence>>: uncertain words of a page, none overlapping another."""
    md = p["markdown"]
    uncertain = F.filter(
        F.transform(
            F.filter(page_words(p), lambda w: w["confidence"] < threshold),
            lambda w: F.struct(
                (w["start_index"] + F.length(w["text"]) - F.length(F.ltrim(w["text"], F.lit(WHITESPACE)))).alias("start_index"),
                strip(w["text"]).alias("word"),
                F.round(w["confidence"], 4).alias("confidence"),
            ),
        ),
        lambda w: w["word"].rlike(CLEAN_WORD) & w["word"].rlike(HAS_WORD_CHARACTER)
        & (F.substring(md, w["start_index"] + 1, F.length(w["word"])) == w["word"]),
    )
    free = bind(
        _placeholders(md),
        lambda spans: F.filter(
            uncertain,
            lambda w: ~F.exists(spans, lambda s: (s["s"] < w["start_index"] + F.length(w["word"])) & (w["start_index"] < s["e"])),
        ),
    )
    spans = F.transform(F.sort_array(free), lambda w: F.struct(
        w["start_index"].alias("start_index"), (w["start_index"] + F.length(w["word"])).alias("end_index"), w["word"].alias("word"),
        w["confidence"].alias("confidence")))
    # Words rarely overlap; only a page where some do is swept from left to right.
    return bind(spans, lambda all_: F.when(
        F.exists(F.zip_with(all_, F.slice(all_, F.lit(2), F.greatest(F.size(all_), F.lit(1))), lambda a, b: b["start_index"] < a["end_index"]), lambda x: x),
        _without_overlaps(all_)).otherwise(all_))


def _without_overlaps(spans: Column) -> Column:
    """Spans from left to right, without those that start before the last kept one ends."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start_index:int,end_index:int,word:string,confidence:double>>").alias("kept"))
    return F.aggregate(
        spans, start,
        lambda acc, s: F.when(s["start_index"] < acc["at"], acc).otherwise(
            F.struct(s["end_index"].alias("at"), F.array_append(acc["kept"], s).alias("kept"))),
        lambda acc: acc["kept"])


def low_confidence_spans(responses: DataFrame, threshold: float = MIN_CONFIDENCE) -> DataFrame:
    """Uncertain words as spans of their page's text, in order of appearance."""
    return (
        rows_of(responses, "pages", "p", "doc_id")
        .select("doc_id", (F.col("p.index") + 1).alias("page"), F.posexplode(low_spans(F.col("p"), threshold)).alias("mark", "s"))
        .select("doc_id", "page", "mark", "s.start_index", "s.end_index", "s.word", "s.confidence")
    )


def marked_markdown(responses: DataFrame, threshold: float = MIN_CONFIDENCE) -> DataFrame:
    """Page text with numbered marks around the uncertain words and with tables inlined, and the marks' confidences."""
    pages = rows_of(responses, "pages", "p", "doc_id").withColumn("spans", low_spans(F.col("p"), threshold))
    md = F.col("p.markdown")
    ends = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end_index"]))

    def piece(x: Column, n: Column) -> Column:
        span, end = x["spans"], x["end"]
        before = F.substring(md, end + 1, F.coalesce(span["start_index"], F.length(md)) - end)
        mark = F.concat(F.lit(OPEN), n.cast("string"), F.lit(SEP), span["word"], F.lit(CLOSE))
        return F.concat(before, F.coalesce(mark, F.lit("")))

    text = F.array_join(F.transform(F.arrays_zip("spans", ends.alias("end")), piece), "")
    return pages.select(
        "doc_id", (F.col("p.index") + 1).alias("page"), inline_tables(text, F.col("p.tables")).alias("markdown"),
        F.transform("spans", lambda s: s["confidence"]).alias("marks"),
    )
