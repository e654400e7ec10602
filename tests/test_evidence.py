"""Evidence location against hand-made pages and a brute-force search."""

import json

from pyspark.sql import functions as F

from ledgerlens.functions import text
from ledgerlens.model import RESPONSE_DDL, schema
from ledgerlens.operators import eav, evidence, review


def words(s, conf=0.9, **special):
    out, at = [], 0
    for w in s.replace("\n", " ").replace("|", " ").split(" "):
        if w:
            out.append({"text": w, "confidence": special.get(w, conf), "start_index": at})
        at += len(w) + 1
    return out


def page(index, blocks, tables=(), **special):
    md = "\n\n".join(c for _, c in blocks)
    return {"index": index, "markdown": md, "tables": list(tables), "dimensions": {"width": 1000, "height": 2000, "dpi": 200},
            "blocks": [{"type": t, "content": c, "top_left_x": 100, "top_left_y": 200 * i, "bottom_right_x": 900, "bottom_right_y": 200 * i + 100}
                       for i, (t, c) in enumerate(blocks)],
            "confidence_scores": {"average_page_confidence_score": 0.9, "minimum_page_confidence_score": 0.1, "word_confidence_scores": words(md, **special)}}



def extract(spark, tmp_path, pages, annotation):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"doc_id": "D1", "model": "m", "pages": pages, "document_annotation": json.dumps(annotation)}))
    df = spark.read.schema(schema(RESPONSE_DDL)).json(str(path))
    path2 = str(tmp_path / "stored")
    df.write.parquet(path2)
    rows = eav.extract(spark.read.schema(df.schema).parquet(path2)).collect()
    return {(r.field_name, r.line_no): r for r in rows}


def test_footers_come_last_and_dates_and_amounts_match_as_printed(spark, tmp_path):
    p = page(0, [("footer", "Acme Ltd 1,023.70"), ("title", "# **Acme** Ltd"), ("text", "Dated September 01, 2026\nTotal 1,023.70")], **{"1,023.70": 0.4})
    got = extract(spark, tmp_path, [p], {"vendor_name": "Acme Ltd", "invoice_date": "2026-09-01", "total": 1023.7, "po_number": "PO-77"})
    assert json.loads(got["vendor_name", None].bbox) == [0.1, 0.1, 0.9, 0.15]
    assert json.loads(got["invoice_date", None].bbox) == [0.1, 0.2, 0.9, 0.225]
    total = got["total", None]
    assert json.loads(total.bbox) == [0.1, 0.225, 0.9, 0.25] and total.field_value == "1023.70"
    assert total.confidence == 0.4  # the first occurrence on the page counts, which is the footer's
    assert (got["po_number", None].page, got["po_number", None].bbox, got["po_number", None].confidence) == (None, None, None)
    assert len(got) == 16


def test_line_fields_need_the_row_key_and_score_in_their_row(spark, tmp_path):
    content = "| Item | Qty |\n|---|---|\n| S1 | 5 |\n| S2 | 5 |"
    scores = words(content)
    for w, c in zip([w for w in scores if w["text"] == "5"], (0.0, 0.3)):
        w["confidence"] = c
    table = {"id": "t", "content": content, "word_confidence_scores": scores}
    p0 = page(0, [("text", "5 items follow")])
    p1 = page(1, [("table", content)], [table])
    got = extract(spark, tmp_path, [p0, p1], {"line_items": [{"sku": "S1", "quantity": 5}, {"sku": "S2", "quantity": 5.0}, {"sku": None, "description": "none", "quantity": 2.5}]})
    assert got["quantity", 1].page == 2 and got["quantity", 1].field_value == "5"
    assert got["quantity", 2].confidence == 0.3
    assert got["quantity", 1].confidence == 0.0  # zero falls back to the row, whose least is zero too
    assert json.loads(got["sku", 2].bbox)[1] == round((0 + 2 * (100 / 3)) / 2000, 4)
    assert got["quantity", 3].field_value == "2.5" and got["quantity", 3].page is None
    assert len(got) == 16 + 15


def test_values_longer_than_a_bucket_score_all_their_words(spark, tmp_path):
    name = " ".join(f"word{i}" for i in range(90))
    p = page(0, [("text", "start " + name + " end")], **{"word89": 0.2, "end": 0.1})
    assert extract(spark, tmp_path, [p], {"vendor_name": name})["vendor_name", None].confidence == 0.2


def test_locate_equals_brute_force(spark):
    from ledgerlens.plans import catalog
    from conftest import SF

    pages = {r.doc_id: r.pages for r in catalog.pages(spark, SF).filter(F.length("doc_id") < 4).collect()}
    rows = catalog.QUERIES["W1_locate"](spark, SF).filter(F.length("doc_id") < 4).collect()
    assert len(rows) > 1000
    for r in rows:
        want = None
        for p in pages[r.doc_id]:
            for b in sorted(p.blocks, key=lambda b: b.type == "footer"):
                for line in b.content.split("\n"):
                    if want is None and not set(line) <= set(" |:-") and r.value.lower() in line.lower():
                        want = p["index"] + 1
        assert r.page == want, (r.doc_id, r.value)


def test_overlapping_and_placeholder_words_are_not_marked(spark, tmp_path):
    md = "abc defgh [t](t) xyz"
    p = page(0, [("text", md)])
    p["markdown"] = md
    p["confidence_scores"]["word_confidence_scores"] = [
        {"text": "defgh", "confidence": 0.5, "start_index": 4}, {"text": "efg", "confidence": 0.2, "start_index": 5},
        {"text": "abc", "confidence": 0.84999, "start_index": 0}, {"text": "t", "confidence": 0.1, "start_index": 11},
        {"text": " xyz ", "confidence": 0.1, "start_index": 16}, {"text": "wrong", "confidence": 0.1, "start_index": 0}, {"text": "--", "confidence": 0.1, "start_index": 2}]
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"doc_id": "D1", "pages": [p]}))
    df = spark.read.schema(schema(RESPONSE_DDL)).json(str(path))
    spans = [(r.start_index, r.end_index, r.word, r.confidence) for r in review.low_confidence_spans(df).orderBy("mark").collect()]
    assert spans == [(0, 3, "abc", 0.85), (4, 9, "defgh", 0.5), (17, 20, "xyz", 0.1)]
    (m,) = review.marked_markdown(df).collect()
    assert m.markdown == "0abc 1defgh [t](t) 2xyz" and m.marks == [0.85, 0.5, 0.1]


def test_span_confidence_uses_the_first_occurrence(spark):
    md = "pay 50 for 5 items"
    df = spark.createDataFrame([(md, words(md, **{"50": 0.3, "5": 0.8}))], "md string, w array<struct<text:string,confidence:double,start_index:int>>")
    r = df.select(evidence.span_confidence(F.col("w"), F.col("md"), F.lit("5")).alias("c"), evidence.span_confidence(F.col("w"), F.col("md"), F.lit("zz")).alias("n")).first()
    assert (r.c, r.n) == (0.3, None)


def test_review_values(spark):
    cases = [("total", " $1,023.70 "), ("total", "twelve"), ("invoice_date", "2026-02-30"), ("invoice_date", "2026-02-28"), ("po_number", " \t"), ("po_number", " PO-1\n")]
    got = [(r.value, r.error) for r in eav.check_values(spark.createDataFrame(cases, "field_name string, value string").coalesce(1)).collect()]
    assert got == [("1023.70", None), (None, "Total must be an amount, for example 2273.60."), (None, "Invoice date must be a date as YYYY-MM-DD."),
                   ("2026-02-28", None), (None, "Enter a value."), ("PO-1", None)]


def test_file_names_and_comparison_forms(spark):
    row = spark.range(1).select(
        text.safe_file_name(F.lit("../../Acme invoice.PDF")).alias("a"), text.safe_file_name(F.lit("x" * 200)).alias("b"),
        text.compare_norm(F.lit(" 1,234.5 ")).alias("c"), text.compare_norm(F.lit("004512")).alias("d"), text.compare_norm(F.lit(" Net 30")).alias("e"),
        text.compare_norm(F.lit(None).cast("string")).alias("f")).first()
    assert row.a == "Acme_invoice.PDF" and len(row.b) == 104 and (row.c, row.d, row.e, row.f) == ("1234.50", "4512.00", "net 30", "")
