"""Files, tables and incremental runs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens.model import DOCUMENT_SCHEMAS, RULES, TABLE_COMMENTS
from ledgerlens.operators import comparison, rules, scoring
from ledgerlens.operators.numbering import numbered
from ledgerlens.session import fresh_path, shared_dir, stage
from ledgerlens.sources import bridge, lake
from ledgerlens.streaming import incremental


def test_shared_folder_follows_the_session(spark):
    folder = shared_dir(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert folder == named.rstrip("/")
    assert fresh_path(spark, "x").startswith(folder + "/") and fresh_path(spark, "x") != fresh_path(spark, "x")


def test_bad_cell_in_an_extract_is_an_error(spark, tmp_path):
    (tmp_path / "po_lines.csv").write_text('po_number,line_no,sku,description,qty,unit_price\nPO-1,1,S1,"Pens, blue",3,11.25\nPO-1,two,S1,x,3,11.25\n')
    df = lake.read_erp(spark, str(tmp_path), ["po_lines"])["po_lines"]
    with pytest.raises(Exception, match="(?i)malformed"):
        df.collect()
    (tmp_path / "po_lines.csv").write_text('po_number,line_no,sku,description,qty,unit_price\nPO-1,1,S1,"Pens, blue",3,11.25\n')
    (row,) = lake.read_erp(spark, str(tmp_path), ["po_lines"])["po_lines"].collect()
    assert row.description == "Pens, blue" and str(row.unit_price) == "11.25"


def test_files_are_registered_by_content(spark, tmp_path):
    for name, body in {"B1_V1_x.pdf": b"%PDF-1", "B2_V1_y.pdf": b"%PDF-1", "B3_V1_z.pdf": b"hello", "B4_V1_z.pdf": b"%PDF-1x"}.items():
        (tmp_path / name).write_bytes(body)
    files = lake.read_files(spark, str(tmp_path))
    docs = lake.register_files(files, "batch", F.lit("2026-01-01").cast("timestamp"))
    assert [(r.doc_id, r.size_bytes) for r in docs.orderBy("doc_id").collect()] == [("B1", 6), ("B2", 6), ("B4", 7)]  # B3 is no PDF
    assert [r.doc_id for r in lake.land(docs, docs.filter("doc_id = 'B4'")).collect()] == ["B1"]
    assert {r.doc_id: (r.landed_id, r.added) for r in lake.landed_ids(docs, docs.filter("doc_id = 'B4'")).collect()} == {
        "B1": ("B1", True), "B2": ("B1", False), "B4": ("B4", False)}
    assert [r.problem for r in lake.quarantine(files).orderBy("path").collect()] == [None, None, "That file isn't a PDF.", None]


def test_tables_carry_comments_and_appends_store_null(spark):
    db = "ledgerlens_test"
    lake.create_tables(spark, db, fresh_path(spark, "db"), reset=True)
    comment = spark.sql(f"DESCRIBE TABLE EXTENDED {db}.vendors").filter("col_name = 'Comment'").first().data_type
    assert comment == TABLE_COMMENTS["vendors"]
    lake.append_rows(spark.createDataFrame([("PO-1", "", None, "b", "open")], "po_number string, vendor_id string, po_date date, buyer string, status string"), f"{db}.purchase_orders")
    assert spark.table(f"{db}.purchase_orders").first().vendor_id is None


def test_rows_are_numbered_over_ranges(spark):
    rows = [(k, (i * 7) % 5, i) for k, n in ((1, 3000), (2, 3), (3, 40)) for i in range(n)]
    got = sorted((r.k, r.line_no, r.a, r.b) for r in numbered(spark.createDataFrame(rows, "k long, a int, b int"), "k", ["a", "b"]).collect())
    want = [(k, n + 1, a, b) for k in (1, 2, 3) for n, (a, b) in enumerate(sorted((a, b) for q, a, b in rows if q == k))]
    assert got == want


def test_candidate_lists_are_complete(spark):
    exc = spark.createDataFrame([("NO_PO", "V1"), ("NO_PO", "V2"), ("NO_PO", "V3"), ("DUPLICATE", "V4")], "rule_code string, vendor_id string")
    many = spark.range(100_000).selectExpr("concat('PO-', lpad(id, 6, '0')) as po_number", "'V1' as vendor_id")
    pos = many.union(spark.createDataFrame([("PO-9", "V2")], many.schema))
    got = {(r.vendor_id, r.chunk): (r.n_orders, r.candidates) for r in comparison.candidate_pos(exc, pos).collect()}
    assert got["V2", 0] == (1, "PO-9") and got["V3", 0] == (0, "(none)") and len(got) == 1002
    listed = ", ".join(got["V1", c][1] for c in range(1000))
    assert listed == ", ".join(f"PO-{k:06d}" for k in range(100_000))
    assert comparison.candidate_orders(exc, pos).count() == 100_001


def docs(spark, rows):
    return spark.createDataFrame([(d, d, d, sha, 1, "batch", dt.datetime(2026, 1, 1), "pending", None) for d, sha in rows], DOCUMENT_SCHEMAS["documents"])


def registry_of(spark):
    return incremental.BucketedTable(spark, fresh_path(spark, "registry"), DOCUMENT_SCHEMAS["documents"], "sha256", buckets=4)


def test_replayed_landing_batches_add_nothing(spark):
    table = registry_of(spark)
    batches = [docs(spark, [("B2", "x"), ("B1", "x"), ("B3", "y")]), docs(spark, [("B4", "x"), ("B5", "z")])]
    for k in (0, 1, 1, 0):
        table.replace(lake.land(batches[k], table.read(batches[k].select("sha256"))))
    assert sorted(r.doc_id for r in table.read().collect()) == ["B1", "B3", "B5"]


def test_streams_pick_up_new_files_only(spark, tmp_path):
    landing, table = str(tmp_path / "landing"), registry_of(spark)
    for rows in ([("B1", "x"), ("B2", "y")], [("B3", "x"), ("B4", "z")]):
        docs(spark, rows).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(table.schema).parquet(landing)
        incremental.land_stream(stream, table, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.doc_id for r in table.read().collect()) == ["B1", "B2", "B4"]


def test_a_key_can_lose_its_rows(spark):
    table = incremental.BucketedTable(spark, fresh_path(spark, "table"), "doc_id string, v int", buckets=2)
    table.replace(spark.createDataFrame([(k, n) for k in "abcdef" for n in (1, 2)], "doc_id string, v int"))
    table.replace(spark.createDataFrame([("b", 4)], "doc_id string, v int"), spark.createDataFrame([(k,) for k in "abcdef"], "doc_id string"))
    assert [(r.doc_id, r.v) for r in table.read().collect()] == [("b", 4)]
    assert table.read(spark.createDataFrame([("zz",)], "doc_id string")).filter("doc_id = 'zz'").count() == 0


def test_pending_documents_arrive_over_many_files(spark, tmp_path):
    """Responses cut over files in any order give what one batch gives; replays and unknown documents change nothing."""
    from conftest import SF
    from ledgerlens.operators import eav
    from ledgerlens.plans import catalog

    pages = catalog.pages(spark, SF).limit(60).cache()
    landed = lake.register_files(pages.select(F.concat("doc_id", F.lit("_a.pdf")).alias("path"), F.encode(F.lit("%PDF-"), "UTF-8").alias("content")), "batch")
    landed = landed.filter("doc_id <> 'D3'").withColumn("status", F.when(F.col("doc_id") == "D4", "processed").otherwise("pending"))
    documents = incremental.BucketedTable(spark, fresh_path(spark, "d"), DOCUMENT_SCHEMAS["documents"], buckets=4)
    documents.replace(landed)
    extractions = incremental.BucketedTable(spark, fresh_path(spark, "x"), DOCUMENT_SCHEMAS["extractions"], buckets=4)
    source = str(tmp_path / "responses")
    pages.repartition(7).write.parquet(source)
    pages.limit(5).write.mode("append").parquet(source)  # some arrive twice
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(source)
    at = F.lit("2026-01-01").cast("timestamp")
    incremental.pending_stream(stream, documents, extractions, str(tmp_path / "cp"), at).awaitTermination()
    key = lambda df: sorted(map(str, df.select("doc_id", "field_name", "line_no", "field_value", "page").collect()))
    assert key(extractions.read()) == key(eav.extract(pages.filter("doc_id not in ('D3', 'D4')"), at))
    assert {r.status for r in documents.read().select("status").distinct().collect()} == {"processed"}


def test_reviews_are_checked_and_ordered_by_time(spark):
    at = dt.datetime(2026, 1, 1)
    row = lambda d, f, v, model="reader": (d, f, None, v, 0.5, 1, None, None, model, at)
    fields = spark.createDataFrame([row("B1", "total", "5.00"), row("B2", "total", "6.00"), row("B3", "invoice_date", "2026-01-01"), row("B4", "total", "7.00")], DOCUMENT_SCHEMAS["extractions"])
    day = lambda n: dt.datetime(2026, 2, n)
    given = [("B1", "total", " $1,023.70", "ann", day(1), 1), ("B1", "total", "junk", "bob", day(2), 2), ("B2", "total", "", "ann", day(1), 3),
             ("B3", "invoice_date", "01/02/2026", "ann", day(1), 4), ("B4", "total", "8", "ann", day(5), 5), ("B4", "total", "9", "bob", day(3), 6)]
    reviews = spark.createDataFrame(given, "doc_id string, field_name string, value string, reviewer string, ts timestamp, seq long")
    out = lake.apply_reviews(fields, reviews)
    assert {r.doc_id: (r.field_value, r.confidence) for r in out.collect()} == {
        "B1": ("1023.70", 1.0), "B2": ("6.00", 0.5), "B3": ("2026-01-01", 0.5), "B4": ("8.00", 1.0)}
    assert sorted(r.seq for r in lake.split_reviews(reviews)[1].collect()) == [2, 3, 4]
    late = lake.apply_reviews(out, reviews.filter("seq = 6"))
    assert {r.doc_id: r.field_value for r in late.collect()}["B4"] == "8.00"


def test_documents_without_truth_or_reading_are_not_judged(spark):
    expected = spark.createDataFrame([("A", "NO_PO", "1.00"), ("B", "NO_PO", "1.00")], "doc_id string, rule_code string, amount string")
    found = spark.createDataFrame([("A", "NO_PO", 1), ("C", "DUPLICATE", 2)], "doc_id string, rule_code string, amount_at_risk int")
    ids = lambda *d: spark.createDataFrame([(x,) for x in d], "doc_id string")
    scored = scoring.score_queue(expected, found, ids("A", "C"), ids("A", "B")).collect()
    assert [(r.doc_id, r.status) for r in scored] == [("A", "ok")]


def test_vendors_without_digits_match_nothing(spark):
    header = spark.createDataFrame([(f"B{k}", "--" if k % 2 else "", "  ") for k in range(500)], "doc_id string, vendor_tax_id string, vendor_name string")
    vendors = spark.createDataFrame([(f"V{k}", "n/a", " ") for k in range(300)], "vendor_id string, tax_id string, name string")
    assert rules.resolve_vendor(header, vendors).filter("vendor_id is null").count() == 500


def test_refreshing_changed_documents_equals_a_full_run(spark):
    from conftest import SF
    from ledgerlens.plans import catalog
    from ledgerlens.plans.exceptions import run_rules

    t, exc = catalog.tables(spark, SF), catalog.exceptions(spark, SF)
    changed = exc.filter("rule_code = 'LOW_CONFIDENCE'").select("doc_id").distinct()
    confirmed = exc.filter("rule_code = 'LOW_CONFIDENCE'").select(
        "doc_id", F.col("evidence_field").alias("field_name"), F.when(F.col("evidence_field").endswith("date"), "2001-07-01").otherwise("1.00").alias("value"), F.lit("r").alias("reviewer"),
        F.lit("2001-07-26").cast("timestamp").alias("ts"), F.lit(1).alias("seq"))
    now = {**t, "extractions": lake.apply_reviews(t["extractions"], confirmed)}
    part = incremental.refresh_affected(changed, now, exc, bridge.AS_OF, run_ts=catalog._run_ts())
    full = run_rules(now, bridge.AS_OF, run_ts=catalog._run_ts())
    key = lambda df: sorted(map(str, df.select(*catalog.QUEUE_COLUMNS).collect()))
    assert key(part) == key(full)
    assert part.filter("rule_code = 'LOW_CONFIDENCE'").count() == 0


def test_rules_have_unique_codes():
    assert len({r[0] for r in RULES}) == 8


def test_rows_of_large_keys_are_numbered_over_ranges(spark):
    rows = [(k, i * 7 % 50, i) for k, n in ((1, 300), (2, 5), (3, 41), (4, 40)) for i in range(n)]
    got = numbered(spark.createDataFrame(rows, "k long, a int, b int").repartition(6), "k", ["a", "b"], most=40)
    want = [(k, n + 1, a, b) for k in (1, 2, 3, 4) for n, (a, b) in enumerate(sorted((a, b) for x, a, b in rows if x == k))]
    assert sorted((r.k, r.line_no, r.a, r.b) for r in got.collect()) == want


def test_a_table_costs_only_what_it_is_derived_from(spark, tmp_path, monkeypatch):
    """Neither field rows nor the extracts of other tables are written to read one table."""
    from conftest import SF
    from ledgerlens import session
    from ledgerlens.plans import catalog

    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    t = bridge.Tables(spark, SF)
    assert t["truth"].count() == 1473 and t["extractions"].count() == 53568 and t["vendors"].count() == 10
    assert {f.name.rsplit("-", 1)[0] for f in tmp_path.glob("ledgerlens/*/*")} == {"billed", "heads", "large-keys"}
    catalog.QUERIES["S1_erp_vendors"](spark, SF).count()
    assert [f.name for f in tmp_path.glob("ledgerlens/*/erp-csv-*/*")] == ["vendors.csv"]


def test_a_staged_table_leaves_no_shuffle_files(spark):
    def lying():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (str(files.apply(i).getName()) for i in range(files.size())) if f.startswith("shuffle_")}

    before = lying()
    rows = spark.range(10000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count()
    staged = stage(rows, "left-nothing")
    assert lying() <= before and staged.count() == 7 and rows.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
