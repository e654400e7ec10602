"""The reader responses derived from documents: what their readers write, and that leaving out words changes nothing else."""

import glob

import duckdb
from pyspark.sql import functions as F

from conftest import SF
from ledgerlens.plans.catalog import QUERIES
from ledgerlens.plans.oracle import SQL
from ledgerlens.session import shared_dir
from ledgerlens.sources import lake, page_fixture


def written(spark):
    folder = shared_dir(spark).removeprefix("file:")
    return set(glob.glob(f"{folder}/ledgerlens/{spark.sparkContext.applicationId}/*"))


def test_readers_of_pages_write_no_table(spark):
    before = written(spark)
    for name in ("A6_document_metrics", "F12_inline_tables", "F13_document_text", "F19_fallback_fields", "P3_flatten_annotation", "W1_locate"):
        QUERIES[name](spark, SF)
    assert written(spark) == before


def test_layouts_are_the_responses_without_words(spark):
    def shown(df):
        p = F.col("p")
        return sorted(map(tuple, df.select("doc_id", "document_annotation", F.explode("pages").alias("p")).select(
            "doc_id", "document_annotation", p["index"], p["markdown"], p["blocks"], p["tables"]["id"], p["tables"]["content"]).collect()))

    layouts = page_fixture.responses(spark, SF, words=False)
    assert shown(layouts) == shown(page_fixture.responses(spark, SF))
    assert layouts.where(F.exists("pages", lambda p: p["confidence_scores"]["word_confidence_scores"].isNotNull())).count() == 0


def test_words_begin_where_they_stand(spark):
    text = " a|bb\t ccc " + "word, " * 100 + "\n-- é\U0001f600x [tbl-0.md](tbl-0.md) end"
    row = spark.createDataFrame([(text,)], "t string").select(page_fixture._words(F.col("t"), F.lit(0), 1).alias("w")).first()
    assert all(text[w.start_index:w.start_index + len(w.text)] == w.text for w in row.w)
    assert [w.text for w in row.w] == ["a", "bb", "ccc"] + ["word,"] * 100 + ["é\U0001f600x", "end"]


def test_responses_are_written_compressed(spark, tmp_path):
    responses = page_fixture.responses(spark, SF)
    lake.write_responses(responses, str(tmp_path / "r"))
    files = glob.glob(str(tmp_path / "r" / "part-*"))
    assert files and all(f.endswith(".json.gz") for f in files)
    assert lake.read_responses(spark, str(tmp_path / "r")).count() == responses.count()


def test_places_need_no_words(spark):
    def scores_words(name):  # a word's confidence is made of 17 times its offset
        return " * 17)" in QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()

    assert scores_words("W2_span_confidence") and not scores_words("W1_locate")


def test_small_files_are_dealt_in_several_tasks_for_each_core(spark):
    assert QUERIES["W1_locate"](spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_documents_without_content_have_no_file_name(spark, tmp_path):
    texts = ["first/line one\nx", " \n \n", "", None, "\n\n  b.PDF \n", "a" * 300, "/", "\t\n"]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES["F15_safe_file_name"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(SQL["F15_safe_file_name"]).fetchall()) and [d for d, _ in got] == ["D0", "D4", "D5", "D6", "D7"]
