"""The registered queries of this folder: (spark, sf_dir) to a DataFrame, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from ledgerlens.llm import chat, decontam, divergence, htmltext, knn, language, lexical, licenses, oracle, packing, simhash, suffixes, toxicity, urls
from ledgerlens.llm.common import table
from ledgerlens.session import stage


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), shingle=4, budget=4)


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_path(), size=2048, end_id=1)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"), threshold=0.3)
    return found.select("doc_id", "held_out", "score", "predicted", "n_terms")


def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    added = spark.sql(
        "SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.read_back(chat.conversations(chat.linear(rows)))


def op6_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = stage(knn.integers(table(spark, folder, "embeddings")), "knn-integers")
    return knn.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op7_urls(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"))


def op8_passages(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeated_passages(table(spark, folder, "documents"), least=50)


def op9_contaminated(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"), least=13, share=0.8)


def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


def op12_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return htmltext.main_text(table(spark, folder, "pages"))


def op13_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_language": op2_language,
    "op3_packing": op3_packing,
    "op4_chat": op4_chat,
    "op5_toxicity": op5_toxicity,
    "op6_top_k": op6_top_k,
    "op7_urls": op7_urls,
    "op8_passages": op8_passages,
    "op9_contaminated": op9_contaminated,
    "op10_licenses": op10_licenses,
    "op11_divergence": op11_divergence,
    "op12_main_text": op12_main_text,
    "op13_search": op13_search,
    "pipeline": corpus_pipeline.run,
}
LLM_SQL: dict[str, str] = {"op4_chat": oracle.OP4, "op6_top_k": oracle.OP6, "op10_licenses": oracle.OP10, "op11_divergence": oracle.OP11, "op13_search": oracle.OP13}
