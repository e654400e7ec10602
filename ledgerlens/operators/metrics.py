"""Queue figures, page and document metrics, row counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import bind, rows_of
from ledgerlens.model import ERP_SCHEMAS, PRICE_PER_PAGE, TABLE_COMMENTS


KPI_SUMS = {"processed": "bigint", "fields": "bigint", "actions": "bigint", "need_action": "bigint", "at_risk": "decimal(24,2)",
            "discounts": "decimal(24,2)", "review": "bigint"}
KPI_PARTS = ", ".join(f"{c} {t}" for c, t in KPI_SUMS.items())


def _added(names: list[str]) -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).cast(KPI_SUMS[c]).alias(c) for c in names]


def _queue_sums(exceptions: DataFrame, *keep: Column) -> DataFrame:
    """One row per document with an exception: its share of the queue's figures."""
    amount = F.coalesce("amount_at_risk", F.lit(0).cast("decimal(12,2)"))
    risk = F.col("priority") <= 3
    return exceptions.groupBy("doc_id", *keep).agg(
        F.count("*").alias("actions"),
        F.max(risk.cast("int")).alias("need_action"),
        F.sum(F.when(risk, amount)).alias("at_risk"),
        F.sum(F.when(F.col("rule_code") == "DISCOUNT_WINDOW", amount)).alias("discounts"),
        F.max((F.col("rule_code") == "LOW_CONFIDENCE").cast("int")).alias("review"),
    )


def kpis(exceptions: DataFrame, documents: DataFrame, extractions: DataFrame) -> DataFrame:
    """One row of queue figures. Each table is read once; only one-row results meet."""
    queue = _queue_sums(exceptions).agg(*_added(["actions", "need_action", "at_risk", "discounts", "review"]))
    processed = documents.agg(F.count(F.when(F.col("status") == "processed", 1)).alias("v")).scalar()
    fields = extractions.agg(F.count("*").alias("v")).scalar()
    return queue.select(processed.alias("processed"), fields.alias("fields"), "actions", "need_action", "at_risk", "discounts", "review")


def kpi_parts(exceptions: DataFrame, documents: DataFrame, extractions: DataFrame, part: Column) -> DataFrame:
    """The same figures for each part of the documents; ``part`` is a function of doc_id, so parts add up to the whole."""
    queue = _queue_sums(exceptions, part).drop("doc_id")
    done = documents.select(part, (F.col("status") == "processed").cast("bigint").alias("processed"))
    fields = extractions.groupBy(part).agg(F.count("*").alias("fields"))
    key = queue.columns[0]
    both = queue.unionByName(done, allowMissingColumns=True).unionByName(fields, allowMissingColumns=True)
    return both.groupBy(key).agg(*_added(list(KPI_SUMS)))


def kpis_of_parts(parts: DataFrame) -> DataFrame:
    return parts.agg(*_added(list(KPI_SUMS)))


def rule_rollup(exceptions: DataFrame) -> DataFrame:
    """Amount per document and rule; review rows depend on the reading, not on the data, and are left out."""
    return exceptions.filter(F.col("rule_code") != "LOW_CONFIDENCE").groupBy("doc_id", "rule_code").agg(
        F.sum(F.coalesce("amount_at_risk", F.lit(0).cast("decimal(12,2)"))).cast("decimal(24,2)").alias("amount"))


def mean(values: Column, places: int) -> Column:
    """Mean of an array of doubles, summed and rounded as decimals so that it does not depend on the order; NULL if empty."""
    total = F.aggregate(values, F.lit(0).cast("decimal(24,6)"), lambda a, x: (a + x.cast("decimal(20,6)")).cast("decimal(24,6)"))
    return F.round(total / F.nullif(F.size(values), F.lit(0)).cast("decimal(10,0)"), places).cast("double")


def page_scores(words: Column, tables: Column) -> Column:
    """struct(average, minimum) of the confidence of all words of a page and its tables; NULLs when it has none."""
    def confidences(w: Column) -> Column:
        return F.transform(F.coalesce(w, F.array()), lambda x: x["confidence"])

    of_tables = F.flatten(F.transform(F.coalesce(tables, F.array()), lambda t: confidences(t["word_confidence_scores"])))
    return bind(F.concat(confidences(words), of_tables),
                lambda both: F.struct(mean(both, 4).alias("average"), F.array_min(both).alias("minimum")))


def page_confidence(responses: DataFrame) -> DataFrame:
    p = F.col("p")
    scores = page_scores(p["confidence_scores"]["word_confidence_scores"], p["tables"])
    return rows_of(responses, "pages", "p", "doc_id").select(
        "doc_id", (p["index"] + 1).alias("page"), scores.alias("s")).select(
        "doc_id", "page", F.col("s.average").alias("avg_confidence"), F.col("s.minimum").alias("min_confidence"))


def document_metrics(responses: DataFrame) -> DataFrame:
    """Pages, mean of the page means, blocks with a box, and reading cost of each document, from its own row."""
    scores = F.filter(F.transform("pages", lambda p: p["confidence_scores"]["average_page_confidence_score"]), lambda s: s.isNotNull())
    blocks = F.aggregate(
        F.transform("pages", lambda p: F.size(F.filter(F.coalesce(p["blocks"], F.array()), lambda b: b["top_left_x"].isNotNull()))),
        F.lit(0), lambda a, x: a + x)
    return responses.select(
        "doc_id", F.size("pages").alias("page_count"), mean(scores, 6).alias("avg_confidence"), blocks.alias("block_count"),
        F.round(F.size("pages") * F.lit(PRICE_PER_PAGE), 4).alias("cost"))


def block_types(responses: DataFrame) -> DataFrame:
    """The distinct block types of each page, sorted."""
    return rows_of(responses, "pages", "p", "doc_id").select(
        "doc_id", (F.col("p.index") + 1).alias("page"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("p.blocks", lambda b: b["type"]))), ",").alias("block_types"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        t.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, t in tables.items()
    ])


def table_inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Name, kind, rows and comment of each table."""
    name = F.col("table_name")
    comment = F.create_map(*[F.lit(x) for item in TABLE_COMMENTS.items() for x in item])
    return row_counts(tables).select(
        "table_name", F.when(name.isin(list(ERP_SCHEMAS)), "Enterprise data").otherwise("Document AI").alias("kind"), "n_rows",
        comment[name].alias("comment"))
