"""Files and tables: typed extracts, landing, reader responses, appends, keyed replaces and updates, export."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.text import checked_value, file_problem
from ledgerlens.model import DOCUMENT_SCHEMAS, ERP_SCHEMAS, RESPONSE_DDL, TABLE_COMMENTS, schema
from ledgerlens.operators.eav import check_values
from ledgerlens.session import folders, released, remove


def read_erp(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The enterprise extracts (all five unless named) with their declared types; a bad cell is an error."""
    return {
        name: spark.read.schema(schema(ERP_SCHEMAS[name])).csv(f"{folder}/{name}.csv", header=True, mode="FAILFAST")
        for name in names or ERP_SCHEMAS
    }


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def register_files(files: DataFrame, source: str, ingested_at: Column | None = None) -> DataFrame:
    """Rows of ``documents`` for landed files (columns ``path`` and ``content``): id is the name up to the first "_".

    Files that ``quarantine`` finds a problem with are not registered.
    """
    name = F.element_at(F.split("path", "/"), -1)
    return quarantine(files).filter("problem IS NULL").select(
        F.substring_index(name, "_", 1).alias("doc_id"), name.alias("file_name"), F.col("path").alias("s3_uri"),
        F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("bigint").alias("size_bytes"), F.lit(source).alias("source"),
        (ingested_at if ingested_at is not None else F.current_timestamp()).alias("ingested_at"), F.lit("pending").alias("status"),
        F.lit(None).cast("timestamp").alias("processed_at"))


def quarantine(files: DataFrame) -> DataFrame:
    """Landed files with ``problem``: why a file must not be registered, NULL for a good one."""
    name = F.element_at(F.split("path", "/"), -1)
    head = F.decode(F.substring("content", 1, 5), "ISO-8859-1")
    return files.withColumn("problem", file_problem(F.substring_index(name, "_", 1), head, F.octet_length("content")))


def land(new: DataFrame, registry: DataFrame) -> DataFrame:
    """The rows of ``new`` to add to the registry: one per unknown content hash, the smallest id.

    Copies collapse before the shuffle (partial aggregation), so a much-copied file is not a hot key.
    """
    rest = [c for c in new.columns if c != "sha256"]
    first = new.groupBy("sha256").agg(F.min_by(F.struct(*rest), "doc_id").alias("row")).select("sha256", "row.*")
    return first.join(registry.select("sha256"), "sha256", "left_anti").select(*new.columns)


def landed_ids(new: DataFrame, registry: DataFrame) -> DataFrame:
    """The id each incoming file ends up under: that of the registered file with the same content, if any."""
    known = registry.groupBy("sha256").agg(F.min("doc_id").alias("known_id"))
    first = new.groupBy("sha256").agg(F.min("doc_id").alias("first_id"))
    target = first.join(known, "sha256", "left").select("sha256", F.coalesce("known_id", "first_id").alias("landed_id"),
                                                       F.col("known_id").isNull().alias("is_new"))
    return new.select("doc_id", "sha256").join(target, "sha256").select(
        "doc_id", "landed_id", (F.col("is_new") & (F.col("doc_id") == F.col("landed_id"))).alias("added"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema(RESPONSE_DDL)).json(path, mode="FAILFAST")


def write_responses(responses: DataFrame, path: str) -> None:
    with released(responses.sparkSession):
        responses.write.json(path, compression="gzip")  # words with their scores shrink to about a tenth


def create_tables(spark: SparkSession, database: str, location: str, reset: bool = False) -> None:
    """The eight tables with their comments. ``location`` is the database folder."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{location}'")
    for name, ddl in {**ERP_SCHEMAS, **DOCUMENT_SCHEMAS}.items():
        if reset:
            spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({ddl}) USING parquet COMMENT '{TABLE_COMMENTS[name]}'")


def empty_as_null(df: DataFrame) -> DataFrame:
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select([F.nullif(F.col(c), F.lit("")).alias(c) if c in strings else F.col(c) for c in df.columns])


def append_rows(df: DataFrame, table: str) -> None:
    """Append by column name; empty text is stored as NULL."""
    spark = df.sparkSession
    with released(spark):
        empty_as_null(df).select(*spark.table(table).columns).write.insertInto(table)


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str], touched: DataFrame | None = None) -> DataFrame:
    """``old`` without the rows of the touched keys (those of ``new`` unless given), plus ``new``."""
    gone = (touched if touched is not None else new).select(*keys).distinct()
    return old.join(gone, keys, "left_anti").unionByName(new)


def patch_by_key(df: DataFrame, patch: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Set ``columns`` of the rows that have a patch row (unique by ``keys``) to its values, NULLs included."""
    p = patch.select(*keys, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("patched"))
    joined = df.join(p, keys, "left")
    return joined.select([
        F.when(F.col("patched"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns
    ])


def mark_processed(documents: DataFrame, done: DataFrame, at: Column) -> DataFrame:
    patch = done.select("doc_id").distinct().withColumn("status", F.lit("processed")).withColumn("processed_at", at)
    return patch_by_key(documents, patch, ["doc_id"], ["status", "processed_at"])


REVIEWED = "reviewed by "


def split_reviews(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviews (doc_id, field_name, value, ...) that can be stored, in stored form, and the others with their ``error``."""
    checked = check_values(reviews)
    refused = reviews.withColumn("error", checked_value(F.col("field_name"), F.col("value"))["error"]).filter("error IS NOT NULL")
    return checked.filter("error IS NULL").drop("error"), refused


def apply_reviews(extractions: DataFrame, reviews: DataFrame) -> DataFrame:
    """Header values as reviewers give them (doc_id, field_name, value, reviewer, ts, seq): certain from then on.

    Values that cannot be stored change nothing. Of several reviews of a field the last by time and number counts, and one
    that is older than the review a row already holds is passed over, so the order of arrival does not matter.
    """
    good, _ = split_reviews(reviews)
    last = F.max_by(F.struct("value", "reviewer", "ts"), F.struct("ts", "seq"))
    patch = good.groupBy("doc_id", "field_name").agg(last.alias("r")).select("doc_id", "field_name", "r", F.lit(-1).alias("line_key"))
    joined = extractions.withColumn("line_key", F.coalesce("line_no", F.lit(-1))).join(patch, ["doc_id", "field_name", "line_key"], "left")
    older = F.col("model").startswith(REVIEWED) & (F.col("extracted_at") > F.col("r.ts"))
    new = F.col("r").isNotNull() & ~F.coalesce(older, F.lit(False))
    values = {"field_value": F.col("r.value"), "confidence": F.lit(1.0), "model": F.concat(F.lit(REVIEWED), "r.reviewer"), "extracted_at": F.col("r.ts")}
    return joined.select([F.when(new, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in extractions.columns])


def delete_by_source(documents: DataFrame, source: str, *dependent: DataFrame) -> list[DataFrame]:
    """The documents, and every table that depends on them by doc_id, without those of one source."""
    gone = documents.filter(F.col("source") == source).select("doc_id")
    return [documents.filter(~F.col("source").eqNullSafe(source)), *(d.join(gone, "doc_id", "left_anti") for d in dependent)]


def write_queue(exceptions: DataFrame, table: str) -> int:
    """Rebuild the queue's table; returns how many rows it has now.

    The rows are written to a folder of their own and the name is switched to it afterwards, in one step of the catalog.
    A rebuild that fails leaves the table as it was, and a reader that has begun goes on with the version it began with:
    that one stays until the next rebuild but one.
    """
    spark = exceptions.sparkSession
    fields = spark.table(table).schema.fields
    now = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").first().data_type.rstrip("/")
    base = re.sub(r"-version-\d+-[0-9a-f]+$", "", now)
    versions = {int(v.rsplit("-version-", 1)[1].split("-")[0]): v for v in folders(spark, f"{base}-version-*")}
    number = max(versions, default=0) + 1
    new = f"{base}-version-{number:08d}-{uuid.uuid4().hex[:12]}"
    with released(spark):
        exceptions.select(*[F.col(f.name).cast(f.dataType) for f in fields]).write.parquet(new)
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{new}'")
    spark.catalog.refreshTable(table)
    for old in versions.values():
        if old.rstrip("/").split("/")[-1] != now.split("/")[-1]:
            remove(spark, old)
    return spark.table(table).count()


def json_safe(df: DataFrame) -> DataFrame:
    """Values as they may leave the system: decimals as doubles, NaN as NULL, dates and timestamps as text."""
    def safe(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return c.alias(f.name)

    return df.select([safe(f) for f in df.schema.fields])
