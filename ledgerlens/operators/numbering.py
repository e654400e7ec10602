"""Row numbers within a key that no task has to hold whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import stage


MOST = 200_000  # rows of a key that one task ranks


def numbered(rows: DataFrame, key: str, order: list[str], name: str = "line_no", most: int = MOST) -> DataFrame:
    """``rows`` with ``name``, the row's place within ``key`` by ``order``, from 1.

    Keys with at most ``most`` rows are ranked by a window over the key, so the rows move once and lie by key afterwards.
    Rows of larger keys are range-partitioned by key and order, so a key of any size spreads over tasks.
    """
    large = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(key)
    large = stage(large, "large-keys")  # at most one key for each ``most`` rows
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    if large.isEmpty():
        return rows.withColumn(name, place)
    return rows.join(F.broadcast(large), key, "left_anti").withColumn(name, place).unionByName(
        _over_ranges(rows.join(F.broadcast(large), key, "left_semi"), key, order, name))


def _over_ranges(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Each range is ranked for itself and shifted by the number of the key's rows in the ranges before."""
    ranged = stage(rows.repartitionByRange(key, *order).withColumn("range_id", F.spark_partition_id()), "numbered")
    counts = ranged.groupBy(key, "range_id").agg(F.count("*").alias("n"))
    skip = F.sum("n").over(Window.partitionBy(key).orderBy("range_id")) - F.col("n")
    before = counts.select(key, "range_id", skip.alias("skip"))
    local = F.row_number().over(Window.partitionBy(key, "range_id").orderBy(*order))
    return (
        ranged.withColumn("local", local).join(before, [key, "range_id"])
        .withColumn(name, (F.col("local") + F.col("skip")).cast("int")).drop("local", "skip", "range_id")
    )
