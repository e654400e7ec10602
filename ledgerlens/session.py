"""Session settings, the shared folder, and staging of intermediate tables."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ledgerlens", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution (partition coalescing, skew-join splitting) and UTC timestamps."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
        if master.startswith("local"):
            b = b.config("spark.driver.memory", "16g")  # in local mode the driver is the only executor
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlens-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{shared_dir(spark)}/ledgerlens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


_scopes = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged within the block by this thread are removed after it, unless they are to be kept."""
    outer, own = getattr(_scopes, "paths", None), []
    _scopes.paths = own
    try:
        yield
    finally:
        _scopes.paths = outer
        for path in own:
            remove(spark, path)


RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query run within the block are removed as soon as it ends, not when the driver collects garbage.

    For writes, whose shuffles nobody reads again: of a chain of tables only the last query's shuffles lie on the disk.
    """
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE, before)


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to a new parquet table in the shared folder and return a scan of it.

    Cuts the lineage durably: a lost executor costs a re-read, and later readers get column pruning and pushdown. ``keep``:
    the table is read after the ``scratch`` block, if any, that it is made in.
    """
    path = fresh_path(df.sparkSession, name)
    if not keep and getattr(_scopes, "paths", None) is not None:
        _scopes.paths.append(path)
    with released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, waves: int = 1) -> DataFrame:
    """``df`` in ``waves`` tasks for each core when its source has fewer splits than that (small files); otherwise unchanged."""
    tasks = df.sparkSession.sparkContext.defaultParallelism * waves
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def _file_system(spark: SparkSession, path: str):
    """(file system, path) of a folder, as Spark's own readers and writers see it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """The folders that match a pattern."""
    fs, p = _file_system(spark, pattern)
    return [str(s.getPath().toString()) for s in (fs.globStatus(p) or []) if s.isDirectory()]


def remove(spark: SparkSession, path: str) -> None:
    """Delete one folder of this library's own, with what lies in it."""
    fs, p = _file_system(spark, path)
    fs.delete(p, True)
