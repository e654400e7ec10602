"""Helpers that several operators of this folder use: reading, words, word hashes, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import stage

ROWS = 256  # rows of an Arrow batch that a task turns into Python objects at once
LEARN_MOD, HELD_OUT = 4, 2  # documents whose crc32(doc_id) mod 4 is 2 are held out from learning


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id="doc_id"):
    """True where crc32 of the id as text leaves the remainder kept out of learning; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % LEARN_MOD == HELD_OUT, F.lit(True))


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """Columns of at most ROWS rows at a time as Python lists, so that few texts are Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield [c.to_pylist() for c in part.columns]


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash, remembered up to a number of words; forgetting costs time only."""

    def __init__(self, remembered: int = 100_000, seed: int = 0):
        super().__init__()
        self.remembered, self.seed = remembered, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.remembered:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def lower_words(text: str | None) -> list[bytes]:
    """The words (no space, tab, line feed, vertical tab, form feed or carriage return in them), A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the differences of ``x`` over all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * MIX
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` items, by doubling: log2(n) passes over the array."""
    if len(h) < n:
        return h[:0]
    out, have = h, 1
    while have < n:
        step = min(have, n - have)
        out = mixed(out[: len(out) - step] * np.uint64(0x100000001B3) + (out[step:] ^ (out[step:] << np.uint64(17))))
        have += step
    return out


def window_minima(h: np.ndarray, window: int) -> np.ndarray:
    """For each ``window`` consecutive values the position of the least (the first of equals), by doubling."""
    at, have = np.arange(len(h)), 1
    while have < window and len(at):
        step = min(have, window - have)
        a, b = at[: max(0, len(at) - step)], at[step:]
        at = np.where(h[b] < h[a], b, a)
        have += step
    return at


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node in ``links`` (a, b long); the component is the least node reachable.

    Alternates the large-star and small-star steps until neither moves a link. A step joins the links to one row per
    node, so a node with very many links is a skewed join, which Spark splits; every step is a table in the shared
    folder, so a lost executor costs a re-read. Links to oneself and null ends are ignored.
    """
    now = stage(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-links"
    )
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), f"{name}-least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = stage(large.distinct(), f"{name}-large")
        least = stage(now.groupBy("a").agg(F.min("b").alias("m")), f"{name}-least")
        small = now.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = stage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), f"{name}-small")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if seen == mark:
            break
        mark = seen
        if seen[0] == seen[2] and now.select("a").join(now.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break  # every node has one link, to a node that has none: stars
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
