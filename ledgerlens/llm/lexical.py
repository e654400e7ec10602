"""Ranked lexical search: the best documents for each item, by scanning texts with an automaton of the items' terms.

A term is a run of digits, letters A-Z (lower-cased) and characters from U+0080 on. There is no index of the documents:
an Aho-Corasick automaton of all terms of the items, each between two guards, runs over the texts and counts tf. Its
outputs are term numbers, and a table maps those to the items that use the term. The documents are read twice: once for
document frequencies and lengths, once for scores, of which a task keeps the best of each item.

Items are dealt in blocks of bounded size, and each block is broadcast and scanned for on its own, so the memory of a
task does not grow with the items. An item is an ``item_id``: rows that repeat id and text count once, different texts of
an id add up. Items without terms have no result. A null text has no terms; an empty table gives no rows. Rows that
repeat a doc_id are documents of their own; a null doc_id comes last among equal scores.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import rows
from ledgerlens.session import stage

BLOCK_TERMS = 1 << 17  # (item, term) pairs of a block; the item that reaches it is its last
BLOCK_BYTES = 1 << 24  # bytes of their texts, likewise
CHUNK = 1 << 20  # characters of a text that the automaton reads at once
SCORES = 1 << 21  # scores of a batch of documents held at once
SALTS = 64
GUARD = b" "
#: A text's bytes with terms in lower case and everything else a guard.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_automata: dict[str, ahocorasick.Automaton] = {}  # of the block this worker scans for


def _automaton(block: dict) -> ahocorasick.Automaton:
    if block["id"] not in _automata:
        made = ahocorasick.Automaton()
        for number, term in enumerate(block["terms"]):
            made.add_word((GUARD + term + GUARD).decode("latin-1"), number)
        made.make_automaton()
        _automata.clear()
        _automata[block["id"]] = made
    return _automata[block["id"]]


def _scan(found: ahocorasick.Automaton, text: bytes | None) -> tuple[int, Counter]:
    """How many terms a text has, and how often each of the automaton's terms is among them."""
    flat = (text or b"").translate(FOLD)
    tf: Counter = Counter()
    start, end = 0, 0
    while end >= 0:
        end = flat.find(GUARD, start + CHUNK)
        piece = flat[start:end] if end >= 0 else flat[start:]
        tf.update(map(itemgetter(1), found.iter((GUARD + piece + GUARD).decode("latin-1"))))
        start = end
    return len(flat.split()), tf


def _frequencies(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(term, value) sums of a task: documents that hold the term; under -1 documents with terms, under -2 their terms."""
    block = shared.value
    found = _automaton(block)
    df = np.zeros(len(block["terms"]), np.int64)
    docs = length = 0
    for (texts,) in rows(batches):
        for text in texts:
            n, tf = _scan(found, text)
            docs, length = docs + (n > 0), length + n
            if tf:
                df[np.fromiter(tf, np.int64, len(tf))] += 1
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([held, [-1, -2]]), pa.int64()), pa.array(np.concatenate([df[held], [docs, length]]), pa.int64())], ["term", "value"])


def contributions(tf: np.ndarray, n: int, weight: np.ndarray, docs: int, length: int) -> np.ndarray:
    """weight * ((10^9 tf) div (1000 tf + 8 m)) with the document's m, in whole numbers."""
    m = 25 + (75 * n * docs) // length
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _best(batches: Iterator[pa.RecordBatch], shared, k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` best documents of each item among a task's own."""
    block = shared.value
    found, items, docs, length = _automaton(block), len(block["items"]), block["docs"], block["length"]
    at, uses = block["at"], block["uses"]  # uses of term t by items lie from at[t] to at[t + 1]: item, times
    best: list[list] = [[] for _ in range(items)]
    least = np.ones(items, np.int64)
    width = max(1, min(256, SCORES // max(1, items)))
    waiting: list[tuple] = []

    def settle() -> None:
        scores = np.zeros((len(waiting), items), np.int64)
        for row, (_, terms, values) in enumerate(waiting):
            count = at[terms + 1] - at[terms]
            place = np.repeat(at[terms] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            np.add.at(scores[row], uses[0][place], uses[1][place] * np.repeat(values, count))
        for row, item in zip(*np.nonzero(scores >= least)):
            doc = waiting[row][0]
            entry = (int(scores[row, item]), -doc if doc is not None else -(1 << 64))
            if len(best[item]) < k:
                heapq.heappush(best[item], entry)
            elif entry > best[item][0]:
                heapq.heapreplace(best[item], entry)
            if len(best[item]) == k:
                least[item] = best[item][0][0]
        waiting.clear()

    for ids, texts in rows(batches):
        for doc, text in zip(ids, texts):
            n, tf = _scan(found, text)
            if tf:
                terms = np.fromiter(tf, np.int64, len(tf))
                waiting.append((doc, terms, contributions(np.fromiter(tf.values(), np.int64, len(tf)), n, block["weight"][terms], docs, length)))
                if len(waiting) == width:
                    settle()
    settle()
    out = [(block["items"][i], -d if d > -(1 << 64) else None, s) for i, entries in enumerate(best) for s, d in entries]
    columns = list(zip(*out)) if out else [[]] * 3
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score"])


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times): the terms of each item with repeats."""
    class_ = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = items.select("item_id", "text").distinct().select("item_id", F.explode(F.regexp_extract_all(lower, F.lit(class_), F.lit(0))).alias("term"))
    return each.groupBy("item_id", "term").agg(F.count("*").alias("times"))


def blocks(uses: DataFrame) -> Iterator[dict]:
    """The items in blocks: distinct terms, and the items that use each term. The driver holds one block at a time."""
    def packed(ids: list, triples: list[tuple]) -> dict:
        terms = sorted({t for _, t, _ in triples})
        number = {t: i for i, t in enumerate(terms)}
        triples = sorted((number[t], item, times) for item, t, times in triples)
        flat = np.array(triples, np.int64).reshape(-1, 3)
        return {
            "id": uuid.uuid4().hex, "terms": [t.encode("utf-8") for t in terms], "items": ids,
            "at": np.searchsorted(flat[:, 0], np.arange(len(terms) + 1)), "uses": (flat[:, 1], flat[:, 2])}

    ids, triples, size = [], [], 0
    for row in uses.orderBy(F.col("item_id").asc_nulls_last()).toLocalIterator():
        if not ids or row.item_id != ids[-1]:
            if len(triples) >= BLOCK_TERMS or size >= BLOCK_BYTES:
                yield packed(ids, triples)
                ids, triples, size = [], [], 0
            ids.append(row.item_id)
        triples.append((len(ids) - 1, row.term, row.times))
        size += len(row.term)
    if ids:
        yield packed(ids, triples)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of each item with the highest scores above 0, ties by doc_id."""
    spark = docs.sparkSession
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    uses = stage(item_terms(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))), "lexical-items")
    tops = []
    for block in blocks(uses):
        plain = spark.sparkContext.broadcast(block)
        sums = body.select("text").mapInArrow(lambda b, s=plain: _frequencies(b, s), "term long, value long").groupBy("term").agg(F.sum("value").alias("value"))
        value = {r.term: r.value for r in sums.collect()}  # a row for each term of the block
        docs_, length = value.pop(-1, 0), value.pop(-2, 0)
        plain.unpersist()
        if not value:
            continue
        weight = np.zeros(len(block["terms"]), np.int64)
        for term, df in value.items():
            weight[term] = math.floor(1000 * math.log((2 * docs_ + 2) / (2 * df + 1)))
        weighed = spark.sparkContext.broadcast({**block, "weight": weight, "docs": docs_, "length": length})
        tops.append(stage(body.mapInArrow(lambda b, s=weighed: _best(b, s, k), "item_id long, doc_id long, score long"), "lexical-best"))
    schema = "item_id long, doc_id long, score long"
    best = spark.createDataFrame([], schema)
    for top in tops:
        best = best.unionByName(top)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    some = Window.partitionBy("item_id", "salt").orderBy(*order)
    few = best.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
