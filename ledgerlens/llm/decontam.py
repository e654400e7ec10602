"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some tokens of a stretch and ignore others, so a seed matches in spite of substitutions at ignored
places. The seeds of all benchmark items are hashed; the seeds of all documents are hashed too and joined to them. A
bit array of fixed size, sent to the tasks, lets through every document seed that a benchmark item may have, so only
those, with the tokens around them, become rows. Each hit sets an alignment of a document and an item; the overlap
around it, over substitutions, counts if it is long enough and mostly equal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import WordHashes, mixed, rows
from ledgerlens.session import stage

TOKEN = re.compile(r"[^\W_]+").findall
#: (tokens of an item, masks): which tokens of a stretch count, for items from so many tokens on. Chosen by enumeration: a
#: whole item of fewer than 13 tokens, and a stretch of 13 tokens or more of another, with at most a fifth substituted
#: has every counted token of one of its masks in one place at least. (A longer stretch has one of 13 to 25 tokens in it
#: that is as equal, so these need not be enumerated.) One token of up to 4 may not be substituted, so these need no more.
CLASSES = (
    (1, ("1",)),
    (2, ("11",)),
    (5, ("111", "1101")),
    (8, ("111011", "11001011", "10100111")),
    (13, ("1111011", "110000010111", "1110001011", "1100110101")),
)
MASKS = tuple(mask for _, masks in CLASSES for mask in masks)
AROUND = 64  # tokens on either side of a hit that are kept for the overlap
FILTER_BITS = 26  # the filter has 2 ** 26 bits, 8 MB, whatever the benchmark


def tokens(text: str | None) -> list[bytes]:
    """Runs of letters and digits in lower case."""
    return [t.encode("utf-8", "surrogatepass") for t in TOKEN((text or "").lower())]


#: A factor for each place of a mask; odd, and without structure.
FACTORS = [int(f) | 1 for f in mixed(np.arange(1, 1 + max(map(len, MASKS)), dtype=np.uint64))]


def masks_for(n: int) -> tuple[int, ...]:
    """Numbers of the masks for an item of ``n`` tokens."""
    own = [masks for least, masks in CLASSES if n >= least]
    return tuple(MASKS.index(m) for m in own[-1]) if own else ()


def seeds(h: np.ndarray, which: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """(mask number, hashes at every position) of those masks of ``which`` that fit."""
    parts = [h * np.uint64(f) for f in FACTORS[: max((len(MASKS[m]) for m in which), default=0)]]
    for m in which:
        mask = MASKS[m]
        n = len(h) - len(mask) + 1
        if n > 0:
            out = np.full(n, m + 1, np.uint64)
            for k, c in enumerate(mask):
                if c == "1":
                    out += parts[k][k : k + n]
            yield m, mixed(out)


def slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def item_seeds(items: DataFrame) -> DataFrame:
    """(item_id, at, seed, slot) of the benchmark items (item_id, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, lists in rows(batches):
            for item_id, held in zip(ids, lists):
                h = np.array(held, np.int64).view(np.uint64)
                for _, s in seeds(h, masks_for(len(h))):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(s), item_id, np.int64)), pa.array(np.arange(len(s)), pa.int32()), pa.array(s.view(np.int64)), pa.array(slots(s))],
                        names=["item_id", "at", "seed", "slot"],
                    )

    return items.mapInArrow(run, "item_id long, at int, seed long, slot long")


def seed_filter(found: DataFrame) -> np.ndarray:
    """The bit array of all slots; made of pieces of 8 kB by tasks, 8 MB in all."""

    def piece(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << 16, np.uint8)
        bits[pdf["slot"].to_numpy() & 0xFFFF] = 1
        return pd.DataFrame({"piece": [int(pdf["piece"].iloc[0])], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    parts = found.select("slot").distinct().withColumn("piece", F.shiftright("slot", 16)).groupBy("piece").applyInPandas(piece, "piece long, bits binary")
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in parts.collect():
        out[r.piece << 13 : (r.piece + 1) << 13] = np.frombuffer(r.bits, np.uint8)
    return out


def segments(docs: DataFrame, allowed: np.ndarray, which: tuple[int, ...]) -> DataFrame:
    """(segment, doc_id, start, tokens, hits): stretches of documents around seeds that the filter lets through.

    Stretches of a document do not overlap by more than what is kept around hits; ``hits`` holds (at, seed), ``at`` from
    the start of the stretch. ``which``: the masks of the items.
    """
    held = docs.sparkSession.sparkContext.broadcast(allowed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed, words = held.value, WordHashes(seed=9)
        number = TaskContext.get().partitionId() << 40
        for ids, texts in rows(batches):
            cols: list[list] = [[], [], [], [], []]
            lists = [words.of(tokens(t)) for t in texts]
            ends = np.cumsum([len(x) for x in lists])
            h = np.concatenate(lists)  # seeds over several documents at once; those across two are dropped
            at, seed, doc = [], [], []
            for m, s in seeds(h, which):
                slot = slots(s)
                k = np.flatnonzero(allowed[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                d = np.searchsorted(ends, k, "right")
                inside = k + len(MASKS[m]) <= ends[d]
                at.append(k[inside])
                seed.append(s[k[inside]])
                doc.append(d[inside])
            place, seed, doc = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, seed, doc))
            order = np.argsort(place, kind="stable")
            place, seed, doc = place[order], seed[order], doc[order]
            cuts = np.flatnonzero((np.diff(place) > AROUND) | (np.diff(doc) > 0)) + 1
            for group in np.split(np.arange(len(place)), cuts) if len(place) else ():
                d = int(doc[group[0]])
                begin, end = int(ends[d]) - len(lists[d]), int(ends[d])
                start = max(begin, int(place[group[0]]) - AROUND)
                stop = min(end, int(place[group[-1]]) + AROUND + 1)
                hits = [{"at": int(p) - start, "seed": int(x)} for p, x in zip(place[group], seed[group].view(np.int64))]
                for c, v in zip(cols, (number, ids[d], start - begin, h[start:stop].view(np.int64), hits)):
                    c.append(v)
                number += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.struct([("at", pa.int32()), ("seed", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["segment", "doc_id", "start", "tokens", "hits"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "segment long, doc_id long, start int, tokens array<long>, hits array<struct<at:int,seed:long>>"
    )


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, least: int, share: float) -> tuple[int, int, int] | None:
    """(start in doc, length, equal tokens) of the longest overlap of ``doc[shift + q]`` with ``item[q]``, if any.

    An overlap begins and ends with equal tokens, at least ``share`` of its tokens are equal, and it has at least
    ``least`` tokens, or all of a shorter item. Of the longest the first is given.
    """
    lo = max(0, -shift)
    hi = max(lo, min(len(item), len(doc) - shift))
    same = doc[lo + shift : hi + shift] == item[lo:hi]
    least = min(least, len(item))
    # An equal token is worth 1 - share, another costs share: enough are equal where the sum is not below zero.
    total = np.concatenate(([0.0], np.cumsum(np.where(same, 1 - share, -share)))).round(9).tolist()
    starts: list[int] = []  # only these can begin a longest overlap: none before them has a lower sum
    for i in np.flatnonzero(same).tolist():
        if not starts or total[i] < total[starts[-1]]:
            starts.append(i)
    best = None
    for j in (np.flatnonzero(same)[::-1] + 1).tolist():
        while starts and (starts[-1] >= j or total[j] >= total[starts[-1]]):
            i = starts.pop()
            if i < j and (best is None or (j - i, -i) > (best[1] - best[0], -best[0])):
                best = (i, j)
    if best is None or best[1] - best[0] < least:
        return None
    i, j = best
    return i + lo + shift, j - i, int(same[i:j].sum())


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 13, share: float = 0.8) -> DataFrame:
    """(doc_id, item_id, start, n_tokens, n_equal): overlaps of documents with benchmark items.

    From token ``start`` of the document, ``n_tokens >= least`` tokens (or a whole shorter item's) are equal to an item's but for
    substitutions, with ``n_equal / n_tokens >= share``; up to AROUND tokens on either side of a hit. Of several overlaps of a
    document with an item at one place the longest is given. Items
    without a token and null texts are looked for nowhere; the masks are proven for ``least`` of 13 and ``share`` of 0.8 or more. Rows without doc_id or item_id are left out; repeated rows change nothing; other columns are
    ignored; empty tables give an empty result.
    """
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes(seed=9)
        for ids, texts in rows(batches):
            lists = [words.of(tokens(t)).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["item_id", "item"])

    items = stage(
        benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
        .mapInArrow(hashed, "item_id long, item array<long>").where(F.size("item") > 0).dropDuplicates(),
        "decontam-items",
    )
    known = stage(item_seeds(items.select("item_id", "item")), "decontam-seeds")
    sizes = [r.n for r in items.select(F.least(F.size("item"), F.lit(CLASSES[-1][0])).alias("n")).distinct().collect()]  # at most 13
    which = tuple(sorted({m for n in sizes for m in masks_for(n)}))
    near = stage(segments(own, seed_filter(known), which), "decontam-segments")
    hits = near.select("segment", F.inline("hits")).withColumnRenamed("at", "place")
    pairs = stage(
        hits.join(known.select("seed", "item_id", "at"), "seed")
        .select("segment", "item_id", (F.col("place") - F.col("at")).alias("shift")).distinct(),
        "decontam-pairs",
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, item_ids, starts, docs_, items_, shifts in rows(batches):
            cols: list[list] = [[], [], [], [], []]
            for doc_id, item_id, start, doc, item, shift in zip(ids, item_ids, starts, docs_, items_, shifts):
                if o := overlap(np.array(doc), np.array(item), shift, least, share):
                    for c, v in zip(cols, (doc_id, item_id, start + o[0], *o[1:])):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "start", "n_tokens", "n_equal"])

    met = (
        pairs.join(near.select("segment", "doc_id", "start", "tokens"), "segment").join(items, "item_id")
        .select("doc_id", "item_id", "start", "tokens", "item", "shift")
    )
    found = met.mapInArrow(verify, "doc_id long, item_id long, start int, n_tokens int, n_equal int")
    return found.groupBy("doc_id", "item_id", "start").agg(F.max(F.struct("n_tokens", "n_equal")).alias("o")).select(
        "doc_id", "item_id", "start", "o.n_tokens", "o.n_equal"
    )


def without_contaminated(docs: DataFrame, overlaps: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id has no overlap; rows without doc_id stay."""
    return docs.join(overlaps.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
