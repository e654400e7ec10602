"""Repeated passages by a sparse suffix array.

Of all word suffixes only those at minimiser positions are kept: where the hash of the next ``PREFIX`` words is the
least of ``window`` neighbours. Any run of ``least = PREFIX + window - 1`` words has one such position with the whole
prefix inside, the same one wherever the run stands. So each kept suffix stands for the runs that have it, which lie one
behind the other: its stretch. Spark sorts the suffixes by prefix, then stretch, then document, in ranges, so equal ones
lie side by side whatever their number, and a task compares neighbours in one pass. A suffix whose prefix and stretch an
earlier document has is a repeat, word by word. Where suffixes of several documents have a prefix in common but not the
stretch, as at the ends of passages, the runs of the first document of each stretch are sorted out one by one. Repeats
that go on along the same diagonal are joined.

Only positions and hashes are sorted and joined; texts are read again for the runs of unlike stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import WordHashes, gram_hashes, lower_words, mixed, rows, window_minima
from ledgerlens.session import scratch, stage

PREFIX = 30  # words by which suffixes are sorted first


def suffixes(docs: DataFrame, least: int) -> DataFrame:
    """(h, s, doc_id, place): the kept suffixes, by the hashes of their first PREFIX words and of their stretch.

    ``place`` holds the stretch's first word and the number n of its runs of ``least`` words: first * window + n - 1.
    """
    window = least - PREFIX + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for ids, texts in rows(batches):
            prefixes, stretches, doc, place = [], [], [], []
            for doc_id, text in zip(ids, texts):
                own = words.of(lower_words(text))
                if len(own) < least:
                    continue
                h, w = gram_hashes(own, PREFIX), gram_hashes(own, least)
                at = window_minima(h, window)  # of each run of ``least`` words; never falls
                turns = np.flatnonzero(at[1:] != at[:-1])
                first, last = np.concatenate(([0], turns + 1)), np.concatenate((turns, [len(at) - 1]))
                prefixes.append(h[at[first]])
                ends = w[last] ^ (w[last] << np.uint64(17))  # both end runs overlap, so they fix all words between
                stretches.append(mixed(w[first] * np.uint64(0x100000001B3) + ends + (last - first).astype(np.uint64)))
                place.append(first * window + last - first)
                doc.append(np.full(len(first), doc_id, np.int64))
            if doc:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).view(np.int64)) for c in (prefixes, stretches, doc, place)], names=["h", "s", "doc_id", "place"]
                )

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "h long, s long, doc_id long, place long")


def ordered(kept: DataFrame) -> DataFrame:
    """(h, doc_id, place, f_doc, f_place): suffixes whose prefix is not the only one, with the first of their stretch."""
    marked = stage(
        kept.repartitionByRange("h", "s", "doc_id", "place").sortWithinPartitions("h", "s", "doc_id", "place").mapInArrow(first_of_run, RUNS),
        "suffix-runs",
        keep=True,
    )
    # A run of equal stretches may begin in an earlier range. A row per range tells which: its first run, and its last with
    # that run's first place.
    begun, held = [], None  # held: the run that goes on, and its first place
    for r in marked.where("closing").orderBy("part").collect():
        if held and held[0] == (r.f_doc, r.f_place):
            begun.append((r.part, *held[0], *held[1]))
        if not held or held[0] != (r.h, r.s):
            held = (r.h, r.s), (r.doc_id, r.place)
    earlier = kept.sparkSession.createDataFrame(begun, "part int, h long, s long, e_doc long, e_place long")
    return (
        marked.where("not closing").join(F.broadcast(earlier), ["part", "h", "s"], "left")  # at most a row for each range
        .select("h", "doc_id", "place", F.coalesce("e_doc", "f_doc").alias("f_doc"), F.coalesce("e_place", "f_place").alias("f_place"))
    )


RUNS = "part int, h long, s long, doc_id long, place long, f_doc long, f_place long, closing boolean"


def first_of_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks sorted suffixes with the first of their run of equal stretches; drops those whose prefix no other one has.

    The range's first and last prefix stay, as the ranges beside may have them. One row more (``closing``) has the last
    run and its first place, and as ``f_doc`` and ``f_place`` h and s of the range's first run.
    """
    part = TaskContext.get().partitionId()
    opening = first = None  # (h, s) of the first run; (h, s, doc, place) of the first of the current run
    before = waiting = None  # h of the row before, and the last row: it waits for the one behind

    def out(columns: list, closing: bool) -> pa.RecordBatch:
        n = len(columns[0])
        values = [pa.array(np.full(n, part), pa.int32()), *(pa.array(c, pa.int64()) for c in columns), pa.array(np.full(n, closing))]
        return pa.RecordBatch.from_arrays(values, names=[f.split()[0] for f in RUNS.split(", ")])

    def marked(own: list[np.ndarray], behind: int | None) -> pa.RecordBatch:
        """``behind``: h of the row behind; None at the end of the range."""
        nonlocal first, before
        h, s = own[:2]
        new = np.concatenate(([first is None or (h[0], s[0]) != first[:2]], (h[1:] != h[:-1]) | (s[1:] != s[:-1])))
        run, starts = np.cumsum(new) - 1, np.flatnonzero(new)  # -1: the run of the batch before
        firsts = [np.where(run >= 0, c[starts[run]] if len(starts) else 0, 0 if first is None else first[k]) for k, c in ((2, own[2]), (3, own[3]))]
        if len(starts):
            first = tuple(c[starts[-1]] for c in own)
        alike = h[1:] == h[:-1]
        keep = np.concatenate(([before is None or h[0] == before], alike)) | np.concatenate((alike, [behind is None or h[-1] == behind]))
        keep |= h == opening[0]
        before = h[-1]
        return out([c[keep] for c in (*own, *firsts)], False)

    for batch in batches:
        own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(own[0]):
            continue
        opening = opening or (own[0][0], own[1][0])
        if waiting is not None:
            own = [np.concatenate((w, c)) for w, c in zip(waiting, own)]
        waiting = [c[-1:].copy() for c in own]
        if len(own[0]) > 1:
            yield marked([c[:-1] for c in own], own[0][-1])
    if waiting is not None:
        yield marked(waiting, None)
        yield out([[v] for v in (*first, *opening)], True)


def first_windows(docs: DataFrame, own: DataFrame, least: int) -> DataFrame:
    """(doc_id, pos, f_doc, f_pos): runs of ``least`` words that an earlier document has, with their first place.

    ``own``: (h, doc_id, place), the suffixes of each stretch's first document. Only prefixes that several of these have
    are looked up; no other run can be repeated unless its stretch is.
    """
    window = least - PREFIX + 1
    several = own.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("h")
    asked = own.join(several, "h").groupBy("doc_id").agg(F.collect_set("place").alias("places"))  # at most the words of a document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for ids, texts, places in rows(batches):
            for doc_id, text, place in zip(ids, texts, places):
                h = gram_hashes(words.of(lower_words(text)), least)
                first, more = np.divmod(np.array(place), window)
                p = np.repeat(first, more + 1) + np.concatenate([np.arange(n + 1) for n in more])
                p = p[p < len(h)]  # an id may stand for several texts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[p].view(np.int64)), pa.array(np.full(len(p), doc_id, np.int64)), pa.array(p)], names=["w", "doc_id", "pos"]
                )

    windows = stage(docs.join(asked, "doc_id").select("doc_id", "text", "places").mapInArrow(run, "w long, doc_id long, pos long"), "suffix-windows")
    first = windows.groupBy("w").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.max("doc_id").alias("high")).where("first.doc_id < high")
    return (
        windows.join(first, "w").where("doc_id > first.doc_id")
        .select("doc_id", "pos", F.col("first.doc_id").alias("f_doc"), F.col("first.pos").alias("f_pos"))
    )


def repeated_passages(docs: DataFrame, least: int = 50) -> DataFrame:
    """(doc_id, start, n_words, first_doc_id, first_start): passages that an earlier document has too.

    A passage is ``n_words >= least`` words from word ``start`` (from 0) of document ``doc_id``, equal to those from
    ``first_start`` of ``first_doc_id``, a document of a smaller id. ``least`` must be over PREFIX. Words are what stands
    between white space, A-Z in lower case. The smallest id of a passage's documents has no row for it, so removing all
    passages leaves one copy of each. Repeats within a document are none. A row ends where the documents differ, or
    where another row of ``doc_id`` goes on. Every run of ``least`` words that an earlier document has is inside a row:
    its stretch is an earlier document's, or it is looked up among the runs of all first stretches with its prefix.

    ``doc_id`` is taken as unique; rows that repeat an id with its text change nothing, and other texts under one id
    are matched each. Null texts and rows without doc_id have no passages. Other columns are ignored. An empty table
    gives an empty result.
    """
    window = least - PREFIX + 1
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with scratch(docs.sparkSession):
        found = ordered(stage(suffixes(own, least), "suffix-kept"))
    whole = found.where("f_doc <> doc_id").select(
        "doc_id", F.expr(f"place div {window}").alias("pos"), F.expr(f"place % {window}").alias("more"), "f_doc", F.expr(f"f_place div {window}").alias("f_pos")
    )
    single = first_windows(own, found.where("f_doc = doc_id").select("h", "doc_id", "place"), least)
    line = ["doc_id", "f_doc", "shift"]
    along = Window.partitionBy(*line).orderBy("pos")
    so_far = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    return (
        whole.unionByName(single.withColumn("more", F.lit(0).cast("long")))
        .withColumn("shift", F.col("pos") - F.col("f_pos")).withColumn("end", F.col("pos") + F.col("more") + least)
        .withColumn("new", F.coalesce(F.col("pos") > so_far, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(along))
        .groupBy(*line, "run").agg(F.min("pos").alias("start"), F.max("end").alias("end"))
        .select(
            "doc_id", F.col("start").cast("int").alias("start"), (F.col("end") - F.col("start")).cast("int").alias("n_words"),
            F.col("f_doc").alias("first_doc_id"), (F.col("start") - F.col("shift")).cast("int").alias("first_start"),
        )
    )


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with the words of ``passages`` cut out of their texts; ``n_chars``, if there, follows.

    A document of which nothing but white space is left is dropped. Documents without passages stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, spans = batch.schema.get_field_index("text"), batch.schema.get_field_index("spans")
            cut = [cut_words(t, s) for t, s in zip(batch.column(text).to_pylist(), batch.column(spans).to_pylist())]
            cols = [pa.array(cut, pa.string()) if k == text else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    spans = passages.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n_words")).alias("spans"))
    joined = docs.join(spans, "doc_id", "left").select(*docs.columns, "spans")
    out = joined.mapInArrow(run, joined.schema)
    out = out.where(F.col("spans").isNull() | F.trim(F.col("text")).rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def cut_words(text: str | None, spans: list | None) -> str | None:
    """The text without the words of the spans and the white space behind them."""
    if text is None or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    inside = np.isin(np.frombuffer(raw, np.uint8), np.array([32, 9, 10, 11, 12, 13], np.uint8), invert=True)
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    edges = np.append(starts, len(raw))
    gone = np.zeros(len(starts), bool)
    for s in spans:
        gone[s["start"] : s["start"] + s["n_words"]] = True
    head = raw[: starts[0]] if len(starts) else raw
    return (head + b"".join(raw[edges[k] : edges[k + 1]] for k in np.flatnonzero(~gone))).decode("utf-8", "surrogatepass")
