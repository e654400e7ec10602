"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The examples are a bounded, documented sample of the labelled documents that may be learned from, toxic and not, with
all of their terms; the space of the vectors is that of the examples' terms. Document frequencies come from all
documents. A term's weight is its idf, raised for terms that a larger sample of labelled documents shows to go with one
of the labels (by the chi-square statistic beyond what chance explains); without that, the insults of a long document
count little beside its other words. Examples are stored in blocks; for every term a block keeps its largest weight,
which bounds the cosine of all its examples. A query reads blocks in the order of their bounds and stops when no further
block can hold a nearer example, so its neighbours are exact.

The distance-weighted vote of the neighbours becomes a score by a logistic curve that is fitted on the votes of the
XX Evidence lists the neighbours.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import held_out, rows
from ledgerlens.session import stage

TERM = re.compile(r"[^\W\d_]+").findall
LONGEST = 64  # a longer letter run is a term by its start and its hash
LIFT = 2.0  # how much a term's tie to a label raises its weight
BLOCK = 64  # examples of a block
NEIGHBOURS = 15
NO_TERM, ALL = -1, -2  # places in the statistics of the documents without any known term, and of all documents


def terms(text: str | None) -> dict[str, int]:
    """Letter runs in lower case, with their counts."""
    words = Counter(TERM((text or "").lower()))
    for w in [w for w in words if len(w) > LONGEST]:
        words[w[:LONGEST] + str(xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")))] = words.pop(w)
    return words


def example_terms(texts: DataFrame) -> DataFrame:
    """(doc_id, y, found, n): the terms of each row's text, sorted, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ys, held in rows(batches):
            counts = [sorted(terms(x).items()) for x in held]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array([[t for t, _ in c] for c in counts], pa.list_(pa.string())),
                 pa.array([[n for _, n in c] for c in counts], pa.list_(pa.int32()))],
                names=["doc_id", "y", "found", "n"],
            )

    return texts.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, found array<string>, n array<int>")


def term_statistics(docs: DataFrame, places: dict[str, int]) -> DataFrame:
    """(place, documents, labelled, toxic): numbers of rows of ``docs`` (text, y) with each known term. Tasks count first.

    A null ``y`` marks a row that is not in the labelled sample. NO_TERM and ALL are counted like terms.
    """
    held = docs.sparkSession.sparkContext.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = held.value
        counts = np.zeros((len(places) + 2, 3), np.int64)
        for texts, ys in rows(batches):
            for text, y in zip(texts, ys):
                own = [p for t in terms(text) if (p := places.get(t)) is not None] or [NO_TERM]
                counts[own + [ALL], : 1 if y is None else 2 + y] += 1
        at = np.flatnonzero(counts[:, 0])
        place = np.where(at < len(places), at, at - len(counts))
        yield pa.RecordBatch.from_arrays([pa.array(place), *(pa.array(counts[at, k]) for k in range(3))], names=["place", "documents", "labelled", "toxic"])

    counted = docs.select("text", "y").mapInArrow(run, "place long, documents long, labelled long, toxic long")
    return counted.groupBy("place").agg(*(F.sum(c).alias(c) for c in ("documents", "labelled", "toxic")))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i], ..., starts[i] + sizes[i] - 1 of all i, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Index:
    """Examples as unit TF-IDF vectors in posting lists cut into blocks, with each block's largest weight of each term."""

    def __init__(self, weights: dict[str, float], ids: list, labels: list[int], counts: list[dict[str, int]]):
        self.place = {t: k for k, t in enumerate(weights)}
        self.weight = np.array(list(weights.values()), np.float64)
        vectors = [self.vector(c) for c in counts]
        # Examples with the same strongest term stand together, so that blocks differ and bounds are tight.
        strongest = [(int(at[w.argmax()]), -float(w.max())) if len(at) else (-1, 0.0) for at, w in vectors]
        order = sorted(range(len(ids)), key=lambda k: (strongest[k], labels[k], ids[k]))
        self.ids = np.array([ids[k] for k in order], np.int64)
        self.labels = np.array([labels[k] for k in order], np.int64)
        self.blocks = -(-len(order) // BLOCK)
        sizes = [len(vectors[k][0]) for k in order]
        term = np.concatenate([vectors[k][0] for k in order] or [np.zeros(0, np.int64)])
        example = np.repeat(np.arange(len(order)), sizes)
        sort = np.lexsort((example, term))
        # Postings by term, then example; a cell is the postings of a term in a block.
        self.example = example[sort].astype(np.int32)
        self.posted = np.concatenate([vectors[k][1] for k in order] or [np.zeros(0)])[sort]
        key = term[sort] * max(1, self.blocks) + self.example // BLOCK
        self.cell_start = np.flatnonzero(np.diff(key, prepend=-1))
        self.cell_size = np.diff(self.cell_start, append=len(key))
        self.cell_block = key[self.cell_start] % max(1, self.blocks)
        self.cell_most = np.maximum.reduceat(self.posted, self.cell_start) if len(key) else np.zeros(0)
        self.first = np.searchsorted(key[self.cell_start], np.arange(len(self.weight) + 1) * max(1, self.blocks))  # of a term's cells

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights (1 + log of the count, times the term's weight, of length 1) of the known terms."""
        place = self.place
        known = [(p, n) for t, n in counts.items() if (p := place.get(t)) is not None]
        at = np.array([p for p, _ in known], np.int64)
        w = (1 + np.log(np.array([n for _, n in known], np.float64))) * self.weight[at]
        return at, w / max(float(np.sqrt((w * w).sum())), 1e-300)

    def nearest(self, counts: dict[str, int], k: int = NEIGHBOURS, without: int | None = None) -> list[tuple[float, int, int]]:
        """(cosine, example id, label) of the ``k`` nearest examples above cosine 0; ties: the smaller id."""
        return self.search(*self.vector(counts), k, without)

    def search(self, at: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, without: int | None = None) -> list[tuple[float, int, int]]:
        """``nearest`` to a vector."""
        if not len(at) or not len(self.ids):
            return []
        per = self.first[at + 1] - self.first[at]
        cells = ranges(self.first[at], per)
        block, weight = self.cell_block[cells], np.repeat(w, per)
        bounds = np.bincount(block, weight * self.cell_most[cells], self.blocks)
        order = np.argsort(-bounds, kind="stable")
        best = np.zeros(0, np.int64)
        cosine = np.zeros(len(self.ids))
        start, step = 0, 1
        while start < len(order):  # one block, then four times as many each time, as long as one can hold a nearer example
            least = cosine[best[-1]] - 1e-9 if len(best) == k else 0.0
            some = order[start : start + step]
            some = some[(bounds[some] > 0) & (bounds[some] >= least)]
            if not len(some):
                break
            read = np.zeros(self.blocks, bool)
            read[some] = True
            mine = read[block]
            own = cells[mine]
            sizes = self.cell_size[own]
            posts = ranges(self.cell_start[own], sizes)
            got = np.bincount(self.example[posts], np.repeat(weight[mine], sizes) * self.posted[posts], len(self.ids)).round(9)
            new = np.flatnonzero((got > 0) & (got >= least))
            if without is not None:
                new = new[self.ids[new] != without]
            cosine[new] = got[new]
            best = np.concatenate((best, new))
            best = best[np.lexsort((self.ids[best], -cosine[best]))][:k]
            start, step = start + step, 4 * step
        return [(float(cosine[e]), int(self.ids[e]), int(self.labels[e])) for e in best]


def vote(near: list[tuple[float, int, int]]) -> float:
    """The toxic share of the neighbours, weighted by the inverse square of the distance 1 - cosine."""
    weights = [1.0 / (0.05 + 1.0 - c) ** 2 for c, _, _ in near]
    return sum(w * y for w, (_, _, y) in zip(weights, near)) / sum(weights)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, by Newton steps with a little shrinkage."""
    a = b = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a + b * x)))
        g = np.array([(weight * (y - p)).sum() - 1e-3 * a, (weight * (y - p) * x).sum() - 1e-3 * b])
        v = weight * p * (1 - p)
        h = np.array([[v.sum() + 1e-3, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


class Model:
    """The index, the curve from votes to scores, and the score of documents without any term of the examples."""

    def __init__(self, index: Index, curve: tuple[float, float], plain: float):
        self.index, self.curve, self.plain = index, curve, plain

    def score(self, counts: dict[str, int]) -> tuple[float, int, list[tuple[float, int, int]]]:
        """The score, the number of known terms, and the neighbours."""
        at, w = self.index.vector(counts)
        near = self.index.search(at, w)
        if not near:
            return self.plain, len(at), near
        a, b = self.curve
        return 1 / (1 + math.exp(-(a + b * vote(near)))), len(at), near


def chosen_examples(docs: DataFrame, sample: DataFrame, examples: int, letters: int) -> DataFrame:
    """(doc_id, y, text): of each label at most ``examples`` documents of the sample, of at most ``letters`` characters in all.

    They are taken in the order of a hash of the id; one that would go beyond ``letters`` is passed over. Of rows that
    share a doc_id the one of the longest text (then the greatest) is taken.
    """
    size = F.coalesce(F.length("text"), F.lit(0))
    # At most 2 * learned rows of 16 bytes: small enough to go to every task, so no text is shuffled.
    sized = (
        docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.max(size).alias("size")).where("size > 0")
        .orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    )
    picked, left, number = [], {0: letters, 1: letters}, Counter()
    for r in sized:
        if number[r.y] < examples and r["size"] <= left[r.y]:
            number[r.y] += 1
            left[r.y] -= r["size"]
            picked.append((r.doc_id, r.y))
    ids = docs.sparkSession.createDataFrame(picked, "doc_id long, y int")
    return docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.max(F.struct(size, "text")).alias("most")).select("doc_id", "y", "most.text")


def fit(docs: DataFrame, labels: DataFrame, learned: int = 16_384, examples: int = 1024, letters: int = 4_000_000) -> Model:
    """A model for ``docs``.

    Learns from the documents with a label 0 or 1 that are not held out: at most ``learned`` of each label raise the
    terms' weights, and of these at most ``examples`` of each, with at most ``letters`` characters in all, are in the
    index, those of the smallest hash of the id. Results are weighted by the labels' true shares. Documents with several
    labels count as toxic if one says so. Without labels every score is 0.5.
    """
    y = (
        labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("y"))
    )
    known = stage(docs.select("doc_id").join(y, "doc_id").distinct(), "toxic-known")
    share = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    if not share:
        return Model(Index({}, [], [], []), (0.0, 0.0), 0.5)
    firsts = [known.where(F.col("y") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(learned) for label in (0, 1)]
    sample = stage(firsts[0].unionByName(firsts[1]), "toxic-sample")
    held = stage(example_terms(chosen_examples(docs, sample, examples, letters)), "toxic-examples").orderBy("doc_id").toArrow()
    ids, ys = held["doc_id"].to_pylist(), held["y"].to_pylist()
    counts = [dict(zip(t, n)) for t, n in zip(held["found"].to_pylist(), held["n"].to_pylist())]
    vocabulary = sorted(set().union(*counts))
    statistics = term_statistics(docs.join(F.broadcast(sample), "doc_id", "left"), {t: k for k, t in enumerate(vocabulary)})
    table = np.zeros((len(vocabulary) + 2, 3))  # a row for each term of the examples, NO_TERM and ALL at the end
    for r in statistics.collect():
        table[r.place] = r.documents, r.labelled, r.toxic
    number, seen, toxic_seen = table[ALL]
    n = np.array([max(1.0, seen - toxic_seen), max(1.0, toxic_seen)])
    a, b = table[:-2, 2], table[:-2, 1] - table[:-2, 2]
    chi = n.sum() * (a * (n[0] - b) - b * (n[1] - a)) ** 2 / (n[0] * n[1] * np.maximum(a + b, 1) * np.maximum(n.sum() - a - b, 1))
    chance = 2 * math.log(max(3, len(vocabulary))) + 6  # what about no term reaches by chance
    idf = np.log((1 + number) / (1 + table[:-2, 0])) + 1
    index = Index(dict(zip(vocabulary, (idf * (1 + LIFT * np.sqrt(np.maximum(0, chi - chance)))).tolist())), ids, ys, counts)
    total = sum(share.values())
    weight = {label: share[label] / n[label] for label in share}
    having = Counter(ys)
    tied = {t for t, x in zip(vocabulary, chi) if x > chance}
    none = {label: (table[NO_TERM, 2] if label else table[NO_TERM, 1] - table[NO_TERM, 2]) * weight.get(label, 1.0) for label in (0, 1)}
    for label, c in zip(ys, counts):  # an example without a term that goes with a label is like a text without any
        if tied.isdisjoint(c):
            none[label] += share[label] / having[label]
    plain = (none[1] + share.get(1, 0) / total) / (none[0] + none[1] + 1)
    votes, truth, weights = [0.0, 1.0], [0, 1], [1.0, 1.0]  # a sure case of each label: copies count even where no examples are alike
    for doc_id, label, c in zip(ids, ys, counts):
        if near := index.nearest(c, without=doc_id):
            votes.append(vote(near))
            truth.append(label)
            weights.append(share[label] / having[label])
    return Model(index, logistic(np.array(votes), np.array(truth, float), np.array(weights)), plain)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_terms, evidence) for every row of ``docs`` (doc_id, text).

    ``n_terms``: how many terms of the examples the text has. ``evidence``: the neighbours' ids, cosines and labels,
    nearest first. The model is sent to the tasks once; its size is bounded by the examples' number and characters.
    Labels, languages and sources play no part.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, score double, n_terms int, evidence array<struct<doc_id:long,cosine:double,label:int>>"
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for ids, texts in rows(batches):
            scored = [model.score(terms(x)) for x in texts]
            evidence = [[{"doc_id": d, "cosine": c, "label": y} for c, d, y in near] for _, _, near in scored]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([s for s, _, _ in scored], pa.float64()), pa.array([n for _, n, _ in scored], pa.int32()), pa.array(evidence, kind)],
                names=["doc_id", "score", "n_terms", "evidence"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_terms, evidence) for every row of ``docs``.

    ``docs`` (doc_id, text) are learned from where ``labels`` (doc_id, toxic) marks them and the id is not held out,
    and all are scored. Null texts count as empty. Rows without doc_id are scored, never learned from. Repeated rows
    are scored alike. Other columns are ignored. An empty table gives an empty result.
    """
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    model = fit(own, labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")))
    return score(own, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_terms", "evidence"
    )
