"""SimHash near-duplicates: a self-join of the binary trie of fingerprints.

Two tries' nodes are walked down together. A pair of nodes carries the bits in which their prefixes differ and is given
up as soon as these exceed what is allowed. By the pigeonhole principle, two fingerprints within ``budget`` bits agree
up to ``budget // parts`` bits in one of ``parts`` stretches of bits, so the trie is walked once for each stretch, with
the fingerprint turned so that the stretch comes first: the narrow limit holds there, ``budget`` holds for all bits.

Spark walks the upper levels: nodes and their pairs are rows, and each pair becomes a task's unit of work. A node with
many fingerprints is cut into blocks, so a unit holds two blocks of bounded size whatever the data. A unit returns a
spanning forest of the links it finds, not the links. Equal fingerprints are one node from the start.

Budgets that are a large share of the bits (near copies) leave no stretch to prune by. There the trie is walked once for
each of many turns of the fingerprint, a turn being its bits in an order of its own: the first bits must agree, a few
errors are let in for the next, and what is left is compared on all bits. The number of turns follows from the share of
links that all of them may miss. Near copies lose none of these either: sets as similar as asked share one of their first
shingles in any order that all sets keep to, so what the turns overlooked is looked up by these (``overlooked``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import components, lower_words, mixed, rows
from ledgerlens.session import scratch, stage

BLOCK = 4096  # fingerprints of a block; a unit of work reads two blocks
TOP_LEVELS = 12  # at most so many levels are walked by Spark
LEAF = 64  # pairs of nodes with at most so many pairs of fingerprints are compared directly
AT_ONCE = 1 << 20  # pairs of fingerprints that a task compares at once
DENSE = 0.1  # when the stretches would leave more than this share of all pairs, blocks are compared without walking
SET_DOCS, SET_SHINGLES = 128, 1 << 18  # documents and shingles of a block whose shingle sets are compared
COLUMNS = 4096  # shingles of a block that are compared at once
COMMON, ONE_IN = 1 << 17, 16  # shingles known as common, found among one in so many of the texts
LONG, SLACK, ERRORS = 192, 12, 2  # bits of a set's fingerprint; in a turn's SLACK bits behind the agreeing ones ERRORS may differ


def fingerprint(text: str | None, shingle: int = 4, wide: bool = False) -> bytes:
    """64 (or 128) bits; a bit is set if it is set in over half of the shingles' hashes. No word: all zero."""
    words = lower_words(text)
    size = 16 if wide else 8
    if not words:
        return bytes(size)
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh3_128_digest if wide else xxhash.xxh64_digest
    set_in = np.zeros(8 * size, np.int64)
    for k in range(0, n, 1 << 16):
        hashes = b"".join([digest(joined[s:e], 42) for s, e in zip(starts[k : k + (1 << 16)], ends[k : k + (1 << 16)], strict=True)])
        set_in += np.add.reduce(np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, size), axis=1), axis=0, dtype=np.uint32)
    return np.packbits(2 * set_in > n).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 4, wide: bool = False) -> DataFrame:
    """(doc_id, w0, w1, fingerprint) for every row of ``docs``; w1 is zero unless ``wide``. Null text: no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows(batches):
            prints = [fingerprint(t, shingle, wide) for t in texts]
            w0 = [int.from_bytes(p[:8], "big", signed=True) for p in prints]
            w1 = [int.from_bytes(p[8:], "big", signed=True) for p in prints]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(w0, pa.int64()), pa.array(w1, pa.int64()), pa.array([p.hex() for p in prints])],
                names=["doc_id", "w0", "w1", "fingerprint"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, w0 long, w1 long, fingerprint string"
    )


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of ``shingle`` words; of a shorter text, its words. No word: none."""
    words = lower_words(text)
    n = max(1, len(words) - shingle + 1) if words else 0
    runs = {b" ".join(words[k : k + shingle]) for k in range(n)}
    return np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, runs), np.uint64, len(runs)))


def set_fingerprint(hashes: np.ndarray) -> list[int]:
    """LONG bits in signed words of 64; a bit is set if it is set in over half of the distinct shingles' hashes."""
    out = []
    for salt in (np.uint64(0x632BE59BD9B4E019), np.uint64(0xD1342543DE82EF95), np.uint64(0x8CB92BA72F3D8DD7)):
        set_in = np.zeros(64, np.int64)
        for k in range(0, len(hashes), 1 << 16):
            bits = np.unpackbits(mixed(hashes[k : k + (1 << 16)] ^ salt).view(np.uint8).reshape(-1, 8), axis=1)
            set_in += np.add.reduce(bits, axis=0, dtype=np.uint32)
        out.append(int.from_bytes(np.packbits(2 * set_in > len(hashes)).tobytes(), "big", signed=True))
    return out


def common_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that many texts have, and how many of a sample of the texts do.

    At most COMMON that three texts of the sample or more hold. Which these are decides what work is saved, not what is found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in rows(batches):
            for t in texts:
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, shingle).view(np.int64))], names=["h"])

    text = F.col("text").cast("string")
    some = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(ONE_IN)) == 0).distinct()
    counted = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "h").limit(COMMON)
    found = counted.toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def needed(n: int, similarity: float) -> int:
    """How many of its ``n`` shingles a set shares at least with any set of this similarity."""
    return math.ceil(similarity * n - 1e-9)


def first_shingles(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The first of a set's shingles, common ones last (the most common at the very end), others by hash.

    There are so many that two sets of this similarity share one of them: all but ``needed`` - 1.
    """
    n = len(hashes)
    wanted = n - needed(n, similarity) + 1 if n else 0
    known, counts = common
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        hashes = hashes[np.argsort(np.where(known[at] == hashes, counts[at], 0), kind="stable")]
    return hashes[:wanted]


def set_prints(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(doc_id, w0, w1, w2, same, n, first): fingerprint, digest, size and first shingles of each row's set of shingles."""
    common = common_shingles(docs, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows(batches):
            sets = [shingles(t, shingle) for t in texts]
            prints = [set_fingerprint(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), *(pa.array([p[k] for p in prints], pa.int64()) for k in (0, 1, 2)),
                    pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([first_shingles(s, common, similarity).view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "w0", "w1", "w2", "same", "n", "first"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, w0 long, w1 long, w2 long, same string, n long, first array<long>"
    )


def stretches(bits: int, budget: int) -> list[tuple[int, int]]:
    """(start, length) of the stretches, none across a 64-bit word; one more than half the budget, so one error is let in.

    One stretch of 64 bits stands for no walk: for a large budget short stretches leave too many pairs, and every pair
    of blocks is compared whole.
    """
    parts, words = budget // 2 + 1, bits // 64
    out = []
    for w in range(words):
        own = parts // words + (w < parts % words)
        cuts = [64 * k // own for k in range(own + 1)] if own else []
        out += [(64 * w + a, b - a) for a, b in zip(cuts, cuts[1:])]
    if sum((1 + length) / 2**length for _, length in out) > DENSE:
        return [(0, 64)]
    return out


def merge(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins the components of ``x[i]`` and ``y[i]``; ``label`` holds each node's least node."""
    while True:
        lx, ly = label[x], label[y]
        apart = lx != ly
        if not apart.any():
            return
        x, y, lx, ly = x[apart], y[apart], lx[apart], ly[apart]
        np.minimum.at(label, np.maximum(lx, ly), np.minimum(lx, ly))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def walk(ka: np.ndarray, kb: np.ndarray, same: bool, bit: int, dist: int, narrow: int, length: int, budget: int, leaf: int = LEAF) -> Iterator[tuple]:
    """Index pairs (i, j), in bulk, of sorted 64-bit keys that may be within the budget.

    Walks both tries from depth ``bit``, where the prefixes differ in ``dist`` bits. ``same``: both are one trie, and a
    pair of nodes is walked once. Nodes with at most ``leaf`` pairs are not walked further.
    """
    one = np.uint64(1)
    front = [np.array([v], np.int64) for v in (0, len(ka), 0, len(kb), dist)]
    while len(front[0]):
        alo, ahi, blo, bhi, d = front
        small = (ahi - alo) * (bhi - blo) <= leaf if bit < 64 else np.ones(len(alo), bool)
        if small.any():
            yield from compared(*(v[small] for v in (alo, ahi, blo, bhi)))
        alo, ahi, blo, bhi, d = (v[~small] for v in front)
        if not len(alo):
            return
        shift = np.uint64(63 - bit)

        def cut(keys, lo, hi):
            """The first place in [lo, hi) whose key has the bit set."""
            first = (keys[lo] >> shift | one) << shift
            return np.clip(np.searchsorted(keys, first), lo, hi)

        am, bm = cut(ka, alo, ahi), cut(kb, blo, bhi)
        sides_a, sides_b = ((alo, am), (am, ahi)), ((blo, bm), (bm, bhi))
        new: list[list[np.ndarray]] = [[], [], [], [], []]
        bit += 1
        most = narrow if bit <= length else budget
        for p in (0, 1):
            for q in (0, 1):
                (al, ah), (bl, bh) = sides_a[p], sides_b[q]
                nd = d + (p != q)
                ok = (ah > al) & (bh > bl) & (nd <= most)
                if same:
                    ok &= al <= bl
                for store, v in zip(new, (al, ah, bl, bh, nd)):
                    store.append(v[ok])
        front = [np.concatenate(v) for v in new]


def compared(alo, ahi, blo, bhi) -> Iterator[tuple]:
    """All index pairs of the ranges, at most about AT_ONCE at a time."""
    na, nb = ahi - alo, bhi - blo
    wide = np.cumsum(na * nb)
    start = 0
    while start < len(alo):
        base = wide[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(wide, base + AT_ONCE, "right")))
        if stop == start + 1 and na[start] * nb[start] > AT_ONCE:
            step = max(1, AT_ONCE // int(nb[start]))
            for i in range(int(alo[start]), int(ahi[start]), step):
                ii = np.arange(i, min(i + step, int(ahi[start])))
                yield np.repeat(ii, int(nb[start])), np.tile(np.arange(blo[start], bhi[start]), len(ii))
        else:
            n, both = nb[start:stop], na[start:stop] * nb[start:stop]
            row = np.repeat(np.arange(stop - start), both)
            k = np.arange(len(row)) - np.repeat(np.cumsum(both) - both, both)
            yield alo[start:stop][row] + k // n[row], blo[start:stop][row] + k % n[row]
        start = stop


def dense(wa: list[np.ndarray], wb: list[np.ndarray], budget: int) -> Iterator[tuple]:
    """Index pairs (i, j) within the budget, by comparing all."""
    step = max(1, AT_ONCE // 16 // max(1, len(wb[0])))
    for i in range(0, len(wa[0]), step):
        d = np.bitwise_count(wa[0][i : i + step, None] ^ wb[0])
        for x, y in zip(wa[1:], wb[1:]):
            d += np.bitwise_count(x[i : i + step, None] ^ y)
        a, b = np.nonzero(d <= budget)
        yield a + i, b


def unit_links(ids_a, wa, ids_b, wb, same: bool, start: int, length: int, depth: int, dist: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (a, b) ids, of the links between two blocks of fingerprints (``wa``: their 64-bit words)."""

    def turned(words):
        w = words[start // 64]
        r = np.uint64(start % 64)
        return (w << r) | (w >> (np.uint64(64) - r)) if r else w

    def ordered(ids, words):
        key = turned(words)
        order = np.argsort(key, kind="stable")
        return ids[order], [w[order] for w in words], key[order]

    ids_a, wa, ka = ordered(ids_a, wa)
    ids_b, wb, kb = (ids_a, wa, ka) if same else ordered(ids_b, wb)
    offset = 0 if same else len(ids_a)
    label = np.arange(offset + len(ids_b))
    for i, j in dense(wa, wb, budget) if length == 64 else walk(ka, kb, same, depth, dist, 1, length, budget):
        if same:
            i, j = i[i < j], j[i < j]
        d = np.bitwise_count(wa[0][i] ^ wb[0][j])
        for x, y in zip(wa[1:], wb[1:]):
            d = d + np.bitwise_count(x[i] ^ y[j])
        ok = d <= budget
        if ok.any():
            merge(label, i[ok], j[ok] + offset)
    ids = ids_a if same else np.concatenate((ids_a, ids_b))
    moved = np.flatnonzero(label != np.arange(len(label)))
    return ids[moved], ids[label[moved]]


def links(prints: DataFrame, budget: int = 4, bits: int = 64, name: str = "simhash") -> DataFrame:
    """Links (a, b) that connect all nodes whose fingerprints differ in at most ``budget`` bits.

    ``prints``: (node long, w0 long, w1 long), a row for each distinct fingerprint. The links span the same components
    as all links within the budget would.
    """
    nodes = prints.count()
    parts = stretches(bits, budget)
    depth = 0 if parts == [(0, 64)] else min(TOP_LEVELS, min(length for _, length in parts), max(0, math.ceil(math.log2(max(1, nodes) / BLOCK))))
    word = [F.col("w0"), F.col("w1")]
    turned = F.array(*[
        F.struct(F.lit(k).alias("part"), (F.shiftrightunsigned(F.shiftleft(word[s // 64], s % 64), 64 - depth) if depth else F.lit(0).cast("long")).alias("at"))
        for k, (s, _) in enumerate(parts)
    ])
    placed = prints.select("node", "w0", "w1", F.inline(turned))
    sizes = stage(placed.groupBy("part", "at").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), f"{name}-nodes")
    block = F.pmod(F.xxhash64("w0", "w1", F.lit(7)), F.col("blocks"))
    blocks = stage(
        placed.join(sizes, ["part", "at"])
        .groupBy("part", "at", block.alias("block"))
        .agg(F.collect_list(F.struct("node", "w0", "w1")).alias("held")),  # a hash's share of a node: about BLOCK rows
        f"{name}-blocks",
    )
    masks = F.array(*[F.lit(m).cast("long") for m in [0, *(1 << k for k in range(depth))]])  # one error at most in a stretch
    here, there = blocks.select("part", "at", "block"), blocks.select("part", F.col("at").alias("to"), F.col("block").alias("to_block"))
    pairs = (
        here.withColumn("mask", F.explode(masks)).withColumn("to", F.col("at").bitwiseXOR(F.col("mask")))
        .join(there, ["part", "to"])
        .where("at < `to` or (at = `to` and block <= to_block)")
        .select("part", "at", "block", "to", "to_block", F.bit_count("mask").alias("dist"))
    )
    other = blocks.select("part", F.col("at").alias("to"), F.col("block").alias("to_block"), F.col("held").alias("held_to"))
    same = (F.col("at") == F.col("to")) & (F.col("block") == F.col("to_block"))
    units = (
        pairs.withColumn("deal", F.xxhash64("part", "at", "block", "to", "to_block"))
        .join(blocks, ["part", "at", "block"]).join(other, ["part", "to", "to_block"])
        .select("part", "dist", "held", "held_to", same.alias("same"))
    )

    def read(cell) -> tuple[np.ndarray, list[np.ndarray]]:
        held = cell.values
        node, w0, w1 = (held.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        return node, [w0.view(np.uint64), w1.view(np.uint64)][: bits // 64]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, dist, held, held_to, is_same = batch.columns
            for k in range(batch.num_rows):
                start, length = parts[part[k].as_py()]
                a, b = unit_links(
                    *read(held[k]), *read(held_to[k]), is_same[k].as_py(), start, length, depth, dist[k].as_py(), budget
                )
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return units.mapInArrow(run, "a long, b long")


def chances(errors: int, bits: int, share: float) -> float:
    """The chance of at most ``errors`` differing bits of ``bits``, each differing with chance ``share``."""
    return sum(math.comb(bits, k) * share**k * (1 - share) ** (bits - k) for k in range(errors + 1))


def plan(nodes: int, similarity: float, missed: float) -> tuple[int, int, int]:
    """(budget, depth, turns) for fingerprints of LONG bits of sets.

    Sets of Jaccard similarity j differ in a bit with chance acos(2j / (1 + j)) / pi. ``budget`` is exceeded by a tenth
    of ``missed`` of such pairs at most. ``depth`` agreeing bits leave blocks of BLOCK fingerprints; enough turns are
    taken for all of them to miss no more than ``missed`` of the pairs.
    """
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    budget = next(b for b in range(LONG + 1) if 1 - chances(b, LONG, share) <= missed / 10)
    depth = min(64 - SLACK, max(0, math.ceil(math.log2(max(1, nodes) / BLOCK))))
    found = [(1 - x / LONG) ** depth * chances(ERRORS, SLACK, x / LONG) for x in range(budget + 1)]  # by a turn, at x differing bits
    weight = [math.comb(LONG, x) * share**x * (1 - share) ** (LONG - x) for x in range(budget + 1)]
    turns = 1
    while sum(w * (1 - f) ** turns for w, f in zip(weight, found)) > missed:
        turns += 1
    return budget, depth, turns


def bit_rows(words: list[np.ndarray]) -> np.ndarray:
    """A row for each bit of the fingerprints."""
    return np.ascontiguousarray(np.unpackbits(np.stack(words, axis=1).astype(">u8").view(np.uint8), axis=1).T)


def turned(bits: np.ndarray, turn: int) -> np.ndarray:
    """64 of the fingerprints' bits in the order of the turn, as keys."""
    order = np.random.default_rng(turn).permutation(len(bits))[:64]
    return np.ascontiguousarray(np.packbits(bits[order], axis=0).T).view(">u8").ravel().astype(np.uint64)


def turn_links(ids_a, wa, ids_b, wb, same: bool, turn: int, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (a, b) ids, of the links within the budget that a turn finds between two blocks, or in one."""

    def ordered(ids, words):
        key = turned(bit_rows(words), turn)
        order = np.argsort(key, kind="stable")
        return ids[order], [w[order] for w in words], key[order]

    ids_a, wa, ka = ordered(ids_a, wa)
    ids_b, wb, kb = (ids_a, wa, ka) if same else ordered(ids_b, wb)
    offset = 0 if same else len(ids_a)
    label = np.arange(offset + len(ids_b))
    for i, j in walk(ka, kb, same, depth, 0, ERRORS, depth + SLACK, 64, leaf=4):
        if same:
            i, j = i[i < j], j[i < j]
        d = np.zeros(len(i), np.uint8)
        for x, y in zip(wa, wb):
            d += np.bitwise_count(x[i] ^ y[j])
        ok = d <= budget
        if ok.any():
            merge(label, i[ok], j[ok] + offset)
    ids = ids_a if same else np.concatenate((ids_a, ids_b))
    moved = np.flatnonzero(label != np.arange(len(label)))
    return ids[moved], ids[label[moved]]


def set_print_links(prints: DataFrame, similarity: float, missed: float) -> DataFrame:
    """Links (a, b) between fingerprints within the budget of ``plan``; they span the components of those that turns find.

    ``prints``: (node, w0, w1, w2), a row for each distinct fingerprint. In a turn, fingerprints with the same first
    ``depth`` bits are a trie's node and compared in blocks of about BLOCK; a larger node has several, and each pair of
    its blocks is a unit of work.
    """
    names = ["w0", "w1", "w2"]
    budget, depth, turns = plan(prints.count(), similarity, missed)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = bit_rows([c.to_numpy().view(np.uint64) for c in batch.columns[1:]])
            for turn in range(turns):
                at = (turned(bits, turn) >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(batch.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), turn), pa.int32()), pa.array(at), *batch.columns], names=["turn", "at", "node", *names]
                )

    def placed() -> DataFrame:
        return prints.select("node", *names).mapInArrow(place, "turn int, at long, node long, w0 long, w1 long, w2 long")

    crowded = stage(
        placed().groupBy("turn", "at").agg(F.ceil(F.count("*") / (2 * BLOCK)).alias("blocks")).where("blocks > 1"), "simhash-crowded"
    )
    block = F.pmod(F.xxhash64(*names, F.lit(7)), F.coalesce("blocks", F.lit(1)))
    blocks = stage(
        placed().join(crowded, ["turn", "at"], "left").groupBy("turn", "at", block.alias("block"))
        .agg(F.collect_list(F.struct("node", *names)).alias("held"), F.first("blocks").alias("blocks")),  # about 2 * BLOCK at most
        "simhash-blocks",
    )
    several = blocks.where("blocks > 1").select("turn", "at", "block", "held")
    other = several.select("turn", "at", F.col("block").alias("to_block"), F.col("held").alias("held_to"))
    units = blocks.where(F.size("held") > 1).select("turn", "held", F.lit(None).cast(blocks.schema["held"].dataType).alias("held_to")).unionByName(
        several.join(other, ["turn", "at"]).where("block < to_block").select("turn", "held", "held_to")
    )

    def read(cell) -> tuple[np.ndarray, list[np.ndarray]]:
        node, *words = (cell.values.field(k).to_numpy(zero_copy_only=False) for k in range(4))
        return node, [w.view(np.uint64) for w in words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turn, held, held_to = batch.columns
            for k in range(batch.num_rows):
                alone = not held_to[k].is_valid
                one = read(held[k])
                a, b = turn_links(*one, *(one if alone else read(held_to[k])), alone, turn[k].as_py(), depth, budget)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return units.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, budget: int = 4, wide: bool = False) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``; the component is the least doc_id reachable.

    Documents are linked when their fingerprints differ in at most ``budget`` bits. ``wide`` takes 128 bits.
    Null, empty and blank texts have fingerprint zero and are linked like others. Repeated rows stay. A row without
    doc_id is returned; its component is that of its fingerprint, null if no row of it has an id. An empty table gives
    an empty result. Other columns of ``docs`` are ignored.
    """
    prints = stage(fingerprints(docs, shingle, wide), "simhash-prints")
    distinct = stage(prints.groupBy("w0", "w1").agg(F.min("doc_id").alias("node")).where("node is not null"), "simhash-distinct")
    found = components(links(distinct, budget, 128 if wide else 64), "simhash")
    named = stage(
        distinct.join(found, "node", "left").select("w0", "w1", F.coalesce("component", "node").alias("component_id")),
        "simhash-named",
    )
    return prints.join(named, ["w0", "w1"], "left").select("doc_id", "fingerprint", "component_id")


def set_links(ids_a: list, a: list[np.ndarray], ids_b: list, b: list[np.ndarray], same: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of sets, of two blocks or one, whose Jaccard similarity is at least ``least``."""
    joined_a, joined_b = np.concatenate(a), np.concatenate(b)
    both = np.unique(joined_a) if same else np.intersect1d(joined_a, joined_b)
    own_a, own_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    order_a, order_b = np.argsort(joined_a, kind="stable"), np.argsort(joined_b, kind="stable")
    sorted_a, sorted_b = joined_a[order_a], joined_b[order_b]
    shared = np.zeros((len(a), len(b)))

    def matrix(part, values, order, own, n):
        lo, hi = np.searchsorted(values, part[0], "left"), np.searchsorted(values, part[-1], "right")
        at = np.searchsorted(part, values[lo:hi])
        known = part[at] == values[lo:hi]
        m = np.zeros((n, len(part)), np.float32)
        m[own[order[lo:hi]][known], at[known]] = 1
        return m

    for k in range(0, len(both), COLUMNS):
        part = both[k : k + COLUMNS]
        m = matrix(part, sorted_a, order_a, own_a, len(a))
        shared += m @ (m if same else matrix(part, sorted_b, order_b, own_b, len(b))).T
    whole = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b]) - shared
    i, j = np.nonzero(shared >= least * whole - 1e-9)
    offset = 0 if same else len(a)
    label = np.arange(offset + len(b))
    merge(label, i, j + offset)
    ids = np.array(ids_a if same else [*ids_a, *ids_b], np.int64)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return ids[moved], ids[label[moved]]


def verified(docs: DataFrame, members: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links (a, b) that connect the nodes of a group whose shingle sets have a Jaccard similarity of ``least`` or more.

    ``members``: (node, same, n, group). Sets of a group are held in blocks of bounded size and every pair of a group's
    blocks is compared; a unit returns a spanning forest.
    """
    sizes = members.groupBy("group").agg(F.count("*").alias("size"), F.sum("n").alias("total")).where("size > 1")
    blocks = F.greatest(F.ceil(F.col("size") / SET_DOCS), F.ceil(F.col("total") / SET_SHINGLES))
    wanted = stage(
        members.join(sizes, "group")
        .select("node", "same", "group", F.pmod(F.xxhash64("node", "same", F.lit(7)), blocks).alias("block")),
        "simhash-wanted",
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, group, block, same in rows(batches):
            sets = [shingles(t, shingle).tobytes() for t in texts]
            ok = [k for k, s in enumerate(sets) if xxhash.xxh3_128_hexdigest(s) == same[k]]  # an id may stand for several texts
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([c[k] for k in ok], pa.int64()) for c in (group, block, ids)), pa.array([sets[k] for k in ok], pa.binary())],
                names=["group", "block", "node", "shingles"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string")).join(wanted, "node")
    held = stage(
        texts.select("node", "text", "group", "block", "same").mapInArrow(read, "group long, block long, node long, shingles binary")
        .groupBy("group", "block").agg(F.collect_set(F.struct("node", "shingles")).alias("held")),
        "simhash-sets",
    )
    here = held.select("group", "block")
    there = held.select("group", F.col("block").alias("to_block"), F.col("held").alias("held_to"))
    pairs = here.join(here.select("group", F.col("block").alias("to_block")), "group").where("block <= to_block")
    units = (
        pairs.join(held, ["group", "block"]).join(there, ["group", "to_block"])
        .select("held", "held_to", (F.col("block") == F.col("to_block")).alias("same"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(cell) -> tuple[list, list[np.ndarray]]:
            node, kept = (cell.values.field(k).to_pylist() for k in (0, 1))
            return node, [np.frombuffer(s, np.uint64) for s in kept]

        for batch in batches:
            held, held_to, same = batch.columns
            for k in range(batch.num_rows):
                a, b = set_links(*sets(held[k]), *sets(held_to[k]), same[k].as_py(), least)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return units.mapInArrow(run, "a long, b long")


def overlooked(docs: DataFrame, prints: DataFrame, named: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links (a, b) between components that hold sets with a Jaccard similarity of ``least`` or more.

    ``prints`` are those of ``set_prints``; ``named``: (same, node, component_id) of each different set. Pairs of sets of different
    components that share one of their first shingles are counted by how many of these they share. The others are at most
    ``needed`` - 1 of a set, so most pairs cannot reach ``least``; the sets of the rest are compared.
    """
    held = prints.select("same", F.col("doc_id").alias("node"), "n", "first").join(named, ["same", "node"])
    of_shingle = Window.partitionBy("h")
    placed = held.select("node", "n", F.col("component_id").alias("part"), F.explode("first").alias("h"))
    met = placed.withColumns({"lo": F.min("part").over(of_shingle), "hi": F.max("part").over(of_shingle)}).where("lo < hi")
    met = stage(met.select("h", "node", "n", "part"), "simhash-met")
    other = met.select("h", F.col("node").alias("to"), F.col("n").alias("to_n"), F.col("part").alias("to_part"))
    low, high = F.least("n", "to_n"), F.greatest("n", "to_n")
    pairs = stage(
        met.join(other, "h").where((F.col("part") < F.col("to_part")) & (low >= least * high - 1e-9))
        .groupBy("node", "n", "part", "to", "to_n", "to_part").agg(F.count("*").alias("n_first"))
        .where(F.col("n_first") + F.ceil(least * high - 1e-9) - 1 >= least / (1 + least) * (F.col("n") + F.col("to_n")) - 1e-6)
        .select("node", "part", "to", "to_part"),
        "simhash-pairs",
    )
    if pairs.isEmpty():
        return pairs.select(F.col("part").alias("a"), F.col("to_part").alias("b"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([shingles(t, shingle).tobytes() for t in texts], pa.binary())], names=["node", "held"])

    wanted = pairs.select(F.explode(F.array("node", "to")).alias("node")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string")).join(wanted, "node", "left_semi")
    sets = stage(texts.mapInArrow(read, "node long, held binary").distinct(), "simhash-compared")
    both = pairs.join(sets, "node").join(sets.select(F.col("node").alias("to"), F.col("held").alias("held_to")), "to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, to_part, held, held_to in rows(batches):
            ok = []
            for k, (x, y) in enumerate(zip(held, held_to, strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common >= least * (len(x) + len(y) - common) - 1e-9:
                    ok.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([c[k] for k in ok], pa.int64()) for c in (part, to_part)], names=["a", "b"])

    return both.select("part", "to_part", "held", "held_to").mapInArrow(run, "a long, b long").distinct()


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, missed: float = 0.001) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs``; the component is the least doc_id reachable.

    Documents are linked when the Jaccard similarity of their sets of ``shingle``-word runs is at least ``similarity``.
    Fingerprints of LONG bits over these sets group what may be linked; within a group the sets themselves are compared.
    Of isolated pairs at exactly ``similarity``, about ``missed`` are found by no turn and a tenth as many have fingerprints
    too far apart (see ``plan``, by the binomial distribution; 1 in 1,000 in a simulation for 256,000 fingerprints, 1 in 570
    for 16 million); of pairs more alike, fewer. These are found by the shingles the sets share (``overlooked``), so no link is lost.

    Texts without words are linked to each other. Null texts, repeated rows, rows without doc_id and empty tables are
    as in ``near_duplicates``.
    """
    words = ["w0", "w1", "w2"]
    prints = stage(set_prints(docs, shingle, similarity), "simhash-prints")
    sets = stage(prints.groupBy(*words, "same", "n").agg(F.min("doc_id").alias("node")).where("node is not null"), "simhash-distinct")
    distinct = stage(sets.groupBy(*words).agg(F.min("node").alias("node")), "simhash-fingerprints")
    with scratch(docs.sparkSession):  # blocks and steps go before the texts move
        near = components(set_print_links(distinct, similarity, missed), "simhash-near")
        named = distinct.join(near, "node", "left").select(*words, F.coalesce("component", "node").alias("group"))
        members = stage(sets.join(named, words).select("node", "same", "n", "group"), "simhash-members", keep=True)
    with scratch(docs.sparkSession):
        found = components(verified(docs, members, shingle, similarity), "simhash")
        part = stage(sets.join(found, "node", "left").select("same", "node", F.coalesce("component", "node").alias("component_id")), "simhash-parts", keep=True)
    with scratch(docs.sparkSession):
        whole = components(overlooked(docs, prints, part, shingle, similarity), "simhash-whole")
        whole = whole.select(F.col("node").alias("component_id"), "component")
        component = part.join(whole, "component_id", "left").select("same", F.coalesce("component", "component_id").alias("component_id"))
        component = stage(component.groupBy("same").agg(F.min("component_id").alias("component_id")), "simhash-named", keep=True)
    return prints.select("doc_id", "same").join(component, "same", "left").select("doc_id", "component_id")
