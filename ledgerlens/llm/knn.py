"""Exact top-k search by inner product: a Voronoi kNN join.

Rows fall into the cells of pivots. Summaries of cells (sizes, radii, norms) bound the inner products between a group
of queries, which are queries around one pivot, and every cell: ``q.x`` is within ``q.p`` plus or minus ``|q| * radius``.
A cell is sent to a group only if its upper bound reaches the score that the lower bounds already promise for ``k``
rows. Cells and groups are cut into blocks, so that a unit of work holds two blocks of bounded size however many rows
a pivot draws; a unit is one matrix product and gives the best ``k`` of its block for each query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import stage

LEAST, MOST = 1024, 1 << 16  # rows of a block
SHARES = 64  # a block holds about 1 / 64 of the rows, between these bounds
PIVOTS = 1024  # at most


def integers(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v) with ``v`` = floor(scale * x) of each component; rows with a null or not finite part are left out."""
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(sound).select(
        F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c * scale)).alias("v")
    )


def matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, d)


def product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where all sums are exact, else in 64-bit integers."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if largest < 2**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.T.astype(np.int64)


def placed(vectors: DataFrame, pivots: list[list[int]]) -> DataFrame:
    """(vec_id, v, d, cell, radius, norm): the nearest pivot of the same length (ties: the first), else the origin (-1)."""

    def run(batches):
        by_d: dict[int, list[int]] = {}
        for k, p in enumerate(pivots):
            by_d.setdefault(len(p), []).append(k)
        for batch in batches:
            ids, values = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            sizes = np.array([len(v) for v in values])
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                own = values.take(pa.array(at))
                x = matrix(own, d) if d else np.zeros((len(at), 0))
                norm = np.sqrt((x * x).sum(axis=1))
                cell, radius = np.full(len(at), -1), norm
                if known := by_d.get(d):
                    p = np.array([pivots[k] for k in known], np.float64).reshape(len(known), d)
                    square = (norm**2)[:, None] - 2 * x @ p.T + (p * p).sum(axis=1)
                    near = square.argmin(axis=1)
                    cell = np.array(known)[near]
                    radius = np.sqrt(((x - p[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at]), own, pa.array(np.full(len(at), d), pa.int32()), pa.array(cell, pa.int32()), pa.array(radius), pa.array(norm)],
                    names=["vec_id", "v", "d", "cell", "radius", "norm"],
                )

    return vectors.mapInArrow(run, "vec_id long, v array<long>, d int, cell int, radius double, norm double")


def needed(data: list, groups: list, pivots: list[list[int]], k: int) -> list[tuple[int, int, int]]:
    """(d, group, cell) of the cells that may hold one of a query's ``k`` best.

    ``data``: rows (d, cell, n, radius); ``groups``: rows (d, cell, norm, radius), the queries around a pivot.
    """
    def place(r):
        return np.array(pivots[r.cell], np.float64) if r.cell >= 0 else np.zeros(r.d)

    out = []
    for g in groups:
        cells = [c for c in data if c.d == g.d]
        x = np.stack([place(c) for c in cells])
        centre = x @ place(g)
        slack = g.radius * np.sqrt((x * x).sum(axis=1)) + g.norm * np.array([c.radius for c in cells]) + 1e-6
        order = np.argsort(-(centre - slack), kind="stable")
        have = np.cumsum([cells[i].n for i in order])
        enough = int(np.searchsorted(have, k + 1))  # one more, as a query may be in a cell itself
        least = (centre - slack)[order[enough]] if enough < len(order) else -np.inf
        out += [(g.d, g.cell, c.cell) for c, most in zip(cells, centre + slack) if most >= least]
    return out


def block_size(n: int) -> int:
    return min(MOST, max(LEAST, n // SHARES))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` with the largest inner product for each query.

    ``vectors``, ``queries``: (vec_id, v array<long>). Rows of the query's own vec_id, and of another length, are no
    candidates. Ties go to the smaller vec_id; fewer candidates give fewer ranks. Equal vectors under different ids are
    different candidates. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    n = vectors.count()
    firsts = vectors.groupBy(F.xxhash64("v").alias("h")).agg(F.first("v").alias("v")).orderBy("h")
    pivots = [r.v for r in firsts.limit(min(PIVOTS, max(1, n // block_size(n)))).collect()]
    data = stage(placed(vectors, pivots), "knn-data")
    asked = queries.count()
    # Few queries make few groups, so that a cell is not sent to many groups of a handful of queries.
    coarse = pivots[: max(1, asked // block_size(asked))]
    ask = stage(placed(queries, coarse), "knn-queries")
    cells = data.groupBy("d", "cell").agg(F.count("*").alias("n"), F.max("radius").alias("radius")).collect()  # a row per pivot
    groups = ask.groupBy("d", "cell").agg(F.count("*").alias("n"), F.max("radius").alias("radius"), F.max("norm").alias("norm")).collect()
    pairs = needed(cells, [g for g in groups if any(c.d == g.d for c in cells)], pivots, k)
    cut = {(c.d, c.cell): -(-c.n // block_size(n)) for c in cells}
    cut_q = {(g.d, g.cell): -(-g.n // block_size(asked)) for g in groups}
    plan = spark.createDataFrame(
        [(d, g, c, cut_q[d, g], cut[d, c]) for d, g, c in pairs], "d int, g int, cell int, q_blocks int, blocks int"
    )
    unit = ["d", "g", "cell", "q_block", "block"]
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    dealt = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.col(blocks)).cast("int")
    sent = data.join(plan, ["d", "cell"]).select("d", "g", "cell", every("q_blocks").alias("q_block"), dealt("blocks").alias("block"), "vec_id", "v")
    put = ask.withColumnRenamed("cell", "g").join(plan, ["d", "g"]).select(
        "d", "g", "cell", dealt("q_blocks").alias("q_block"), every("blocks").alias("block"), "vec_id", "v"
    )

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        if not len(q) or not len(x):
            return none
        x = x.sort_values("vec_id", kind="stable")
        xs, xv = x["vec_id"].to_numpy(), np.stack(x["v"].to_numpy()).astype(np.float64)
        qs, qv = q["vec_id"].to_numpy(), np.stack(q["v"].to_numpy()).astype(np.float64)
        parts = [none]
        step = max(1, (1 << 22) // len(xs))
        for i in range(0, len(qs), step):
            score = product(qv[i : i + step], xv)
            score[qs[i : i + step, None] == xs[None, :]] = np.iinfo(np.int64).min
            kth = np.partition(score, -min(k, len(xs)), axis=1)[:, -min(k, len(xs))]
            row, col = np.nonzero((score >= kth[:, None]) & (score > np.iinfo(np.int64).min))
            value = score[row, col]
            order = np.lexsort((col, -value, row))  # columns are in the order of vec_id
            row, col, value = row[order], col[order], value[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, col, value = row[place < k], col[place < k], value[place < k]
            parts.append(pd.DataFrame({"query_id": qs[i : i + step][row], "vec_id": xs[col], "score": value}))
        return pd.concat(parts, ignore_index=True)

    best = put.groupBy(*unit).cogroup(sent.groupBy(*unit)).applyInPandas(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
