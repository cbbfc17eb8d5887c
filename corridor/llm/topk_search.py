"""Exact top-k by inner product, pruned by multi-resolution segment statistics.

A vector is cut into equal segments, coarse to fine. With the segments' means and deviations, the squared distance of two vectors is at least the sum over
segments of length * ((difference of means)^2 + (difference of deviations)^2), so their inner product, (|q|^2 + |c|^2 - distance^2) / 2, is at most a bound
that costs two numbers a segment. A pair whose bound at some resolution is below the query's k-th best score so far is out; survivors get exact scores.

There are two passes, whatever the size of the table. The first scores every query against a sample of candidates, those of least hash; the k-th best of them is a score that the
k-th best of all can't be below: the query's bar. The second goes through all candidates with those bars, which rise as better ones are found; so pruning begins with
the first candidate. The sample speeds the search up, it decides nothing: every candidate is either scored or proved to be worse than k others.

Queries and candidates are dealt into blocks of bounded size; each cell of query block and candidate block is a task of its own that returns at most k rows
for a query, and the k best over all cells are kept. Inside a cell, candidates come in tiles. Levels that have lately pruned less than ``WORTH`` of the pairs they saw
are left out for ``REST`` tiles.

Vectors that are null, empty or hold null or non-finite components take no part, nor do null ids; only vectors of a query's own length are its candidates. A repeated
row is a candidate each time; a query given twice with the same vector counts once, and two vectors under one id are two queries. Equal scores go to the smaller id.
Scores are whole numbers and wrap around beyond 64 bits. An empty table gives no rows, a query without candidates none. Other columns are left behind, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corridor.llm.common import drop_written, mark, ship, written

#: The sample is one in SHARE of the candidates, SAMPLE at most.
QUERIES, CANDIDATES, TILE, SAMPLE, SHARE = 4096, 16384, 512, 4096, 8
SEGMENTS, WORTH, REST = (4, 8, 16, 32), 0.05, 7
FOUND = "query_id long, query_key long, vec_id long, score long"


def usable(vector: str) -> F.Column:
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, v: floor(scale * component), components as doubles."""
    own = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("embedding"))
    return own.where(usable("embedding") & F.col("vec_id").isNotNull()).select("vec_id", F.transform("embedding", lambda x: F.floor(x * F.lit(scale).cast("double"))).alias("v"))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each vector's segments, scaled so that squared differences add up to the bound of the squared distance; as numbers of four bytes."""
    wide = np.pad(x.astype(np.float64), ((0, 0), (0, -x.shape[1] % segments)))
    parts = wide.reshape(len(x), segments, -1)
    mean = parts.mean(2)
    deviation = np.sqrt(np.maximum((parts**2).mean(2) - mean**2, 0))
    return (np.hstack([mean, deviation]) * math.sqrt(parts.shape[2])).astype(np.float32)


def bound(x: np.ndarray, y: np.ndarray, squares_x: np.ndarray, squares_y: np.ndarray) -> np.ndarray:
    """What inner products can be at most, with room for the rounding of numbers of four bytes."""
    own = (x * x).sum(1, dtype=np.float64)[:, None] + (y * y).sum(1, dtype=np.float64)
    return (squares_x[:, None] + squares_y - own) / 2 + x @ y.T + 1e-5 * (squares_x[:, None] + squares_y) + 1e-2


def best(q: np.ndarray, query_ids: np.ndarray, bars: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the query, position of the candidate, score) of each query's k best of those of at least its bar. ids ascend, so an earlier position wins ties. seen: takes up how many pairs each level saw and left."""
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < 2**53
    x, y = q.astype(np.float64), c.astype(np.float64)
    squares_x, squares_y = (x * x).sum(1), (y * y).sum(1)
    levels = [s for s in SEGMENTS if s < 2 * q.shape[1]]
    stats_x, stats_y = [statistics(q, s) for s in levels], [statistics(c, s) for s in levels]
    rest = dict.fromkeys(levels, 0)
    rows = pos = score = np.empty(0, np.int64)
    least = bars.astype(np.float64)
    for lo in range(0, len(c), TILE):
        live_q, live_c, alive = np.arange(len(q)), np.arange(lo, min(lo + TILE, len(c))), None
        for s, a, b in zip(levels, stats_x, stats_y, strict=True):
            if rest[s] or not np.isfinite(least).any():
                rest[s] = max(0, rest[s] - 1)
                continue
            ok = bound(a[live_q], b[live_c], squares_x[live_q], squares_y[live_c]) >= least[live_q, None]
            before = ok.size if alive is None else int(alive.sum())
            alive = ok if alive is None else alive & ok
            after = int(alive.sum())
            if seen is not None:
                seen[s] = [m + n for m, n in zip(seen.get(s, [0, 0]), (before, after), strict=True)]
            if before - after < WORTH * before:
                rest[s] = REST
            keep_q, keep_c = alive.any(1), alive.any(0)
            live_q, live_c, alive = live_q[keep_q], live_c[keep_c], alive[np.ix_(keep_q, keep_c)]
            if not after:
                break
        if not len(live_q):
            continue
        if exact and (alive is None or int(alive.sum()) * 8 > alive.size):
            scores = x[live_q] @ y[live_c].T
            i, j = np.nonzero((scores >= least[live_q, None]) if alive is None else alive & (scores >= least[live_q, None]))
            s = scores[i, j].astype(np.int64)
            i, j = live_q[i], live_c[j]
        else:
            i, j = np.nonzero(np.ones((len(live_q), len(live_c)), bool) if alive is None else alive)
            i, j = live_q[i], live_c[j]
            own, others = (x, y) if exact else (q, c)
            s = np.concatenate([np.einsum("ij,ij->i", own[i[t : t + 65536]], others[j[t : t + 65536]]) for t in range(0, len(i), 65536)] or [np.empty(0)]).astype(np.int64)
        # a score that equals the k-th best is no better than k positions before it, but it may equal a bar that others than these k gave
        better = (s >= least[i]) & (query_ids[i] != ids[j])
        rows, pos, score = (np.concatenate(v) for v in ((rows, i[better]), (pos, j[better]), (score, s[better])))
        order = np.lexsort((pos, -score, rows))
        rows, pos, score = rows[order], pos[order], score[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(q)))[rows]
        rows, pos, score, place = (v[place < k] for v in (rows, pos, score, place))
        full = place == k - 1
        least[rows[full]] = np.maximum(least[rows[full]], score[full])
    return rows, pos, score


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def cells(asked: DataFrame, own: DataFrame, blocks_q: int, blocks_c: int, k: int) -> DataFrame:
    """The k best candidates of each query in every cell, in the columns of ``FOUND``. asked: vec_id, v, dim, query_key, bar."""
    dealt = lambda df, n, name, m, other: df.withColumn(name, F.pmod(F.xxhash64("vec_id", "v"), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    left = dealt(asked, blocks_q, "qb", blocks_c, "cb").groupBy("dim", "qb", "cb")
    right = dealt(own, blocks_c, "cb", blocks_q, "qb").groupBy("dim", "qb", "cb")
    ship(own.sparkSession)

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        schema = pa.schema([(n, pa.int64()) for n in ("query_id", "query_key", "vec_id", "score")])
        if not len(a) or not len(b):
            return schema.empty_table()
        b = b.sort_by("vec_id")
        query_ids, ids, keys = a["vec_id"].to_numpy(), b["vec_id"].to_numpy(), a["query_key"].to_numpy()
        bars = a["bar"].to_numpy(zero_copy_only=False).astype(np.float64)
        rows, pos, score = best(matrix(a["v"]), query_ids, np.where(np.isnan(bars), -np.inf, bars), matrix(b["v"]), ids, k)
        return pa.table({"query_id": query_ids[rows], "query_key": keys[rows], "vec_id": ids[pos], "score": score}, schema=schema)

    return left.cogroup(right).applyInArrow(cell, FOUND)


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a condition on vec_id."""
    spark, since = vectors.sparkSession, mark()
    own = written(integers(vectors, scale).withColumn("dim", F.size("v")), "vectors")
    asked = written(own.where(is_query).dropDuplicates(["vec_id", "v"]).withColumn("query_key", F.xxhash64("v")), "queries")
    n = own.count()
    blocks_q, blocks_c = max(1, math.ceil(asked.count() / QUERIES)), max(1, math.ceil(n / CANDIDATES))
    sampled = written(own.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(max(k + 1, min(SAMPLE, n // SHARE))), "sample")
    first = cells(asked.withColumn("bar", F.lit(None).cast("double")), sampled, blocks_q, 1, k)
    bars = first.groupBy("query_id", "query_key").agg(F.min("score").cast("double").alias("bar"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")
    asked = written(asked.join(bars.withColumnRenamed("query_id", "vec_id"), ["vec_id", "query_key"], "left"), "queries")
    found = written(cells(asked, own, blocks_q, blocks_c, k), "found")
    drop_written(spark, since, found)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
