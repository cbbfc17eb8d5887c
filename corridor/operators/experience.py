"""Nearest experiences by exact search in blocks with bounds.

A memory's three keys, each times the root of its factor, are one vector; confidence falls with the squared distance of two such vectors. A few memories are pivots, every
memory belongs to its nearest one, and a block is a pivot with the least and the greatest distance of its members. By the triangle inequality a query at distance d of the
pivot can't be nearer to a member than d - greatest or least - d. A query first goes to the blocks of the best bounds that have k members besides its own; the k-th best
confidence there is its bar. Then it goes to the other blocks whose bound reaches the bar, ties included. Blocks beyond can't hold any of its k best.

In a block, all queries that came there meet its memories at once: a product of matrices bounds the distances from below, and only what reaches a query's bar, or the k-th
distance in the block, is measured term by term. So a pair costs a few nanoseconds where bounds of blocks spare nothing. Of copies at one distance the k smallest ords stay.

Confidences too small for a double are zero, and so is a query's own memory; those rank by ord alone. As the k smallest ords of all hold every such memory that can be
among the k best, they are candidates of every query, and no block is searched for zeros.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridor.functions.workers import shipped

#: Rows a block has about, pivots at most (a matrix of their vectors goes to every task), queries that meet a block at once, and pairs whose bounds a task holds at once.
BLOCK, PIVOTS, QUERIES, TILE = 4096, 1024, 65536, 1 << 20
#: Room for rounding in distances that were computed in another order.
ROOM = 1e-9
#: The confidence of a squared distance beyond is zero.
ZERO = 746.0


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def joined() -> Column:
    """One vector of all keys; null if a key is null or holds a null."""
    whole = F.concat("k1", "k2", "k3")
    return F.when(~F.exists(whole, lambda x: x.isNull() | F.isnan(x)), whole)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def mixed(ids: np.ndarray) -> np.ndarray:
    """Numbers that deal ids out."""
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", over="ignore"):
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * (x @ pivots.T), 0))


def dealt_to(rows: DataFrame, pivots: np.ndarray, roots: np.ndarray, cuts: np.ndarray | None = None) -> DataFrame:
    """Of rows of ord, v the nearest pivot and how far it is (_p, _r); with cuts, how many parts each pivot's block has, their place instead: ord, v, _p, _part."""
    last, kind = ("_r", "double") if cuts is None else ("_part", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b["v"], len(roots)) * roots
            near = distances(x, pivots).argmin(1)
            with np.errstate(invalid="ignore", over="ignore"):
                what = np.sqrt(((x - pivots[near]) ** 2).sum(1)) if cuts is None else mixed(b["ord"].to_numpy()) % cuts[near]
            yield pa.RecordBatch.from_arrays([b["ord"], b["v"], pa.array(near.astype(np.int32)), pa.array(what)], ["ord", "v", "_p", last])

    return shipped(rows).mapInArrow(run, f"ord long, v array<double>, _p int, {last} {kind}")


def in_order(x: np.ndarray, pivots: np.ndarray, blocks: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(blocks [queries, blocks] by their bounds, these bounds, how many of them come first: those that hold k members besides the query's own). blocks: pivot, least, greatest, members, parts."""
    p, lo, hi, n = blocks[:, 0].astype(np.int64), blocks[:, 1], blocks[:, 2], blocks[:, 3]
    d = distances(x, pivots)[:, p]
    with np.errstate(invalid="ignore"):
        bound = np.maximum(np.maximum(d * (1 - ROOM) - hi * (1 + ROOM), lo * (1 - ROOM) - d * (1 + ROOM)), 0)
    order = np.lexsort((np.broadcast_to(p, d.shape), d, bound), axis=-1)
    enough = n[order].cumsum(1) > k
    return order, np.take_along_axis(bound, order, 1), np.where(enough.any(1), enough.argmax(1) + 1, len(p)) if len(p) else np.zeros(len(x), np.int64)


def visits(asked: DataFrame, pivots: np.ndarray, roots: np.ndarray, blocks: np.ndarray, k: int, deals: int, later: bool, counts: bool = False) -> DataFrame:
    """query, v, away, _p, _part, _deal: the blocks that queries (query, v; later also their bars, confidence and squared distance away) go to first, or later; counts: query, blocks, visited instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            query, v = b["query"].to_numpy(), b["v"]
            for at in range(0, len(query), 1024):
                own, x = query[at : at + 1024], matrix(v.slice(at, 1024), len(roots)) * roots
                order, bound, first = in_order(x, pivots, blocks, k)
                rank = np.arange(len(blocks))
                go = rank < first[:, None]
                away = np.full(len(own), np.nan)
                if later:
                    bar, away = (b[c].to_numpy(zero_copy_only=False)[at : at + 1024].astype(float) for c in ("bar", "away"))
                    with np.errstate(invalid="ignore", over="ignore"):
                        reaches = np.exp(-(bound**2) * (1 - ROOM)) * (1 + ROOM)
                    go = ~go & ~(reaches <= 0) & ~(reaches < bar[:, None])
                if counts:
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), len(blocks), np.int32)), pa.array((first + go.sum(1)).astype(np.int64))], ["query", "blocks", "visited"])
                    continue
                i, j = np.nonzero(go)
                block = blocks[order[i, j]]
                n = block[:, 4].astype(np.int64)  # a block of many copies is several tasks' work
                part = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
                i, p = np.repeat(i, n), np.repeat(block[:, 0], n).astype(np.int32)
                deal = mixed(own)[i] % deals
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), v.slice(at, 1024).take(pa.array(i)), pa.array(away[i]), pa.array(p), pa.array(part), pa.array(deal)], ["query", "v", "away", "_p", "_part", "_deal"])

    return shipped(asked).mapInArrow(run, "query long, blocks int, visited long" if counts else "query long, v array<double>, away double, _p int, _part long, _deal long")


def margin(away: np.ndarray) -> np.ndarray:
    """How much farther a memory may be and still have the same confidence: a few roundings, and more where confidences are the least that doubles have."""
    return 1e-14 * (1 + away) + 2 * np.exp(np.minimum(away, ZERO) - 744.44)


def measured(q: np.ndarray, c: np.ndarray, sizes: tuple[int, ...], factors: tuple[float, ...]) -> np.ndarray:
    """Squared distances of rows, key by key and term by term, so that they are the doubles that ``squared`` gives."""
    away, at = np.zeros(len(q)), 0
    with np.errstate(invalid="ignore", over="ignore"):
        for size, w in zip(sizes, factors, strict=True):
            part = np.zeros(len(q))
            for k in range(at, at + size):
                part = part + (q[:, k] - c[:, k]) * (q[:, k] - c[:, k])
            away, at = away + w * part, at + size
    return away


def nearest(query: np.ndarray, q: np.ndarray, bar: np.ndarray, ord_: np.ndarray, c: np.ndarray, k: int, sizes: tuple[int, ...], factors: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the query, position of the memory, squared distance) of all that can be among a query's k best, the query's own memory apart. ord_ ascends; bar: a squared distance that k memories have at most, NaN if unknown."""
    roots = np.sqrt(np.repeat(factors, sizes))
    _, copy = np.unique(np.ascontiguousarray(c).view(np.dtype((np.void, c.itemsize * c.shape[1]))).ravel(), return_inverse=True) if c.shape[1] else (None, np.zeros(len(c), np.int64))
    by = np.argsort(copy, kind="stable")
    turn = np.arange(len(by)) - np.searchsorted(copy[by], copy[by])
    kept = np.sort(by[turn <= k])  # of copies the k smallest ords, and one more, as the query's own may be among them
    ord_, c = ord_[kept], c[kept]
    x, y = q * roots, c * roots
    with np.errstate(over="ignore"):
        own, others = (x * x).sum(1) * (1 - 1e-12), (y * y).sum(1) * (1 - 1e-12)
    lo, hi = np.searchsorted(ord_, query), np.searchsorted(ord_, query, "right")
    found, step = [], max(1, TILE // max(1, len(c)))
    for at in range(0, len(q), step):
        rows = slice(at, at + step)
        with np.errstate(invalid="ignore", over="ignore"):
            least = own[rows, None] + others - 2 * (x[rows] @ y.T)  # at most the squared distance
        for n in range(int((hi[rows] - lo[rows]).max(initial=0))):
            has = np.flatnonzero(lo[rows] + n < hi[rows])
            least[has, lo[rows][has] + n] = np.inf
        limit = np.where(np.isnan(bar[rows]), ZERO, np.minimum(bar[rows], ZERO))
        unknown = np.flatnonzero(np.isnan(bar[rows]))
        if len(c) > k and len(unknown):
            near = np.argpartition(least[unknown], k - 1, axis=1)[:, :k]
            i = np.repeat(unknown, k)
            away = measured(q[rows][i], c[near.ravel()], sizes, factors).reshape(-1, k)
            away = np.where(ord_[near] == query[rows][unknown, None], np.inf, away).max(1)
            limit[unknown] = np.fmin(limit[unknown], away)  # NaN says nothing
        limit = np.minimum(limit + margin(limit), ZERO)
        i, j = np.nonzero(~(least > limit[:, None]))
        away = np.concatenate([measured(q[rows][i[t : t + 65536]], c[j[t : t + 65536]], sizes, factors) for t in range(0, len(i), 65536)] or [np.empty(0)])
        fits = ~(away > limit[i]) & (ord_[j] != query[rows][i])
        i, j, away = i[fits], j[fits], away[fits]
        order = np.lexsort((j, away, i))
        i, j, away = i[order], j[order], away[order]
        start = np.searchsorted(i, i)
        last = start + k - 1
        kth = np.where((last < len(i)) & (i[np.minimum(last, len(i) - 1)] == i), away[np.minimum(last, len(i) - 1)], np.inf) if len(i) else away
        same = np.r_[False, (i[1:] == i[:-1]) & ((away[1:] == away[:-1]) | (np.isnan(away[1:]) & np.isnan(away[:-1])))][: len(i)]
        turn = np.arange(len(i)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(i)))) if len(i) else i
        fits = (turn < k) & ~(away > kth + margin(kth))
        found.append((i[fits] + at, kept[j[fits]], away[fits]))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def met(going: DataFrame, dealt: DataFrame, k: int, sizes: tuple[int, ...], factors: tuple[float, ...]) -> DataFrame:
    """query, ord, away: what can be among a query's k best of the blocks it goes to."""
    schema = pa.schema([("query", pa.int64()), ("ord", pa.int64()), ("away", pa.float64())])

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return schema.empty_table()
        b = b.sort_by("ord")
        query, ord_ = a["query"].to_numpy(), b["ord"].to_numpy()
        i, j, away = nearest(query, matrix(a["v"], sum(sizes)), a["away"].to_numpy(), ord_, matrix(b["v"], sum(sizes)), k, sizes, factors)
        return pa.table({"query": query[i], "ord": ord_[j], "away": away}, schema=schema)

    keys = ("_p", "_part", "_deal")
    return shipped(going).groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(cell, "query long, ord long, away double")


def searched(memory: DataFrame, queries: DataFrame, k: int = 3, factors: tuple[float, ...] = (1.0, 10.0, 1.0)) -> tuple[DataFrame, DataFrame]:
    """(the k best of each query as query, ord, confidence, place; query, blocks, visited: how many blocks there are and how many it went to)."""
    size = F.array(*[F.size(f"k{i}") for i in range(1, len(factors) + 1)])
    own, asked = (rows.select(F.col("ord").cast("long").alias("ord"), joined().alias("v"), size.alias("_s")).where("v IS NOT NULL AND ord IS NOT NULL") for rows in (memory, queries))
    n = own.count()
    picks = own.orderBy(F.xxhash64("ord"), "ord").limit(min(PIVOTS, max(1, n // BLOCK))).select("v", "_s").collect()
    sizes = Counter(tuple(r["_s"]) for r in picks).most_common(1)[0][0] if picks else (0,) * len(factors)
    roots = np.sqrt(np.repeat(np.array(factors), sizes))
    pivots = np.array([r["v"] for r in picks if tuple(r["_s"]) == sizes] or [[]], float) * roots
    alike = F.col("_s") == F.array(*[F.lit(v) for v in sizes])
    own, asked = own.where(alike).select("ord", "v"), asked.where(alike).select(F.col("ord").alias("query"), "v")
    table = dealt_to(own, pivots, roots).groupBy("_p").agg(F.min("_r"), F.max("_r"), F.count("*").alias("n")).orderBy("_p").collect()  # PIVOTS at most
    blocks = np.array([(*r, math.ceil(r["n"] / (8 * BLOCK))) for r in table], float).reshape(-1, 5)
    cuts = np.ones(len(pivots), np.int64)
    cuts[blocks[:, 0].astype(int)] = blocks[:, 4]
    deals = max(1, math.ceil(asked.count() / QUERIES))
    dealt = dealt_to(own, pivots, roots, cuts).withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))))

    def going(rows: DataFrame, later: bool, counts: bool = False) -> DataFrame:
        return visits(rows, pivots, roots, blocks, k, deals, later, counts)

    confidence = F.exp(-F.col("away")).alias("confidence")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("confidence"), "ord"))
    first = met(going(asked, False), dealt, k, sizes, factors).select("query", "ord", "away", confidence).withColumn("place", place).where(F.col("place") <= k).drop("place")
    full = F.count("*") >= k
    bars = first.groupBy("query").agg(F.when(full, F.min("confidence")).otherwise(0.0).alias("bar"), F.when(full, F.max("away")).alias("away"))
    again = asked.join(bars, "query", "left").withColumn("bar", F.coalesce("bar", F.lit(0.0)))
    later = met(going(again, True), dealt, k, sizes, factors).select("query", "ord", confidence)
    starts = [1 + sum(sizes[:i]) for i in range(len(sizes))]
    parts = [F.lit(w) * squared(F.slice("v", at, size), F.slice("q", at, size)) for w, at, size in zip(factors, starts, sizes, strict=True)]
    least = asked.select("query", F.col("v").alias("q")).join(F.broadcast(own.orderBy("ord").limit(k)))  # k rows
    zeros = least.select("query", "ord", F.when(F.col("query") == F.col("ord"), 0.0).otherwise(F.exp(-sum(parts, F.lit(0.0)))).alias("confidence"))
    found = first.drop("away").unionByName(later).unionByName(zeros).distinct().withColumn("place", place).where(F.col("place") <= k)
    return found, going(again, True, True)


def nearest_experiences(memory: DataFrame, queries: DataFrame, k: int = 3, factors: tuple[float, ...] = (1.0, 10.0, 1.0)) -> DataFrame:
    """query, ord, confidence, place: the k memories of highest exp(-sum factor * squared distance); a query's own memory has confidence 0, ties go to the smaller ord.

    Both have ord (long, each once), k1, k2, k3. Memories and queries with a null ord, or with nulls or NaN in a key, take no part; nor do those of other dimensions than most pivots have.
    """
    return searched(memory, queries, k, factors)[0]
