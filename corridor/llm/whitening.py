"""Whitened vectors by a compensated covariance.

Components become whole numbers floor(scale * c). The fit list holds every distinct vector once. Its sums are exact; a vector less the mean is a pair of doubles whose
sum differs from the truth by less than one part in 10^30, its outer product with itself is made by error-free products, and products are added up by error-free
additions, high and low parts apart. Tasks give one pair of triangles each; pairs are merged in groups and then on the driver, again in both parts, so rounding does
not grow with the number of rows or tasks. The covariance is then reduced to tridiagonal form and solved by divide and conquer (LAPACK's syevd, which numpy calls).

A row's deviation is exact at any size; one beyond 64 bits is null. Vectors that are null, empty or hold null or non-finite components take no part. The commonest
length, of equally common ones the smallest, sets the dimension; vectors of other lengths take no part. Null ids keep their rows, repeated rows each get theirs;
they count once in the fit list. Components whose eigenvalue is not above 1e-13 of the trace, where doubles hold nothing but rounding, have no direction and are left out, so a table of
equal vectors and an empty one give no rows. Other columns are left behind, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor.llm.common import drop_written, map_arrow, mark, written
from corridor.llm.topk_search import matrix, usable

#: Groups that tasks' triangles are merged in before the driver adds up one from each.
GROUPS, STRIP = 64, 256
NO_DIRECTION = 1e-13


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b without error: the rounded sum and what rounding took away."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers of 26 bits each whose sum is a."""
    c = a * 134217729.0
    high = c - (c - a)
    return high, a - high


def two_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a * b without error."""
    p = a * b
    (ah, al), (bh, bl) = halves(a), halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def added(high: np.ndarray, low: np.ndarray, more: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of two pairs, as a pair whose low part is below the high part's last place."""
    s, e = two_sum(high, more)
    t, f = two_sum(low, rest)
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def total(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum along the first axis, by halving."""
    while len(high) > 1:
        if len(high) % 2:
            high, low = (np.concatenate([v, np.zeros_like(v[:1])]) for v in (high, low))
        high, low = added(high[::2], low[::2], high[1::2], low[1::2])
    return high[0], low[0]


def centred(x: np.ndarray, sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """x - S / n as pairs. x: whole numbers."""
    mean = np.array([s / n for s in sums])  # correctly rounded, of whole numbers of any size
    rest = np.array([float(Fraction(s, n) - Fraction(m)) for s, m in zip(sums, mean.tolist(), strict=True)])
    big = x.astype(np.float64)
    high, low = two_sum(big, -mean)
    return two_sum(high, low + ((x - big.astype(np.int64)).astype(np.float64) - rest))


def outer(high: np.ndarray, low: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the rows' outer products, at the places ``at``."""
    i, j = at
    p, e = two_product(high[:, i], high[:, j])
    return total(*two_sum(p, e + (high[:, i] * low[:, j] + low[:, i] * high[:, j])))


def covariance(fit: DataFrame, dim: int, sums: list[int], n: int) -> np.ndarray:
    """Of the column x of distinct vectors, divisor n."""
    at = np.triu_indices(dim)
    strip = max(1, STRIP * 64 // dim // max(1, dim // 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, some = np.zeros(len(at[0])), np.zeros(len(at[0])), False
        for b in batches:
            x = matrix(pa.chunked_array([b["x"]]))
            for k in range(0, len(b), strip):
                high, low = added(high, low, *outer(*centred(x[k : k + strip], sums, n), at))
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([high.tolist()]), pa.array([low.tolist()])], ["high", "low"])

    def merge(group: pa.Table) -> pa.Table:
        high, low = total(matrix(group["high"]), matrix(group["low"]))
        return pa.table({"high": [high.tolist()], "low": [low.tolist()]})

    each = map_arrow(fit.select("x"), run, "high array<double>, low array<double>").withColumn("g", F.spark_partition_id() % GROUPS)
    merged = each.groupBy("g").applyInArrow(lambda t: merge(t.select(["high", "low"])), "high array<double>, low array<double>").collect()  # GROUPS triangles at most
    high, low = total(np.array([r.high for r in merged]), np.array([r.low for r in merged]))
    out = np.zeros((dim, dim))
    out[at] = (high + low) / n
    return out + np.triu(out, 1).T


def whitened(vectors: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row of vec_id, embedding."""
    spark, since = vectors.sparkSession, mark()
    own = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("e")).where(usable("e"))
    own = written(own.select("vec_id", F.transform("e", lambda c: F.floor(c * F.lit(scale).cast("double"))).alias("x")), "numbers")
    lengths = own.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = lengths[0].dim if lengths else 1
    own = own.where(F.size("x") == dim)
    fit = written(own.select("x").distinct(), "fit")
    n = fit.count()
    sums = [0] * dim
    for r in fit.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect():  # a row for each dimension
        sums[r.k] = int(r.s)
    values, turn = np.zeros(0), np.zeros((dim, 0))
    if n > 1:
        values, turn = np.linalg.eigh(covariance(fit, dim, sums, n))
        trace = float(values.sum())
        chosen = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > NO_DIRECTION * trace]
        values, turn = values[chosen], turn[:, chosen]
        turn = turn / np.sqrt((turn * turn).sum(0)) / np.sqrt(values)
    wide = len(values)

    def projected(x: np.ndarray) -> np.ndarray:
        high, low = centred(x, sums, n)
        return high @ turn + low @ turn

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros((wide, wide)), np.zeros((wide, wide))
        for b in batches:
            if len(b):
                w = projected(matrix(pa.chunked_array([b["x"]])))
                high, low = added(high, low, *total(*two_product(w[:, :, None], w[:, None, :])))
        yield pa.RecordBatch.from_arrays([*(pa.array(g.ravel().astype(np.int32)) for g in np.indices((wide, wide))), pa.array(high.ravel()), pa.array(low.ravel())], ["i", "j", "high", "low"])

    error = 0.0
    if wide:
        found = map_arrow(fit, products, "i int, j int, high double, low double").groupBy("i", "j").agg((F.sum("high") + F.sum("low")).alias("s")).collect()  # components squared
        error = max(abs(r.s / n - (r.i == r.j)) for r in found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b) or not wide:
                continue
            x = matrix(pa.chunked_array([b["x"]]))
            w, count = projected(x), len(b)
            yield pa.RecordBatch.from_arrays([
                b["vec_id"].take(pa.array(np.repeat(np.arange(count), wide))), pa.array(np.tile(np.arange(1, wide + 1, dtype=np.int32), count)), pa.array(np.full(count * wide, n)),
                pa.array([d for d in deviations(x, sums, n) for _ in range(wide)], pa.int64()), pa.array(w.ravel()), pa.array(np.tile(values / trace, count)), pa.array(np.full(count * wide, error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = written(map_arrow(own, run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"), "whitened")
    drop_written(spark, since, out)
    return out


def deviations(x: np.ndarray, sums: list[int], n: int) -> list[int | None]:
    """The sum over dimensions of (n * x - S)^2, exactly; None beyond 64 bits."""
    most = n * int(max(-int(x.min(initial=0)), int(x.max(initial=0)))) + max((abs(s) for s in sums), default=0)
    if most * most * max(1, x.shape[1]) < 2**63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    own = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [d if d < 2**63 else None for d in own]
