"""Vector codes by Lloyd's method with Hamerly's bounds, in whole numbers.

Components become floor(scale * x); vectors are cut into equal consecutive parts, and each part position has a codebook of its own. For every part the state table
keeps its entry, an upper bound of the distance to that entry and one lower bound of the distance to all others. When entries have moved, bounds move with them. A
part whose upper bound is strictly below its lower bound, or below half the distance from its entry to the nearest other one, keeps its entry: that entry is nearer
than every other, so no tie is hidden. Where that fails, the upper bound is made exact and tried again; where it fails strictly again, all entries are scanned in
whole numbers, and of equal distances the lower index wins. Bounds are rounded away from the truth, so rounding can only cause scans.

A round is two passes over the written state: new entries and bounds, then sums. A task gives one row for each component of each entry, these are added up by Spark,
and the driver gets the codebook alone. The state of the round before stays until the next one is written.

Vectors that are null, empty or hold null or non-finite components take no part, nor do null ids. The vector of the smallest id whose length is a multiple of the
number of parts sets the length; vectors of other lengths take no part. Ties of ids are ordered by components; a repeated row counts each time and gets a row each time.
With fewer vectors than entries, codebooks have as many entries as there are vectors; an empty table gives no rows. Whole numbers wrap around beyond 64 bits.
Other columns are left behind, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor.llm.common import drop_written, even_join, map_arrow, mark, written
from corridor.llm.topk_search import matrix, usable

#: Labels whose sums are broadcast, counted first; beyond, they are joined by key.
FEW_LABELS = 100_000
ROOM = 1e-12
STATE = "vec_id long, label string, v array<long>, entry array<int>, upper array<double>, lower array<double>, scans int"
SUMS = "part int, entry int, place int, total long, n long"


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    reach = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 0 <= reach < 2**24 and 4 * reach * reach * x.shape[1] < 2**53:  # doubles hold every whole number on the way
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], 1)


def scanned(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each row, the lower index of equal ones; upper and lower bound."""
    d = distances(x, entries)
    near = d.argmin(1)
    least = d[np.arange(len(x)), near].astype(np.float64)
    others = np.sort(d, 1)[:, 1].astype(np.float64) if len(entries) > 1 else np.full(len(x), np.inf)
    return near, np.sqrt(least) * (1 + ROOM), np.sqrt(others) * (1 - ROOM)


def moved(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    """How far each entry has moved at most."""
    return np.sqrt(((now - before).astype(np.float64) ** 2).sum(1)) * (1 + ROOM)


def apart(entries: np.ndarray) -> np.ndarray:
    """At most half the distance from each entry to the nearest other one."""
    d = distances(entries, entries).astype(np.float64)
    np.fill_diagonal(d, np.inf)
    return np.sqrt(d.min(1)) / 2 * (1 - ROOM)


def assigned(x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, before: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entry, upper, lower, whether scanned) of each row, given those by the entries before."""
    by = moved(before, entries)
    most = int(by.argmax())
    rest = np.where(near == most, np.delete(by, most).max(initial=0.0), by[most])
    upper, lower = (upper + by[near]) * (1 + ROOM), lower - rest
    lower = lower - np.abs(lower) * ROOM
    bar = np.maximum(lower, apart(entries)[near])
    near, fails = near.copy(), np.flatnonzero(~(upper < bar))
    if len(fails):
        own = ((x[fails] - entries[near[fails]]) ** 2).sum(1).astype(np.float64)
        upper[fails] = np.sqrt(own) * (1 + ROOM)
        fails = fails[~(upper[fails] < bar[fails])]
        near[fails], upper[fails], lower[fails] = scanned(x[fails], entries)
    hit = np.zeros(len(x), bool)
    hit[fails] = True
    return near, upper, lower, hit


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel(), kind), values.shape[1]).cast(pa.list_(kind))


def assign(state: DataFrame, before: np.ndarray | None, books: np.ndarray) -> DataFrame:
    """The state with entries and bounds by ``books`` [part, entry, place]; before: the books that its bounds are of, None for a state without bounds."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = matrix(pa.chunked_array([b["v"]])).reshape(len(b), parts, -1)
            near, scans = np.zeros((len(b), parts), np.int32), np.zeros(len(b), np.int32)
            upper, lower = np.zeros((len(b), parts)), np.zeros((len(b), parts))
            old = [matrix(pa.chunked_array([b[c]])) for c in ("entry", "upper", "lower")] if before is not None else None
            for p in range(parts):
                if old is None:
                    near[:, p], upper[:, p], lower[:, p] = scanned(x[:, p], books[p])
                    scans += 1
                else:
                    near[:, p], upper[:, p], lower[:, p], hit = assigned(x[:, p], *(o[:, p] for o in old), before[p], books[p])
                    scans += hit
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], b["v"], lists(near, pa.int32()), lists(upper, pa.float64()), lists(lower, pa.float64()), pa.array(scans)], ["vec_id", "label", "v", "entry", "upper", "lower", "scans"])

    return map_arrow(state, run, STATE)


def updated(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry's parts, componentwise floor(sum / count); unused entries stay."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            if len(b):
                x, near = matrix(pa.chunked_array([b["v"]])).reshape(len(b), parts, -1), matrix(pa.chunked_array([b["entry"]]))
                for p in range(parts):
                    np.add.at(total[p], near[:, p], x[:, p])
                    n[p] += np.bincount(near[:, p], minlength=entries)
        used = np.repeat(n.ravel(), width) > 0
        at = [g.ravel()[used].astype(np.int32) for g in np.indices(books.shape)]
        yield pa.RecordBatch.from_arrays([*(pa.array(a) for a in at), pa.array(total.ravel()[used]), pa.array(np.repeat(n.ravel(), width)[used])], ["part", "entry", "place", "total", "n"])

    sums = map_arrow(state.select("v", "entry"), run, SUMS).groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = books.copy()
    for r in sums.collect():  # one row for each component of each entry
        out[r.part, r.entry, r.place] = r.total // r.n
    return out


def numbered(vectors: DataFrame, parts: int, scale: int) -> DataFrame:
    own = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].cast("string").alias("label"), vectors["embedding"].cast("array<double>").alias("x"))
    own = own.where(usable("x") & F.col("vec_id").isNotNull() & (F.size("x") % parts == 0))
    return own.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * F.lit(scale).cast("double"))).alias("v"))


def codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row of vec_id, embedding, label."""
    spark, since = vectors.sparkSession, mark()
    none = F.array().cast("array<double>")
    state = written(numbered(vectors, parts, scale).select("vec_id", "label", "v", F.array().cast("array<int>").alias("entry"), none.alias("upper"), none.alias("lower"), F.lit(0).alias("scans")), "vectors")
    least = state.orderBy("vec_id", "v").select("v").limit(1).collect()
    width = len(least[0].v) // parts if least else 1
    state = state.where(F.size("v") == width * parts)
    first = [r.v for r in state.orderBy("vec_id", "v").select("v").limit(entries).collect()]
    books = np.array(first, np.int64).reshape(len(first), parts, width).transpose(1, 0, 2)
    before = None
    for k in range(rounds + 1 if first else 0):
        following = written(assign(state, before, books), "assigned")
        drop_written(spark, since, following)
        state, before = following, books
        if k < rounds:
            books = updated(state, books)
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel()).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x, near = matrix(pa.chunked_array([b["v"]])).reshape(len(b), parts, -1), matrix(pa.chunked_array([b["entry"]]))
                error = sum(((x[:, p] - books[p][near[:, p]]) ** 2).sum(1) for p in range(parts))
                text = pa.array(["".join(f"{e:02x}" for e in row) for row in near])
                yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], text, pa.array(error)], ["vec_id", "label", "code", "error"])

    coded = map_arrow(state.select("vec_id", "label", "v", "entry"), run, "vec_id long, label string, code string, error long")
    coded = written(coded.withColumn("key", F.coalesce(F.concat(F.lit("="), "label"), F.lit(""))).drop("label"), "coded")
    drop_written(spark, since, coded)
    sums = coded.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows"))
    if sums.count() <= FEW_LABELS:
        out = coded.join(F.broadcast(sums.drop("rows")), "key")
    else:
        out = even_join(coded, sums.drop("rows"), ["key"], sizes=sums)
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
