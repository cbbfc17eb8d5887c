"""Turned boxes in batches: what pairs of them share, and the runs of raster cells that they cover. Spark deals the rows out and brings sines and cosines; NumPy does the arithmetic of a batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridor.functions.workers import shipped
from corridor.operators.planning import SIDE

SIGNS = ((0.5, 0.5), (0.5, -0.5), (-0.5, -0.5), (-0.5, 0.5))
BOX = ("x", "y", "dx", "dy", "cos", "sin")
#: A run's number is its line times this; wider than a line, so that runs of two lines never touch.
WIDE = 256


def shape(prefix: str, x: Column, y: Column, dx: Column, dy: Column, angle: Column | None = None) -> list[Column]:
    """A box's six numbers under a prefix; without an angle it stands along the axes."""
    turned = (F.lit(1.0), F.lit(0.0)) if angle is None else (F.cos(angle), F.sin(angle))
    return [c.cast("double").alias(prefix + n) for n, c in zip(BOX, (x, y, dx, dy, *turned), strict=True)]


def numbers(b: pa.RecordBatch, prefix: str) -> list[np.ndarray]:
    return [b[prefix + n].to_numpy(zero_copy_only=False) for n in BOX]


def corners(x: np.ndarray, y: np.ndarray, dx: np.ndarray, dy: np.ndarray, cos: np.ndarray, sin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x and y [4, n] of the corners of boxes turned clockwise."""
    return np.stack([x + dx * a * cos + dy * b * sin for a, b in SIGNS]), np.stack([y - dx * a * sin + dy * b * cos for a, b in SIGNS])


def overlaps(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], *turns: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether boxes share an area (touching is not enough): no axis of either separates them. turns: cosines and sines of both."""
    out = np.ones(a[0].shape[1], bool)
    for cos, sin in turns:
        for u, v in ((cos, -sin), (sin, cos)):
            p, q = a[0] * u + a[1] * v, b[0] * u + b[1] * v
            out &= (p.max(0) - q.min(0) > 1e-9) & (q.max(0) - p.min(0) > 1e-9)
    return out


def distances(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least distance of a corner of either box from an edge of the other (the boxes' distance, if they don't overlap); an edge without length is its only point."""
    out = np.full(a[0].shape[1], np.inf)
    for (px, py), (qx, qy) in ((a, b), (b, a)):
        for k in range(4):
            ax, ay, ux, uy = qx[k], qy[k], qx[(k + 1) % 4] - qx[k], qy[(k + 1) % 4] - qy[k]
            square = ux * ux + uy * uy
            for i in range(4):
                dx, dy = px[i] - ax, py[i] - ay
                t = np.clip((dx * ux + dy * uy) / np.where(square == 0, 1, square), 0, 1)
                out = np.minimum(out, (dx - t * ux) ** 2 + (dy - t * uy) ** 2)
    return np.sqrt(out)


def compared(pairs: DataFrame, *keys: str) -> DataFrame:
    """keys, overlaps, distance of pairs of boxes given by ``shape`` under a and b; null where a number of either is null or not finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [numbers(batch, p) for p in "ab"]
            a, b = (corners(*s) for s in sides)
            with np.errstate(invalid="ignore"):
                shared, away = overlaps(a, b, *(s[4:] for s in sides)), distances(a, b)
            lost = ~np.isfinite(np.stack([*sides[0], *sides[1]])).all(0)
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), pa.array(shared, mask=lost), pa.array(away, mask=lost)], [*keys, "overlaps", "distance"])

    kinds = [f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys]
    return shipped(pairs).mapInArrow(run, ", ".join([*kinds, "overlaps boolean", "distance double"]))


def covered(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(box, row, first column, last column) of the cells on the map that boxes cover, by corners [4, n] in whole cells: a row holds one run of a box, as boxes are convex.

    Covered are the cells in the polygon of the corners, its border included, and those that a line along an edge passes through: on each edge, for every column (or row, if
    the edge is steeper) the nearest cell, both of two equally near.
    """
    low, high = np.maximum(y.min(0), 0), np.minimum(y.max(0), SIDE - 1)
    n = np.where((low <= high) & (x.max(0) >= 0) & (x.min(0) < SIDE), high - low + 1, 0).astype(np.int64)
    box = np.repeat(np.arange(len(n)), n)
    row = np.arange(len(box)) - np.repeat(np.cumsum(n) - n, n) + low[box]
    first, last = np.full(len(box), np.inf), np.full(len(box), -np.inf)
    for k in range(4):
        ax, ay, bx, by = x[k], y[k], x[(k + 1) % 4], y[(k + 1) % 4]
        u, v = bx - ax, by - ay
        wide, tall = np.maximum(np.abs(u), np.abs(v)), np.abs(v)
        # twice the column at which the edge meets the row, times its height; whole numbers, so that quotients of them round to no wrong side
        middle = (2 * (ax * tall - ay * u * np.sign(v)))[box] + row * (2 * u * np.sign(v))[box]
        over, reach = np.maximum(2 * tall, 1)[box], np.where(tall == 0, np.inf, wide)[box]  # an edge along the row counts as a whole
        lo = np.maximum(np.ceil((middle - reach) / over), np.minimum(ax, bx)[box])
        hi = np.minimum(np.floor((middle + reach) / over), np.maximum(ax, bx)[box])
        on = (row >= np.minimum(ay, by)[box]) & (row <= np.maximum(ay, by)[box])
        first, last = np.where(on, np.minimum(first, lo), first), np.where(on, np.maximum(last, hi), last)
    first, last = np.maximum(first, 0), np.minimum(last, SIDE - 1)
    kept = first <= last
    return box[kept], *(v[kept].astype(np.int64) for v in (row, first, last))


def united(line: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of lines (line, first, last), ascending, without overlaps: those that overlap or touch become one."""
    starts, ends = line * WIDE + first, line * WIDE + last
    order = np.argsort(starts)
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1] + 1][: len(starts)])
    starts, ends = starts[new], ends[np.r_[new[1:], len(ends)] - 1] if len(new) else ends
    return starts // WIDE, starts % WIDE, ends % WIDE


def runs(rows: DataFrame) -> DataFrame:
    """token, t, r, c0, c1: the cells that boxes of rows (token, t, x, y, dx, dy, rot_z) cover, as runs from column c0 to c1 that neither overlap nor touch. See ``covered``; boxes with a null or non-finite number cover nothing.

    A scene's rows follow each other, so a task holds the runs of one scene besides a batch, however many boxes the scene has.
    """
    kind = rows.schema["token"].dataType
    # the window deals scenes out and orders them, and uses what order rows have; a repartition would always shuffle
    rows = rows.where("token IS NOT NULL AND t IS NOT NULL").withColumn("_k", F.row_number().over(Window.partitionBy("token").orderBy("t")))
    rows = rows.select("token", F.col("t").cast("long").alias("t"), "_k", *shape("", *(F.col(c) for c in ("x", "y", "dx", "dy", "rot_z"))))
    names = ["token", "t", "r", "c0", "c1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (token as an array of one, t, r, c0, c1) of the scene that may go on
        for b in batches:
            if not len(b):
                continue
            token = b["token"]
            at = np.r_[0, np.cumsum(pc.not_equal(token[1:], token[:-1]).to_numpy(zero_copy_only=False))].astype(np.int64)
            tokens = token.take(pa.array(np.flatnonzero(np.diff(at, prepend=-1))))
            box = np.stack(numbers(b, ""))
            good = np.flatnonzero(np.isfinite(box).all(0))
            x, y = (np.trunc(200.0 * (v + 50.25) / 100.0) for v in corners(*box[:, good]))
            k, r, c0, c1 = covered(x, y)
            own, t = at[good[k]], b["t"].to_numpy()[good[k]]
            if held is not None:
                if held[0][0].equals(tokens[0]):
                    own, t, r, c0, c1 = (np.r_[p, q] for p, q in zip((np.zeros(len(held[1]), np.int64), *held[1:]), (own, t, r, c0, c1), strict=True))
                else:
                    yield pa.RecordBatch.from_arrays([held[0].take(pa.array(np.zeros(len(held[1]), np.int64))), *map(pa.array, held[1:])], names)
            steps, step = np.unique(t, return_inverse=True)
            line, c0, c1 = united((own * len(steps) + step) * SIDE + r, c0, c1)
            own, t, r = line // SIDE // max(len(steps), 1), steps[line // SIDE % max(len(steps), 1)], line % SIDE
            done = own < len(tokens) - 1
            yield pa.RecordBatch.from_arrays([tokens.take(pa.array(own[done])), *(pa.array(v[done]) for v in (t, r, c0, c1))], names)
            held = (tokens[-1:], *(v[~done] for v in (t, r, c0, c1)))
        if held is not None:
            yield pa.RecordBatch.from_arrays([held[0].take(pa.array(np.zeros(len(held[1]), np.int64))), *map(pa.array, held[1:])], names)

    return shipped(rows).mapInArrow(run, f"token {kind.simpleString()}, t long, r long, c0 long, c1 long")
