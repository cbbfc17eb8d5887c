"""Nearest set cells of rasters, by an exact distance transform in two passes.

The first pass runs along columns: for every cell the nearest set row of its column. The second runs along rows: each column is a parabola whose height is the square of
what the first pass found, and the lower envelope of the parabolas gives the nearest column for every place of the row at once. Breakpoints are whole numbers, so
equal distances are decided exactly: for the smaller column, then the smaller row. A raster is transformed once, whatever the number of places that ask for it. Where a
raster has so few set cells and places that all their pairs are less work than its transform, they are compared, under the same rule for equal distances.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor.functions.workers import shipped
from corridor.operators.planning import CELL, SIDE
from corridor.operators.spatial import CROSSING, quantised

#: Rasters transformed at a time, and rows of them whose envelopes are built at a time.
RASTERS, ROWS = 64, 4096
#: Pairs of a raster's set cells and places up to which they are compared outright, for less than a transform's work, and pairs compared at a time.
FEW, PAIRS = 20_000, 1 << 20
FAR = 1 << 20


def nearest_rows(raster: np.ndarray, ahead: bool) -> np.ndarray:
    """For each cell of rasters [n, row, column] of booleans the nearest set row of its column, -1 if there is none; with ``ahead`` of those not before its own."""
    at = np.arange(raster.shape[1])[None, :, None]
    after = np.minimum.accumulate(np.where(raster, at, FAR)[:, ::-1], 1)[:, ::-1]
    if ahead:
        return np.where(after < FAR, after, -1)
    before = np.maximum.accumulate(np.where(raster, at, -FAR), 1)
    near = np.where(at - before <= after - at, before, after)
    return np.where((near < 0) | (near >= FAR), -1, near)


def envelope(height: np.ndarray) -> np.ndarray:
    """For rows [n, column] of squared heights (negative: no parabola) the column whose parabola is lowest at each column, -1 in rows without any. Equal ones go to the smaller column."""
    n, wide = height.shape
    f = height.astype(np.int64)
    own, start, top = np.zeros((n, wide), np.int64), np.zeros((n, wide), np.int64), np.full(n, -1)
    for q in range(wide):
        rows = np.flatnonzero(f[:, q] >= 0)
        first, todo = np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(todo):
            todo = todo[top[rows[todo]] >= 0]
            at = rows[todo]
            v = own[at, top[at]]
            first[todo] = (f[at, q] + q * q - f[at, v] - v * v) // (2 * (q - v)) + 1  # from here on q is lower than v
            hidden = first[todo] <= start[at, top[at]]
            top[at[hidden]] -= 1
            first[todo[hidden]] = 0
            todo = todo[hidden]
        seen = first < wide
        rows, first = rows[seen], first[seen]
        top[rows] += 1
        own[rows, top[rows]], start[rows, top[rows]] = q, np.maximum(first, 0)
    mark = np.zeros((n, wide), np.int64)
    k = np.arange(wide)[None, :] <= top[:, None]
    i, j = np.nonzero(k)
    mark[i, start[i, j]] = j
    lowest = np.take_along_axis(own, np.maximum.accumulate(mark, 1), 1)
    return np.where(top[:, None] >= 0, lowest, -1)


def by_transform(cells: list[np.ndarray], places: list[np.ndarray], ahead: bool) -> tuple[np.ndarray, np.ndarray]:
    """What ``looked_up`` gives, by the distance transform."""
    sizes = np.array([len(p) for p in places])
    k, place = np.repeat(np.arange(len(cells)), sizes), np.concatenate([np.zeros(0, np.int64), *places]).astype(np.int64)
    r, c = np.full(len(place), -1), np.full(len(place), -1)
    for lo in range(0, len(cells), RASTERS):
        some = cells[lo : lo + RASTERS]
        raster = np.zeros((len(some), SIDE * SIDE), bool)
        raster[np.repeat(np.arange(len(some)), [len(s) for s in some]), np.concatenate([np.zeros(0, np.int64), *some]).astype(np.int64)] = True
        rows = nearest_rows(raster.reshape(-1, SIDE, SIDE), ahead)
        asked = np.flatnonzero((k >= lo) & (k < lo + RASTERS))
        lines, of = np.unique((k[asked] - lo) * SIDE + place[asked] // SIDE, return_inverse=True)  # a line of a raster is built once
        for part in range(0, len(lines), ROWS):
            line = lines[part : part + ROWS]
            near = rows[line // SIDE, line % SIDE]
            columns = envelope(np.where(near < 0, -1, (near - (line % SIDE)[:, None]) ** 2))
            here = np.flatnonzero((of >= part) & (of < part + ROWS))
            at = of[here] - part
            column = columns[at, place[asked[here]] % SIDE]
            c[asked[here]], r[asked[here]] = column, np.where(column < 0, -1, near[at, column])
    return r, c


def by_pairs(cells: list[np.ndarray], places: list[np.ndarray], ahead: bool) -> tuple[np.ndarray, np.ndarray]:
    """What ``looked_up`` gives, by all pairs: the least of distance, column and row as one number."""
    n, m = np.array([len(s) for s in cells], np.int64), np.array([len(p) for p in places], np.int64)
    cell, place = (np.concatenate([np.zeros(0, np.int64), *v]).astype(np.int64) for v in (cells, places))
    raster = np.repeat(np.arange(len(n)), m)
    best = np.full(len(place), -1)
    asked = np.flatnonzero(n[raster] > 0)
    part = np.cumsum(n[raster[asked]]) // PAIRS
    for own in np.split(asked, np.flatnonzero(np.diff(part)) + 1) if len(asked) else []:
        k = n[raster[own]]
        starts = np.cumsum(k) - k
        other = cell[np.arange(k.sum()) - np.repeat(starts - (np.cumsum(n) - n)[raster[own]], k)]
        at = np.repeat(place[own], k)
        r, c = other // SIDE, other % SIDE
        down, aside = r - at // SIDE, c - at % SIDE
        rank = ((down * down + aside * aside) * SIDE + c) * SIDE + r
        least = np.minimum.reduceat(np.where(down < 0, 1 << 40, rank) if ahead else rank, starts)
        best[own] = np.where(least < 1 << 40, least, -1)
    return np.where(best < 0, -1, best % SIDE), np.where(best < 0, -1, best // SIDE % SIDE)


def looked_up(cells: list[np.ndarray], places: list[np.ndarray], ahead: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the nearest set cell for the places of each raster, -1 where it has none. Cells and places as numbers row * SIDE + column."""
    sizes = np.array([len(p) for p in places], np.int64)
    few = np.array([len(s) for s in cells], np.int64) * sizes <= FEW
    r, c = np.full(sizes.sum(), -1), np.full(sizes.sum(), -1)
    for kind, find in ((few, by_pairs), (~few, by_transform)):
        some = np.flatnonzero(kind)
        if len(some):
            own = np.repeat(kind, sizes)
            r[own], c[own] = find([cells[k] for k in some], [places[k] for k in some], ahead)
    return r, c


def transformed(points: DataFrame, cells: DataFrame, layers: tuple[int, ...], ahead: bool) -> DataFrame:
    """token, layer, py, px, r, c: for each different cell of places on the map the nearest set cell of each layer; none for layers without cells. A raster and its places are SIDE * SIDE cells each at most."""
    on = cells.where(F.col("layer").isin(*layers) & F.col("r").between(0, SIDE - 1) & F.col("c").between(0, SIDE - 1))
    own = on.groupBy("token", "layer").agg(F.collect_set(F.col("r") * SIDE + F.col("c")).alias("cells"))
    asked = quantised(points).where("valid").groupBy("token").agg(F.collect_set(F.col("py") * SIDE + F.col("px")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = lambda name, b=b: np.split(b[name].flatten().to_numpy(), np.cumsum(b[name].value_lengths().to_numpy())[:-1]) if len(b) else []
            places = split("places")
            r, c = looked_up(split("cells"), places, ahead)
            row = pa.array(np.repeat(np.arange(len(b)), [len(p) for p in places]))
            place = np.concatenate([np.zeros(0, np.int32), *places]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b["token"].take(row), b["layer"].take(row), *(pa.array(x.astype(np.int32)) for x in (place // SIDE, place % SIDE, r, c))], ["token", "layer", "py", "px", "r", "c"])

    rows = shipped(own).join(asked, "token").select("token", F.col("layer").cast("int").alias("layer"), "cells", "places")
    return rows.mapInArrow(run, f"token {own.schema['token'].dataType.simpleString()}, layer int, py int, px int, r int, c int").where("c >= 0")


def nearest(points: DataFrame, cells: DataFrame, layer: int = CROSSING) -> DataFrame:
    """token, t, r, c: the nearest set cell of a layer at or ahead of a place; ties go to the smaller column, then row. Places without one, and those off the map, have no row."""
    return quantised(points).where("valid").join(transformed(points, cells, (layer,), True), ["token", "py", "px"]).select("token", "t", "r", "c")


def nearest_of_layers(points: DataFrame, cells: DataFrame, *layers: int) -> DataFrame:
    """token, t, layer, r, c, distance: the nearest set cell of each layer on any side, and how many metres off its middle is from that of the place's own cell; ties as in ``nearest``."""
    found = quantised(points).where("valid").join(transformed(points, cells, layers, False), ["token", "py", "px"])
    away = F.sqrt(((F.col("c") - F.col("px")) ** 2 + (F.col("r") - F.col("py")) ** 2).cast("double")) * CELL
    return found.select("token", "t", "layer", "r", "c", away.alias("distance"))
