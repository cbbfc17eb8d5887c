"""Sequences for training: bins, label masks, position ids, batches; and a numeric refinement of planned paths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.functions.workers import shipped
from corridor.operators.planning import forecast

IGNORED = -100


def greedy_bins(sizes: np.ndarray, volume: int) -> np.ndarray:
    """The bin of each size: largest first, into the fullest bin that has room; a size beyond the volume has a bin of its own."""
    bins, room = np.zeros(len(sizes), np.int64), []
    for k in np.argsort(-sizes, kind="stable"):
        fits = [b for b, r in enumerate(room) if r >= sizes[k]]
        b = min(fits, key=lambda b: room[b]) if fits else len(room)
        if not fits:
            room.append(volume)
        room[b] -= sizes[k]
        bins[k] = b
    return bins


def pack_bins(rows: DataFrame, key: str, size: str, volume: int = 4096, batch: int = 256) -> DataFrame:
    """key, size, batch_id, bin: rows are batched by key, ``batch`` ids each, so that no group grows with the data; null sizes count as zero."""
    own = rows.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size")).withColumn("batch_id", F.floor(F.col("key") / batch))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "size"]).reset_index(drop=True)
        return group.assign(bin=greedy_bins(group["size"].to_numpy(), volume))

    return shipped(own).groupBy("batch_id").applyInPandas(run, "key long, size long, batch_id long, bin long")


def answer_spans(ids: Column, start: int, end: int) -> Column:
    """array<struct<first, last>>: what answers say. An answer begins two after a start id and goes on to one past the next end id; starts before that end begin none."""
    places = lambda own: F.filter(F.sequence(F.lit(0), F.size(ids) - 1), lambda k: F.get(ids, k) == own)
    ends, none = places(end), F.array().cast("array<struct<first:int,last:int>>")

    def add(spans: Column, at: Column) -> Column:
        stop = F.array_min(F.filter(ends, lambda e: e >= at + 2))
        inside = at < F.coalesce(F.try_element_at(spans, F.lit(-1))["last"], F.lit(-1))
        return F.when(inside | stop.isNull(), spans).otherwise(F.concat(spans, F.array(F.struct((at + 2).alias("first"), (stop + 1).alias("last")))))

    return F.when(F.size(ids) > 0, F.aggregate(places(start), none, add)).otherwise(none)


def label_masks(rows: DataFrame, ids: str, *keep: str, start: int = 77091, end: int = 151645) -> DataFrame:
    """keep columns, ids and labels: the ids of answers, IGNORED for all else; a null list counts as empty."""
    own = rows.select(*keep, F.coalesce(F.col(ids).cast("array<long>"), F.array().cast("array<long>")).alias(ids)).withColumn("_spans", answer_spans(F.col(ids), start, end))
    said = F.transform(ids, lambda x, k: F.when(F.exists("_spans", lambda s: k.between(s["first"], s["last"])), x).otherwise(F.lit(IGNORED).cast("long")))
    return own.withColumn("labels", said).drop("_spans")


def rope_positions(row: np.ndarray, kind: np.ndarray, grid: np.ndarray, merge: int = 2, seconds: np.ndarray | None = None, per_second: int = 2, split_frames: bool = False) -> np.ndarray:
    """Positions [3, n] of the tokens of many rows at once. row, kind: of each token, its row and 0 for text or n for the row's n-th vision segment; grid: frames, height and width of each token's segment.

    Text counts on; a vision token is at its frame, row and column behind all before, and what follows begins behind the greatest of them. seconds: of each token's
    segment, the seconds between frames, which spread the frames; split_frames: every frame stands alone, with time zero.
    """
    n = len(row)
    if not n:
        return np.zeros((3, 0), np.int64)
    new = np.r_[True, (row[1:] != row[:-1]) | (kind[1:] != kind[:-1])]
    run, first = np.cumsum(new) - 1, np.flatnonzero(new)
    place, length = np.arange(n) - first[run], np.diff(np.r_[first, n])
    h, w = np.maximum(grid[:, 1] // merge, 1), np.maximum(grid[:, 2] // merge, 1)
    frame = place // (h * w)
    time = np.zeros(n, np.int64) if split_frames else (frame * seconds * per_second).astype(np.int64) if seconds is not None else frame
    seen = np.stack([time, place // w % h, place % w])
    own = np.where(kind == 0, place, seen)
    extent = np.where(kind[first] == 0, length, np.maximum.reduceat(seen.max(0), first) + 1)
    before = np.cumsum(extent) - extent
    starts = np.r_[True, row[first][1:] != row[first][:-1]]
    before -= before[np.flatnonzero(starts)][np.cumsum(starts) - 1]
    return own + before[run]


def rope_index(rows: DataFrame, key: str, merge: int = 2, split_frames: bool = False, seconds: str | None = None, per_second: int = 2) -> DataFrame:
    """key, place, t, h, w of rows of key, kinds (array of int), grids (array of three ints each) and, if named, seconds (array of double, one for each grid)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = np.array([0 if k is None else len(k) for k in b["kinds"]], np.int64)
            row = np.repeat(np.arange(len(b)), sizes)
            kind = np.concatenate([np.zeros(0, np.int64), *(np.asarray(k, np.int64) for k in b["kinds"] if k is not None)])
            counts = np.array([0 if g is None else len(g) for g in b["grids"]], np.int64)
            segments = np.array([x for g in b["grids"] if g is not None for x in g], np.int64).reshape(-1, 3)
            at = np.maximum((np.cumsum(counts) - counts)[row] + kind - 1, 0)
            grid = segments[at] if len(segments) else np.ones((len(row), 3), np.int64)
            spread = np.array([x for g in b[seconds] if g is not None for x in g], float)[at] if seconds and len(segments) else None
            t, h, w = rope_positions(row, kind, grid, merge, spread, per_second, split_frames)
            yield pd.DataFrame({"key": b[key].to_numpy()[row], "place": np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row], "t": t, "h": h, "w": w})

    return shipped(rows).select(key, "kinds", "grids", *([seconds] if seconds else [])).mapInPandas(run, "key long, place int, t long, h long, w long")


def padded(ids: Column, length: int, fill: int) -> Column:
    """A list cut or filled to a length."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(fill).cast("long"), length)), 1, length)


def collate(rows: DataFrame, by: str, order: str, length: int, pad: int = 0) -> DataFrame:
    """Adds input_ids, labels and attention of a common length to rows of by, order, ids, labels."""
    n = F.least(F.size("ids"), F.lit(length))
    return rows.select(by, order, padded(F.col("ids"), length, pad).alias("input_ids"), padded(F.col("labels"), length, IGNORED).alias("labels"), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n)).alias("attention"))


def flattened(rows: DataFrame, by: str, order: str) -> DataFrame:
    """by, ids, ends: all lists of a bin (bounded by its volume) as one, with the cumulated lengths, zero first."""
    own = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("ids").alias("v"))))
    ends = F.aggregate("l", F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.size(x["v"]))))
    return rows.groupBy(by).agg(own.alias("l")).select(by, F.flatten(F.transform("l", lambda x: x["v"])).alias("ids"), ends.alias("ends"))


def terms(p: np.ndarray, reference: np.ndarray, obstacles: np.ndarray, row: np.ndarray, alpha: float, sigma: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cost, gradient and second derivatives (xx, xy, yy) of many waypoints at once: squared deviation and a Gaussian penalty for each obstacle. row: the waypoint that an obstacle belongs to."""
    n, d = len(p), p[row] - obstacles
    e = alpha / (2.507 * sigma) * np.exp(-(d**2).sum(1) / (2 * sigma**2))
    total = lambda v: np.bincount(row, v, n)
    cost = ((p - reference) ** 2).sum(1) + total(e)
    slope = 2 * (p - reference) - np.stack([total(e * d[:, k]) for k in (0, 1)], 1) / sigma**2
    bend = 2 - total(e) / sigma**2
    return cost, slope, np.stack([bend + total(e * d[:, 0] ** 2) / sigma**4, total(e * d[:, 0] * d[:, 1]) / sigma**4, bend + total(e * d[:, 1] ** 2) / sigma**4], 1)


def least_bend(bends: np.ndarray) -> np.ndarray:
    """The least second derivative in any direction."""
    a, b, c = bends.T
    return (a + c) / 2 - np.hypot((a - c) / 2, b)


def trusted_step(slope: np.ndarray, bends: np.ndarray, radius: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Newton's step on the second derivatives, made positive where they are not (the least becomes its absolute value; one that is small but positive stays, so that shallow valleys take no
    more steps than steep ones), cut to the radius; and by how much the quadratic model falls. Those of ``flat`` are on or near a saddle and leave it where it bends down."""
    a, b, c = bends.T
    low = least_bend(bends)
    lift = np.maximum(np.maximum(np.abs(low), 1e-9) - low, 0)
    det = (a + lift) * (c + lift) - b * b
    step = -np.stack([(c + lift) * slope[:, 0] - b * slope[:, 1], (a + lift) * slope[:, 1] - b * slope[:, 0]], 1) / det[:, None]
    angle = np.arctan2(2 * b, a - c) / 2 + np.pi / 2  # across the direction of the greatest one
    along = np.stack([np.cos(angle), np.sin(angle)], 1)
    along *= np.where((along * slope).sum(1) > 0, -1, 1)[:, None]
    step = np.where(flat[:, None], along, step)
    length = np.maximum(np.hypot(*step.T), 1e-300)
    step *= (np.where(flat, radius, np.minimum(length, radius)) / length)[:, None]
    x, y = step.T
    return step, -((slope * step).sum(1) + (a * x * x + 2 * b * x * y + c * y * y) / 2)


def pushed_away(start: np.ndarray, obstacles: np.ndarray, row: np.ndarray, alpha: float, sigma: float, rounds: int = 500, rest: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Where waypoints [n, 2] come to rest that stay near their start and off their obstacles, and the length of the gradient there: one trust-region search for all of them.

    A waypoint is done when its gradient is shorter than ``rest`` and no direction bends down, never because steps got short. A step counts if the cost falls as the model says; where the change of
    the cost is lost in rounding, if the gradient gets shorter. obstacles: [m, 2]; row: the waypoint that each belongs to, ascending. Waypoints without any stay.
    """
    p = start.astype(float).copy()
    moving = np.bincount(row, minlength=len(p)) > 0
    p[moving] += 1e-6  # off the ridge, should it start on one
    cost, slope, bends = terms(p, start, obstacles, row, alpha, sigma)
    radius = np.full(len(p), sigma)
    busy = lambda k: (np.hypot(*slope[k].T) > rest) | (least_bend(bends[k]) < -1e-9)
    live = np.flatnonzero(moving)
    live = live[busy(live)]
    for _ in range(rounds):
        if not len(live):
            break
        at = np.full(len(p), -1)
        at[live] = np.arange(len(live))
        own = at[row] >= 0
        step, fall = trusted_step(slope[live], bends[live], radius[live], (np.hypot(*slope[live].T) < 1e-6) & (least_bend(bends[live]) < -1e-9))
        there = p[live] + step
        new_cost, new_slope, new_bends = terms(there, start[live], obstacles[own], at[row[own]], alpha, sigma)
        change = cost[live] - new_cost
        lost = np.abs(change) <= 1e-14 * (1 + np.abs(cost[live]))
        shorter = np.hypot(*new_slope.T) < np.hypot(*slope[live].T)
        good = np.where(lost, shorter, change > 0.1 * fall)
        size = np.hypot(*step.T)
        radius[live] = np.where(good & (lost | (change > 0.75 * fall)), np.maximum(radius[live], 2 * size), np.where(good & (change > 0.25 * fall), radius[live], size / 4))
        k = live[good]
        p[k], cost[k], slope[k], bends[k] = there[good], new_cost[good], new_slope[good], new_bends[good]
        live = live[busy(live) & (radius[live] > 1e-15)]
    return p, np.where(moving, np.hypot(*slope.T), 0.0)


def refine_paths(points: DataFrame, occ: DataFrame, reach: float = 5.0, alpha: float = 5.0, sigma: float = 1.0, above: float = 0.1) -> DataFrame:
    """token, t, x, y, cells, slope: paths moved off the occupied cells within reach of each waypoint; waypoints without any stay, those with a null place too. cells:
    their number; slope: the length of the cost's gradient where the waypoint came to rest, its certificate.

    Each waypoint is held against the forecast of its step; the forecast's last step also stands for later ones. A batch of waypoints is solved at once.
    """
    at = lambda c: F.lit(-50.0) + (F.col(c) + F.lit(0.5)) * F.lit(0.5)
    taken = forecast(occ, above).select("token", "t", at("c").alias("ox"), at("r").alias("oy"))
    near = points.join(taken, ["token", "t"]).where((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2 < reach**2)
    around = near.groupBy("token", "t").agg(F.sort_array(F.collect_list(F.struct("oy", "ox"))).alias("o"))  # cells within reach of a point

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start = np.stack([b[c].to_numpy(zero_copy_only=False).astype(float) for c in "xy"], 1)
            sizes = pc.fill_null(pc.list_value_length(b["o"]), 0).to_numpy().astype(np.int64)
            flat = b["o"].flatten()
            obstacles = np.stack([flat.field(flat.type.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("ox", "oy")], 1) if len(flat) else np.zeros((0, 2))
            end, slopes = pushed_away(start, obstacles, np.repeat(np.arange(len(b)), sizes), alpha, sigma)
            moved = [pa.array(v, mask=np.isnan(v)) for v in end.T]
            yield pa.RecordBatch.from_arrays([b["token"], b["t"], *moved, pa.array(sizes.astype(np.int32)), pa.array(slopes)], ["token", "t", "x", "y", "cells", "slope"])

    rows = shipped(points).select("token", "t", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).join(around, ["token", "t"], "left")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("token", "t")}
    return rows.mapInArrow(run, f"token {kinds['token']}, t {kinds['t']}, x double, y double, cells int, slope double")
