"""Planning metrics: aligned waypoints, displacement errors, footprint collisions, reports. Trajectories are rows of token, t (from 1), x, y."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS, REPORTED = 6, (2, 4, 6)
CELL, HALF, SIDE = 0.5, 50.0, 200
LENGTH, WIDTH = 4.084, 1.85


def align(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Every waypoint of gt with the predicted one as px, py; a missing one stands still at the origin, steps beyond gt's are cut."""
    own = pred.select("token", "t", F.col("x").alias("px"), F.col("y").alias("py"), F.lit(True).alias("found"))
    return gt.join(own, ["token", "t"], "left").withColumns({"px": F.coalesce("px", F.lit(0.0)), "py": F.coalesce("py", F.lit(0.0)), "found": F.coalesce("found", F.lit(False))})


def errors(aligned: DataFrame) -> DataFrame:
    """Adds l2: the masked distance."""
    return aligned.withColumn("l2", F.sqrt(F.col("mask") * (F.col("px") - F.col("x")) ** 2 + F.col("mask") * (F.col("py") - F.col("y")) ** 2))


def l2_by_step(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Mean error of each step over all tokens: masked waypoints count as zero, missing predictions as the origin."""
    return errors(align(gt, pred)).groupBy("t").agg(F.count("*").alias("n"), F.sum((~F.col("found")).cast("int")).alias("missing"), F.round(F.avg("l2"), 6).alias("l2"))


def report(by_step: DataFrame, value: str, cumulative: bool) -> DataFrame:
    """One row: the value at steps 2, 4 and 6, or its mean up to them, and the mean of the three."""
    if cumulative:  # at most STEPS rows
        by_step = by_step.withColumn(value, F.avg(value).over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    at = {k: F.max(F.when(F.col("t") == k, F.col(value))) for k in REPORTED}
    out = by_step.agg(*[v.alias(f"at_{k}") for k, v in at.items()])
    mean = sum((F.col(f"at_{k}") for k in REPORTED), F.lit(0.0)) / F.lit(float(len(REPORTED)))
    return out.select(*[F.round(f"at_{k}", 6).alias(f"at_{k}") for k in REPORTED], F.round(mean, 6).alias("mean"))


def footprint(length: float = LENGTH, width: float = WIDTH) -> list[tuple[int, int]]:
    """The cells (row, column) that a vehicle at the origin covers; its reference point lies half a metre behind its middle."""
    inside = lambda lo, hi: range(math.ceil((lo + HALF - CELL / 2) / CELL), math.floor((hi + HALF - CELL / 2) / CELL) + 1)
    return [(r, c) for r in inside(-length / 2 + 0.5, length / 2 + 0.5) for c in inside(-width / 2, width / 2)]


def point_cell(x: Column, y: Column) -> tuple[Column, Column]:
    """Row and column of a point, truncated towards zero; outside 0..199 it is off the map."""
    return ((y + HALF - CELL / 2) / CELL).cast("int"), ((x + HALF - CELL / 2) / CELL).cast("int")


def cell_sets(cells: DataFrame) -> DataFrame:
    """token, t, taken: the occupied cells of a raster as one set of numbers; a raster has SIDE * SIDE cells at most."""
    return cells.groupBy("token", "t").agg(F.collect_set(F.col("r") * SIDE + F.col("c")).alias("taken"))


def box_cells(x: Column, y: Column, length: float = LENGTH, width: float = WIDTH) -> Column:
    """The numbers of the cells that the footprint covers at a point; cells off the map count for its border."""
    offsets = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in footprint(length, width)])
    clip = lambda v: F.least(F.greatest(v.cast("int"), F.lit(0)), F.lit(SIDE - 1))
    return F.transform(offsets, lambda o: clip(y / CELL + o["r"]) * SIDE + clip(x / CELL + o["c"]))


def hits(points: DataFrame, x: str, y: str, cells: DataFrame, name: str, length: float = LENGTH, width: float = WIDTH) -> DataFrame:
    """token, t and whether any cell of the footprint is occupied: one join, by token and step, however large the footprint."""
    rows = points.select("token", "t", x, y).join(cell_sets(cells), ["token", "t"], "left")
    return rows.select("token", "t", F.coalesce(F.arrays_overlap("taken", box_cells(F.col(x), F.col(y), length, width)), F.lit(False)).alias(name))


def forecast(occ: DataFrame, above: float = 0.1, last: int = 4, steps: int = STEPS) -> DataFrame:
    """token, t, r, c: the cells that a forecast (t from 0 to ``last``) holds for taken at steps 1 to ``steps``; its last step also stands for later ones."""
    later = F.explode(F.when(F.col("t") == last, F.sequence(F.lit(last), F.lit(steps))).otherwise(F.array("t")))
    return occ.where((F.col("p") > above) & F.col("t").between(1, last)).select("token", later.alias("t"), "r", "c")


def collisions(gt: DataFrame, pred: DataFrame, cells: DataFrame) -> DataFrame:
    """token, t, gt_hit, point_hit, box_hit: the last two only where the true vehicle is free."""
    rows = align(gt, pred).join(cell_sets(cells), ["token", "t"], "left")
    over = lambda own: F.coalesce(F.arrays_overlap("taken", own), F.lit(False))
    r, c = point_cell(F.col("px"), F.col("py"))
    inside = r.between(0, SIDE - 1) & c.between(0, SIDE - 1)
    rows = rows.withColumn("gt_hit", over(box_cells(F.col("x"), F.col("y"))))
    return rows.select("token", "t", "gt_hit", (inside & over(F.array(r * SIDE + c)) & ~F.col("gt_hit")).alias("point_hit"), (over(box_cells(F.col("px"), F.col("py"))) & ~F.col("gt_hit")).alias("box_hit"))


def collision_by_step(found: DataFrame) -> DataFrame:
    """Rates over all tokens, and the counts."""
    number = lambda c: F.sum(F.col(c).cast("int"))
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return found.groupBy("t").agg(F.count("*").alias("n"), number("gt_hit").alias("gt_hits"), number("point_hit").alias("point_hits"), number("box_hit").alias("box_hits"), rate("point_hit").alias("point_rate"), rate("box_hit").alias("box_rate"))


def first_collision(found: DataFrame, hit: str) -> DataFrame:
    """token and the first step at which it hits."""
    return found.where(F.col(hit)).groupBy("token").agg(F.min("t").alias("t"))


def mean_trajectory(points: DataFrame) -> DataFrame:
    return points.groupBy("t").agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))


def path_length(points: DataFrame) -> DataFrame:
    """token, steps, length: the sum of distances between neighbouring waypoints."""
    order = Window.partitionBy("token").orderBy("t")
    step = F.sqrt((F.col("x") - F.lag("x").over(order)) ** 2 + (F.col("y") - F.lag("y").over(order)) ** 2)
    return points.withColumn("d", F.coalesce(step, F.lit(0.0))).groupBy("token").agg(F.count("*").alias("steps"), F.round(F.sum("d"), 6).alias("length"))


def padded(points: DataFrame, tokens: DataFrame) -> DataFrame:
    """Exactly STEPS waypoints for each token: missing ones are zero, later ones are cut."""
    grid = tokens.select("token").distinct().withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(STEPS))))
    return grid.join(points.select("token", "t", "x", "y"), ["token", "t"], "left").fillna(0.0, ["x", "y"])


def last_written(records: DataFrame, value: str, key: str = "token", order: str = "line") -> DataFrame:
    """key and value of each key's last record, in file order, whose value is not null: a later record replaces an earlier one, one that could not be parsed doesn't."""
    return records.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value))
