"""Spatial joins on a grid: rows of two tables whose boxes meet, within equal keys.

A box goes into every cell that it touches. The cells of its level are at least as wide as it is, so these are four at most; a pair is looked for on the level of the
larger box, and reported only in the cell that holds the lower corner of what the two share. So a pair comes once, rows of a key that lie apart never meet, and the rows of
a crowded key are dealt out by place. Boxes with a null or non-finite border meet nothing; a box whose upper border is below the lower one meets nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")


def level(side: Column, unit: float) -> Column:
    """The least level whose cells are as wide: unit * 2^level."""
    return F.greatest(F.ceil(F.log2(F.greatest(side, F.lit(unit)) / unit)), F.lit(0)).cast("int")


def boxed(rows: DataFrame, box: tuple[Column, Column, Column, Column], prefix: str, unit: float) -> DataFrame:
    """Adds the box's borders and its level under a prefix; rows without a usable box are left out."""
    rows = rows.withColumns({prefix + n: c.cast("double") for n, c in zip(BOX, box, strict=True)})
    x0, y0, x1, y1 = (F.col(prefix + n) for n in BOX)
    fine = (x0 <= x1) & (y0 <= y1) & (F.greatest(F.abs(x0), F.abs(y0), F.abs(x1), F.abs(y1)) < float("inf"))  # NaN is above all numbers
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    return rows.withColumn(prefix + "level", level(F.greatest(x1 - x0, y1 - y0), unit))


def celled(rows: DataFrame, prefix: str, levels: list[int], unit: float) -> DataFrame:
    """A row for each cell that a box touches, on its own level and those of ``levels`` above it."""
    own = F.col(prefix + "level")
    above = F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v > own) if levels else F.array().cast("array<int>")
    rows = rows.withColumn("_level", F.explode(F.concat(F.array(own), above)))
    cell = lambda c: F.floor(F.col(prefix + c) / (F.lit(unit) * F.pow(F.lit(2.0), F.col("_level")))).cast("long")
    return rows.withColumn("_x", F.explode(F.sequence(cell("x0"), cell("x1")))).withColumn("_y", F.explode(F.sequence(cell("y0"), cell("y1"))))


def levels_of(rows: DataFrame, prefix: str) -> list[int]:
    """Levels that rows have: about as many as the sizes have powers of two."""
    return sorted(r[0] for r in rows.select(prefix + "level").distinct().collect())


def meeting(a: DataFrame, b: DataFrame, keys: list[str], a_box: tuple[Column, ...], b_box: tuple[Column, ...], unit: float = 8.0, levels: tuple[list[int], list[int]] | None = None) -> DataFrame:
    """Pairs of rows of equal keys whose boxes (lower x, lower y, upper x, upper y) meet; touching is enough. All columns of both; but for the keys their names must differ.

    levels: those that a's and b's rows have, if known; else they are looked up first.
    """
    a, b = boxed(a, a_box, "_a", unit), boxed(b, b_box, "_b", unit)
    of_a, of_b = levels or (levels_of(a, "_a"), levels_of(b, "_b"))
    pairs = celled(a, "_a", of_b, unit).join(celled(b, "_b", of_a, unit), [*keys, "_level", "_x", "_y"])
    share = lambda c: F.greatest(F.col(f"_a{c}0"), F.col(f"_b{c}0"))
    meet = lambda c: share(c) <= F.least(F.col(f"_a{c}1"), F.col(f"_b{c}1"))
    cell = lambda c: F.floor(share(c) / (F.lit(unit) * F.pow(F.lit(2.0), F.col("_level")))).cast("long")
    once = (F.greatest("_alevel", "_blevel") == F.col("_level")) & (cell("x") == F.col("_x")) & (cell("y") == F.col("_y"))
    return pairs.where(meet("x") & meet("y") & once).drop("_level", "_x", "_y", "_alevel", "_blevel", *[p + n for p in ("_a", "_b") for n in BOX])
