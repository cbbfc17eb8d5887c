"""Which kinds of reasoning texts hold: shares, repeats, pairs that occur together. Rows have id columns and a text; kinds are markers in it."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridor.functions.formats import QUESTIONS

MARKERS = QUESTIONS


def occurrences(text: Column, marker: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(marker), F.lit("")))) / len(marker)).cast("int")


def counted(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep columns, kind, place (its order), n: a row for each text and kind."""
    kinds = F.array(*[F.struct(F.lit(m).alias("kind"), F.lit(k).alias("place"), occurrences(F.col(text), m).alias("n")) for k, m in enumerate(MARKERS)])
    return rows.select(*keep, F.explode(kinds).alias("k")).select(*keep, "k.*")


def share(rows: DataFrame, text: str, *by: str) -> DataFrame:
    """For each kind (and group): texts with it, all texts, and their quotient."""
    has = (F.col("n") > 0).cast("int")
    return counted(rows, text, *by).groupBy(*by, "kind").agg(F.sum(has).alias("with_kind"), F.count("*").alias("total"), F.round(F.avg(has), 6).alias("share"))


def repeats(rows: DataFrame, text: str) -> DataFrame:
    """For each kind: how often it occurs beyond once a text."""
    return counted(rows, text).groupBy("kind").agg(F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("repeats"))


def pairs(rows: DataFrame, text: str) -> DataFrame:
    """All pairs of kinds, in order, with the texts that hold both (zero included) and their share of all texts; one pass, a sum for each pair."""
    both = lambda a, b: (F.contains(F.col(text), F.lit(a)) & F.contains(F.col(text), F.lit(b))).cast("int")
    all_ = [*combinations(MARKERS, 2)]
    sums = rows.agg(F.count("*").alias("total"), *[F.sum(both(a, b)).alias(f"p{k}") for k, (a, b) in enumerate(all_)])
    out = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.coalesce(f"p{k}", F.lit(0)).alias("n")) for k, (a, b) in enumerate(all_)])
    return sums.select("total", F.explode(out).alias("p")).select("p.*", F.round(F.col("p.n") / F.greatest("total", F.lit(1)), 6).alias("share"))


def top_pairs(found: DataFrame, n: int = 10) -> DataFrame:
    return found.orderBy(F.desc("n"), "place").limit(n)


def matrix(found: DataFrame) -> DataFrame:
    """a, b, n for both directions, with a zero diagonal."""
    same = found.sparkSession.createDataFrame([(m, m, 0) for m in MARKERS], "a string, b string, n long")
    return found.select("a", "b", F.col("n").cast("long").alias("n")).union(found.select("b", "a", F.col("n").cast("long"))).union(same)


def normalised(cells: DataFrame, by: str | None) -> DataFrame:
    """Adds share: n by the sum of its row (by='a'), column (by='b') or all (None), zero where that sum is zero. The matrix has a cell for each pair of kinds."""
    total = F.sum("n").over(Window.partitionBy(by) if by else Window.partitionBy(F.lit(0)))
    return cells.withColumn("share", F.round(F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0)), 6))


def wide(cells: DataFrame) -> DataFrame:
    """A row for each kind, a column for each kind, ready for a CSV sink."""
    return cells.groupBy("a").pivot("b", [*MARKERS]).agg(F.sum("n"))


def pair_statistics(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("pairs"), F.sum((F.col("n") > 0).cast("int")).alias("non_zero"), F.round(F.avg("n"), 6).alias("average"))


def fields(rows: DataFrame, text: Column, pattern: str) -> DataFrame:
    """field, n: how often each name that the pattern's first group finds occurs; blank, starred and long names are left out."""
    found = rows.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("field"))
    return found.where((F.col("field") != "") & ~F.startswith(F.col("field"), F.lit("*")) & (F.length("field") < 100)).groupBy("field").agg(F.count("*").alias("n"))
