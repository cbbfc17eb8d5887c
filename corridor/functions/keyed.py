"""Deterministic draws: uniform numbers from md5 of a keyed string, the same in every run and engine; exact sampling and global ranks without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 12


def hashed(*parts: Column | str | int) -> Column:
    """The first 32 bits of md5 of the parts joined by ``|``."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    return hashed(*parts) / F.lit(float(1 << 32))


def ranked(rows: DataFrame, seed: str, *key: str) -> DataFrame:
    """Adds place: the row's number, from 1, in the order of its hash (ties by key). Rows are ranked inside hash buckets; a bucket's start is the sum of those before it."""
    own = rows.withColumn("_h", hashed(seed, *[F.col(k) for k in key])).withColumn("_b", (F.col("_h") / F.lit((1 << 32) // BUCKETS)).cast("int"))
    sizes = own.groupBy("_b").agg(F.count("*").alias("_n"))  # at most BUCKETS rows
    starts = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_start"))
    inside = own.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", *key)))
    return inside.join(F.broadcast(starts), "_b").withColumn("place", F.col("_start") + F.col("_r")).drop("_h", "_b", "_r", "_start")


def sample(rows: DataFrame, rate: float, seed: str, *key: str) -> DataFrame:
    """Exactly floor(rate * n) rows, without replacement."""
    n = int(rows.count() * rate)
    return ranked(rows, seed, *key).where(F.col("place") <= n).drop("place")
