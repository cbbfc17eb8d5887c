"""Chains given by links alone: the place of every row, by doubling pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor.sources.files import shared_folder


def walk(links: DataFrame, key: str, following: str) -> DataFrame:
    """key, start, place: the first row of each row's chain and its number in it, from 1. ``following`` is the next row's key, null at an end.

    A row's pointer skips twice as far back each round, so chains of n rows take log2(n) rounds of one join. A row of a ring has no first one: start and place are null.
    """
    shared_folder(links.sparkSession)
    own = links.select(F.col(key).alias("k"), F.col(following).alias("n")).where("k IS NOT NULL")
    back = own.where("n IS NOT NULL").select(F.col("n").alias("k"), F.col("k").alias("p"))
    at = own.select("k").distinct().join(back, "k", "left").select("k", F.coalesce("p", "k").alias("p"), F.col("p").isNotNull().cast("long").alias("d")).checkpoint()
    starts = at.where("d = 0").select(F.col("k").alias("p"))
    for _ in range(at.count().bit_length()):  # by then every chain has been walked; what hasn't reached a start is on a ring
        if at.join(starts, "p", "left_anti").isEmpty():
            break
        far = at.select(F.col("k").alias("p"), F.col("p").alias("p2"), F.col("d").alias("d2"))
        at = at.join(far, "p").select("k", F.col("p2").alias("p"), (F.col("d") + F.col("d2")).alias("d")).checkpoint()
    found = at.join(starts.withColumn("whole", F.lit(True)), "p", "left")
    return found.select(F.col("k").alias(key), F.when(F.col("whole"), F.col("p")).alias("start"), F.when(F.col("whole"), F.col("d") + 1).alias("place"))
