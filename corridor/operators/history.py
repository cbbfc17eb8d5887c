"""What of a conversation fits into a budget of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers a stretch; sums go over stretches first, so a conversation of any length is no task's alone.
STRETCH = 1024


def suffix_sums(turns: DataFrame, by: str, turn: str, tokens: str) -> DataFrame:
    """Adds upto: the tokens of a turn and all later ones of its conversation. Turns of one number come in the order of what they hold, the same in every run."""
    own = turns.withColumn("_s", F.floor(F.col(turn) / STRETCH))
    sums = own.groupBy(by, "_s").agg(F.sum(tokens).alias("_n"))
    later = sums.withColumn("_later", F.sum("_n").over(Window.partitionBy(by).orderBy(F.desc("_s"))) - F.col("_n")).drop("_n")
    content = F.xxhash64(*[F.col(c) for c in sorted(turns.columns)])
    inside = Window.partitionBy(by, "_s").orderBy(F.desc(turn), content).rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("_in", F.sum(tokens).over(inside)).join(later, [by, "_s"]).withColumn("upto", F.col("_in") + F.col("_later")).drop("_s", "_in", "_later")


def within_budget(turns: DataFrame, budget: int, by: str = "conv_id", turn: str = "turn", tokens: str = "tokens", role: str = "role") -> DataFrame:
    """The turns that stay: the whole conversation if it fits, else what begins with the earliest of the user's turns, the first turn aside, from which on all fits.

    Whole turns are dropped, oldest first, each with the answers to it. A newest stretch that is over the budget by itself leaves nothing: the conversation has no rows.
    Null token counts are zero; rows without a conversation or turn are left out. Equal turn numbers stay or go together with the first of them. All columns are kept, and ``upto`` added.
    """
    own = turns.where(F.col(by).isNotNull() & F.col(turn).isNotNull()).withColumn(tokens, F.coalesce(F.col(tokens), F.lit(0)))
    summed = suffix_sums(own, by, turn, tokens)
    at = summed.groupBy(by, turn).agg(F.max("upto").alias("_upto"), F.max((F.col(role) == "user").cast("int")).alias("_user"))
    whole = at.groupBy(by).agg(F.min(turn).alias("_first"), F.max("_upto").alias("_all"), F.min(F.when((F.col("_user") == 1) & (F.col("_upto") <= budget), F.col(turn))).alias("_start"))
    starts = whole.select(by, F.when(F.col("_all") <= budget, F.col("_first")).otherwise(F.col("_start")).alias("_start")).where("_start IS NOT NULL")
    return summed.join(starts, by).where(F.col(turn) >= F.col("_start")).drop("_start")
