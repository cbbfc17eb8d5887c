"""Refinement of sampled reasoning: log-weights, softmax, resampling, corpus loss. Latents are rows of an id, k, lp_post, lp_prior."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corridor.functions.keyed import uniform


def prior_log_probability(tokens: DataFrame, prefix: int, *key: str) -> DataFrame:
    """key, lp: the sum of token log-probabilities from position ``prefix`` on; nulls are skipped."""
    return tokens.groupBy(*key).agg(F.coalesce(F.sum(F.when(F.col("pos") >= prefix, F.col("lp"))), F.lit(0.0)).alias("lp"))


def weights(latents: DataFrame, key: str) -> DataFrame:
    """Adds log_weight (prior minus posterior) and weight: its softmax over the latents of a key, shifted by the greatest."""
    own = Window.partitionBy(key)
    rows = latents.withColumn("log_weight", F.col("lp_prior") - F.col("lp_post"))
    rows = rows.withColumn("_e", F.exp(F.col("log_weight") - F.max("log_weight").over(own)))
    return rows.withColumn("weight", F.col("_e") / F.sum("_e").over(own)).drop("_e")


def resample(weighted: DataFrame, key: str, draws: int, seed: str) -> DataFrame:
    """key, draw, k: categorical draws with replacement, by the inverse of the running weight at a keyed uniform number."""
    order = Window.partitionBy(key).orderBy("k")
    rows = weighted.withColumn("_to", F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    per_key = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_to", "k"))).alias("c"), F.max("k").alias("last"))
    drawn = per_key.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("u", uniform("u", seed, F.col(key), F.col("draw")))
    first = F.get(F.filter("c", lambda x: x["_to"] > F.col("u")), 0)["k"]
    return drawn.select(key, "draw", F.coalesce(first, F.col("last")).alias("k"))


def refined(drawn: DataFrame, weighted: DataFrame, key: str) -> DataFrame:
    """One row for each draw: joint log-probability, generation log-probability and weight of the latent; all are prior rows."""
    return drawn.join(weighted, [key, "k"]).select(key, "draw", "k", F.col("lp_prior").alias("joint_prob"), F.col("lp_post").alias("generation_prob"), "weight", F.lit("prior").alias("conversation_type"))


def corpus_loss(tokens: DataFrame) -> DataFrame:
    """tokens, loss (mean negative log-probability), perplexity over all tokens."""
    return tokens.where("lp IS NOT NULL").agg(F.count("*").alias("tokens"), F.sum(-F.col("lp")).alias("s")).select("tokens", F.round(F.col("s") / F.col("tokens"), 6).alias("loss"), F.round(F.exp(F.col("s") / F.col("tokens")), 3).alias("perplexity"))


def unflattened(outputs: DataFrame, spans: DataFrame, *key: str) -> DataFrame:
    """key, k (from 0) and the columns of the outputs that belong to each row of key, start, length; outputs have place, from 0. Places past the end have null outputs."""
    each = spans.where("length > 0").select(*key, "start", F.posexplode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("k", "place"))
    return each.join(outputs, "place", "left").drop("start", "place")


def type_counts(rows: DataFrame, column: str = "conversation_type") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))
