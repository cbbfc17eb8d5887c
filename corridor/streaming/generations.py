"""Generated texts as a stream of files: parsed as they come, and planning errors kept as sums that later batches add to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corridor.functions.trajectory_text import parse_robust
from corridor.operators.planning import align, errors
from corridor.sources.files import GENERATION


def waypoints(spark: SparkSession, path: str) -> DataFrame:
    """A stream of token, t, x, y of the texts in a folder of JSON lines; what can't be parsed yields none."""
    texts = spark.readStream.schema(GENERATION).json(path)
    found = texts.select("token", parse_robust(F.col("generated_text")).alias("p"))
    return found.select("token", F.posexplode("p").alias("k", "w")).select("token", (F.col("k") + 1).alias("t"), F.col("w.x").alias("x"), F.col("w.y").alias("y"))


def sums(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """t, n, l2: mergeable sums of the errors of those tokens that pred has."""
    own = gt.join(pred.select("token").distinct(), "token", "left_semi")
    return errors(align(own, pred)).groupBy("t").agg(F.count("*").alias("n"), F.sum("l2").alias("l2"))


def merged(state: DataFrame) -> DataFrame:
    """The means of all batches' sums."""
    return state.groupBy("t").agg(F.sum("n").alias("n"), (F.sum("l2") / F.sum("n")).alias("l2"))


def run(spark: SparkSession, path: str, gt: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Reads what the folder holds, a batch at a time, into ``out``: one folder of sums a batch, so that a batch that runs again replaces its own."""

    def batch(df: DataFrame, number: int) -> None:
        sums(gt, df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return waypoints(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
