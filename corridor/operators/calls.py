"""Calls of a model as rows: a ledger of attempts, with deadlines, waiting times and a fallback.

Every attempt is a row of the ledger: key, attempt (from 1), at (when it began, in seconds), seconds (how long it took), status (answered, failed or late) and answer. What is
answered is never asked again; what failed waits twice as long each time; what has failed too often gets a fallback that depends on the request alone. Requests go out in
slices, and a slice's attempts are committed together, so a job that is killed repeats the calls of one slice at most and no answer that was committed.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corridor.functions.workers import shipped

LEDGER = "key string, attempt int, at double, seconds double, status string, answer string"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """All committed attempts; none where nothing has been written yet."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(root, "slice-*/_SUCCESS"))
    own = [str(f.getPath().getParent()) for f in found or []]
    return spark.read.schema(LEDGER).parquet(*own) if own else spark.createDataFrame([], LEDGER)


def states(requests: DataFrame, attempts: DataFrame, most: int = 3, wait: float = 1.0) -> DataFrame:
    """key, attempts, status (answered, open or given up), answer, due: when the next attempt may begin. requests: key; a key that comes several times is one request, a null key none."""
    tried = attempts.groupBy("key").agg(F.max("attempt").alias("attempts"), F.max(F.col("at") + F.col("seconds")).alias("last"), F.min_by("answer", F.when(F.col("status") == "answered", F.col("attempt"))).alias("answer"), F.max(F.col("status") == "answered").alias("done"))
    own = requests.where("key IS NOT NULL").select(F.col("key").cast("string").alias("key")).distinct().join(tried, "key", "left")
    n = F.coalesce("attempts", F.lit(0))
    status = F.when(F.coalesce("done", F.lit(False)), "answered").when(n >= most, "given up").otherwise("open")
    return own.select("key", n.alias("attempts"), status.alias("status"), "answer", F.when(n > 0, F.col("last") + F.lit(wait) * F.pow(F.lit(2.0), n - 1)).otherwise(F.lit(float("-inf"))).alias("due"))


def call_due(requests: DataFrame, path: str, model: Callable[[pd.DataFrame], pd.Series], now: float, deadline: float = 60.0, most: int = 3, wait: float = 1.0, slices: int = 8, batch: int = 64, clock: Callable[[], float] = time.monotonic) -> int:
    """Asks for what is open and due; returns how many slices were committed. requests: key, prompt. model: a batch of key, attempt and prompt to a series of answers; null is a failure.

    A batch that raises fails as a whole, one that takes longer than the deadline is late and its answers don't count. Slices without a due request write nothing.
    """
    spark, done = requests.sparkSession, 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), batch):
                some = b.iloc[lo : lo + batch].reset_index(drop=True)
                began = clock()
                try:
                    answers = pd.Series(list(model(some)), dtype=object)
                    if len(answers) != len(some):
                        raise ValueError("a model must give an answer for each request")
                except Exception:  # noqa: BLE001  whatever a model raises is a failed attempt
                    answers = pd.Series([None] * len(some), dtype=object)
                took = clock() - began
                late = took > deadline
                good = answers.notna() & (not late)
                yield pd.DataFrame({"key": some["key"], "attempt": some["attempt"], "at": now, "seconds": took, "status": ["late" if late else "answered" if g else "failed" for g in good], "answer": answers.where(good, None)})

    for k in range(slices):
        mine = requests.where(F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(slices)) == k)
        due = states(mine, ledger(spark, path), most, wait).where((F.col("status") == "open") & (F.col("due") <= now)).select("key", (F.col("attempts") + 1).alias("attempt"))
        prompts = mine.groupBy(F.col("key").cast("string").alias("key")).agg(F.min("prompt").alias("prompt"))
        rows = shipped(due.join(prompts, "key")).select("key", "attempt", "prompt")
        if not rows.isEmpty():
            rows.mapInPandas(run, LEDGER).write.parquet(f"{path.rstrip('/')}/slice-{uuid.uuid4().hex}")
            done += 1
    return done


def answers(requests: DataFrame, attempts: DataFrame, fallback: Column, most: int = 3) -> DataFrame:
    """All columns of requests and answer, status: the first answer, the fallback (an expression on requests) where attempts are used up, null while open. Rows of one key get one answer each."""
    found = states(requests, attempts, most).select(F.col("key").alias("_key"), F.col("status"), F.col("answer"))
    own = requests.join(found, requests["key"].cast("string") == found["_key"], "left").drop("_key")
    return own.withColumn("answer", F.when(F.col("status") == "given up", fallback).otherwise(F.col("answer")))
