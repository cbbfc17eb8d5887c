"""What the corpus operators share: Arrow mapping, tables in the shared folder, fixed hashes."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corridor.sources.files import shared_folder

_WRITTEN: list[str] = []
BATCH = 2048
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it again: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/corridor-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many tables this process has written: what is written from now on can be dropped by ``drop_written(spark, mark)``."""
    return len(_WRITTEN)


def drop_written(spark: SparkSession, since: int = 0, *but: DataFrame) -> None:
    """Deletes the tables that this process has written since a mark, but for those that the given frames were read from. For when nothing else reads them any more."""
    stay = {p for df in but for p in _WRITTEN if any(p.split("/")[-1] in f for f in df.inputFiles()[:1])}
    jvm = spark.sparkContext._jvm
    for path in [p for p in _WRITTEN[since:] if p not in stay]:
        _WRITTEN.remove(path)
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    jvm.System.gc()  # lets Spark see which shuffles nothing can read any more, and delete their files


#: A key is hot that has more than UNIT rows and more than one in HOT of all; so there are fewer than HOT hot keys, whatever the data.
HOT, UNIT = 2000, 1000


def even_join(rows: DataFrame, others: DataFrame, keys: list[str], how: str = "inner", spread: list[str] | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """rows joined (inner, left or left_semi) with others, which have few rows a key; no task gets all rows of a hot key.

    A hot key's rows are dealt out by a hash of the columns ``spread`` (all but the keys, if not named), and the others' rows of that key are copied to each of these
    parts. Only the hot keys, fewer than HOT, are broadcast. sizes: keys and ``rows`` a key, if known: then ``rows`` are read by the join alone. Keys must not be null.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("rows")) if sizes is None else sizes.select(*keys, "rows")
    seen = Observation()
    large = written(sizes.observe(seen, F.sum("rows").alias("rows")).where(F.col("rows") > UNIT), "large")  # the total and the large keys in one job
    unit = F.greatest(F.lit(UNIT), F.floor(F.lit(seen.get["rows"] or 0) / F.lit(HOT)))
    hot = F.broadcast(large.where(F.col("rows") > unit).select(*keys, F.ceil(F.col("rows") / unit).alias("_parts")))
    spread = [c for c in rows.columns if c not in keys] if spread is None else spread
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    left = rows.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*spread), parts) if spread else F.lit(0).cast("long")).drop("_parts")
    right = others.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return left.join(right, [*keys, "_part"], how).drop("_part")


@contextmanager
def uncollected():
    """No cycle collection inside, and none of what was made inside after it: the stored words and transitions of a tokenizer are many objects without a cycle to find. Collection goes on for all else."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        gc.freeze()
        if on:
            gc.enable()


def tidied(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function; when a task is through with it, its worker, which goes on to others, gives back what it no longer needs: garbage (frozen objects included), Arrow's pool and the allocator's free pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            gc.unfreeze()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with this package on the workers' path, in batches of at most BATCH rows: texts may be long, and a batch is held by Spark and by Python."""
    ship(df.sparkSession)
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH:
        conf.set(name, str(BATCH))
    return df.mapInArrow(tidied(fn), schema)


def ship(spark: SparkSession) -> None:
    """Lets local workers import this package when the driver found it by sys.path alone; on a cluster it is installed or sent with --py-files."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """Id, text and the named columns of a documents table; other columns, whatever their names, stay behind."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *[docs[c] for c in more])


def remainder(column, n: int):
    """crc32 of an id's decimal text modulo n: the fold of a document. A null id falls into no fold."""
    return F.crc32(column.cast("string")) % F.lit(n)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A fixed, well mixed 64-bit hash of unsigned integers."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)).astype(np.uint64)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xA0761D6478BD642F)
        x ^= x >> np.uint64(32)
    return x


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
