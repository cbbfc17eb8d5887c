"""Sums over a folder of Parquet files, kept file by file, so that a new file costs one file's reading.

The cache is a folder of generations; a generation is a Parquet table with a row for each file that it has counted: path, length, time of change, and the file's sums by
group. A generation counts only once Spark has committed it (its _SUCCESS file is written last), so a job that is killed leaves nothing behind that is read. A file is known
by path, length and time; one that was changed is counted again, one that is gone is left out, whatever generations still hold of it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE = ["path", "length", "changed"]
#: Committed generations from which on they are written together as one.
MANY = 16


AT = ["_metadata.file_path AS path", "_metadata.file_size AS length", "unix_millis(_metadata.file_modification_time) AS changed"]


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """path, length, changed (milliseconds) of a folder's Parquet files, and name, by which they are read; their contents are not read here."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return found.selectExpr(*AT, "path AS name")


def generations(spark: SparkSession, cache: str) -> list[str]:
    """Folders of committed generations."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(cache)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "generation-*/_SUCCESS"))
    return sorted(str(f.getPath().getParent()) for f in found or [])


def _schema(spark: SparkSession, source: T.StructType, keys: list[str], values: dict[str, Column]) -> T.StructType:
    of = spark.createDataFrame([], source)
    group = of.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in values.items()]).schema
    return T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType()), T.StructField("changed", T.LongType()), T.StructField("sums", T.ArrayType(group))])


def _written(rows: DataFrame, cache: str) -> None:
    rows.write.parquet(f"{cache.rstrip('/')}/generation-{uuid.uuid4().hex}")


def file_sums(spark: SparkSession, path: str, schema: T.StructType, cache: str, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """keys and, for each of values, its sum over all rows of the folder's files. keys: columns of the table; values: expressions on it. Of the same cache, keys and values must be the same each time."""
    counted = _schema(spark, schema, keys, values)
    own = generations(spark, cache)
    known = spark.read.schema(counted).parquet(*own) if own else spark.createDataFrame([], counted)
    present = files_of(spark, path)
    new = present.join(known, FILE, "left_anti")
    names = [r.name for r in new.select("name").collect()]  # of what has come since
    if names:
        fresh = spark.read.schema(schema).parquet(*names).select(*keys, *[c.alias(n) for n, c in values.items()], *map(F.expr, AT))
        each = fresh.groupBy(*FILE, *keys).agg(*[F.sum(n).alias(n) for n in values]).groupBy(*FILE).agg(F.collect_list(F.struct(*keys, *values)).alias("sums"))  # a file's groups
        none = F.array().cast(counted["sums"].dataType)  # a file without rows is counted, too
        _written(new.select(*FILE).join(each, FILE, "left").select(*FILE, F.coalesce("sums", none).alias("sums")), cache)
        own = generations(spark, cache)
        known = spark.read.schema(counted).parquet(*own)
    if len(own) > MANY:
        _written(known.dropDuplicates(FILE).join(present, FILE, "left_semi"), cache)
        for old in own:  # what is committed as one needs its parts no more
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        known = spark.read.schema(counted).parquet(*generations(spark, cache))
    rows = known.join(present, FILE, "left_semi").dropDuplicates(FILE).select(F.explode("sums").alias("s")).select("s.*")
    return rows.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in values])

