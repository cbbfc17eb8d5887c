"""Reading and writing annotation files, with explicit schemas. Malformed records are kept aside, never dropped silently."""

from __future__ import annotations

import io
import math
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
TURN = T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())])
#: Conversation rows as files hold them; media may be one path or a list, so they are read as text and made lists by ``media_list``.
CONVERSATION = T.StructType([T.StructField("token", T.StringType()), T.StructField("image", T.StringType()), T.StructField("video", T.StringType()), T.StructField("conversations", T.ArrayType(TURN))])
GENERATION = T.StructType([T.StructField(n, t) for n, t in (("sample_id", T.LongType()), ("token", T.StringType()), ("generated_text", T.StringType()), ("has_image", T.BooleanType()), ("has_video", T.BooleanType()), ("original_conversations", T.ArrayType(TURN)), ("finish_reason", T.StringType()))])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir, which is the checkpoint folder too. Where it is unset, a local session gets one of its own; a cluster is refused."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if not found and current.isDefined():
        found = current.get()
    if not found:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="corridor-")
    if current.isEmpty():
        context.setCheckpointDir(found)
    return found


def with_corrupt(schema: T.StructType) -> T.StructType:
    return schema if CORRUPT in schema.fieldNames() else T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def read_json(spark: SparkSession, path: str, schema: T.StructType, lines: bool) -> DataFrame:
    """A JSON array (or one object) a file, or an object a line; compressed files too. What doesn't parse is in ``_corrupt_record``."""
    return spark.read.schema(with_corrupt(schema)).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", not lines).json(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType, separator: str = "\t", line_ends_in_fields: bool = False, limit: int | None = None) -> DataFrame:
    """Delimited text with a header; empty fields are null. Files are split among tasks, unless quoted fields may hold line ends: then a file is one task. limit: that many rows, for a look."""
    rows = spark.read.schema(schema).option("sep", separator).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", line_ends_in_fields).csv(path)
    return rows if limit is None else rows.limit(limit)


def checksums(spark: SparkSession, path: str) -> set[str]:
    """The MD5 of every file of a folder, or of the file."""
    return {r.md5 for r in spark.read.format("binaryFile").load(path).select(F.md5("content").alias("md5")).collect()}  # a number a file


def read_checked(spark: SparkSession, path: str, schema: T.StructType, wanted: set[str], **options) -> DataFrame:
    """A table whose files have the wanted checksums; others are refused."""
    if (found := checksums(spark, path)) != wanted:
        raise ValueError(f"{path}: {len(found ^ wanted)} checksums differ")
    return read_table(spark, path, schema, **options)


class _Plain(pickle.Unpickler):
    """Loads numbers, texts, lists, dictionaries and NumPy arrays; names of anything else are refused, so that no file can run code."""

    #: What arrays are made of in pickles of either generation of NumPy.
    KNOWN = {("numpy", "ndarray"), ("numpy", "dtype"), *((f"numpy.{core}.multiarray", f) for core in ("core", "_core") for f in ("_reconstruct", "scalar")), ("numpy.core.numeric", "_frombuffer"), ("numpy._core.numeric", "_frombuffer"), ("collections", "OrderedDict")}

    def find_class(self, module: str, name: str):
        if (module, name) not in self.KNOWN:
            raise pickle.UnpicklingError(f"{module}.{name} is not data")
        return super().find_class(module, name)


def unpickled(rows: DataFrame, content: str) -> DataFrame:
    """token, t (from 1), x, y of pickled dictionaries of token to an n x 2 array, one a row (of binaryFile, say). What isn't one, or holds more than data, yields nothing."""
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b[content]:
                try:
                    paths = {str(k): np.asarray(v, float).reshape(-1, np.shape(v)[-1])[:, :2] for k, v in _Plain(io.BytesIO(data)).load().items()}
                except Exception:  # noqa: BLE001  any broken payload is none
                    continue
                if paths:  # a payload is one batch, not one a token
                    sizes, all_ = [len(v) for v in paths.values()], np.concatenate(list(paths.values()))
                    yield pd.DataFrame({"token": np.repeat(np.array(list(paths), object), sizes), "t": np.concatenate([np.arange(1, n + 1) for n in sizes]), "x": all_[:, 0], "y": all_[:, 1]})

    from corridor.functions.workers import shipped

    return shipped(rows).select(content).mapInPandas(run, "token string, t int, x double, y double")


def read_annotations(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """By suffix: .json, .jsonl (either may be .gz), .tsv, .csv, .parquet; others are refused."""
    name = path.rstrip("/").removesuffix(".gz")
    if name.endswith(".jsonl"):
        return read_json(spark, path, schema, True)
    if name.endswith(".json"):
        return read_json(spark, path, schema, False)
    if name.endswith((".tsv", ".csv")):
        return read_table(spark, path, schema, "\t" if name.endswith(".tsv") else ",")
    if name.endswith(".parquet"):
        return spark.read.schema(schema).parquet(path)
    raise ValueError(f"unknown kind of file: {path}")


def media_list(value: Column) -> Column:
    """One path or a JSON list of paths as a list; null as an empty one."""
    return F.when(value.isNull(), F.array().cast("array<string>")).when(F.startswith(value, F.lit("[")), F.from_json(value, "array<string>")).otherwise(F.array(value))


def registry(spark: SparkSession, names: str, known: dict[str, dict[str, str]], schema: T.StructType, key: str, seed: str = "42", read: Callable = read_annotations) -> DataFrame:
    """A comma list of data sets, each with an optional ``%N`` share, as one table with its data_path; unknown names are refused.

    A share of N percent keeps exactly floor(n * N / 100) rows, by the hash of ``key``.
    """
    from corridor.functions.keyed import sample

    out = None
    for entry in names.split(","):
        name, _, share = entry.strip().partition("%")
        if name not in known:
            raise ValueError(f"unknown data set: {name}")
        rows = read(spark, known[name]["annotation_path"], schema).withColumn("data_path", F.lit(known[name]["data_path"]))
        rows = sample(rows, int(share) / 100, seed, key) if share and int(share) < 100 else rows
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def resolved_images(rows: DataFrame) -> DataFrame:
    """Images of at most 64 characters name the row whose image is meant; each such row gets that image."""
    own = rows.select(F.col("index").alias("_i"), F.col("image").alias("_image"))
    refers = F.length("image") <= 64
    out = rows.join(own, refers & (F.col("image") == F.col("_i")), "left")
    return out.withColumn("image", F.when(refers, F.col("_image")).otherwise(F.col("image"))).drop("_i", "_image")


def decoded(rows: DataFrame, column: str) -> DataFrame:
    """Adds bytes: the base64 payload, null where it is none."""
    return rows.withColumn("bytes", F.try_to_binary(F.col(column), F.lit("base64")))


def point_read(spark: SparkSession, path: str, column: str, value) -> DataFrame:
    """The rows of one key of a table partitioned by it: a partition is read, not the table."""
    return spark.read.parquet(path).where(F.col(column) == value)


def write_lines(rows: DataFrame, path: str) -> None:
    """An object a line; Spark's commit makes the folder appear complete or not at all."""
    rows.write.mode("overwrite").json(path)


def write_table(rows: DataFrame, path: str, separator: str = ",") -> None:
    rows.write.mode("overwrite").option("header", True).option("sep", separator).csv(path)


def write_arrays(rows: DataFrame, path: str, per_file: int = 50_000) -> None:
    """JSON arrays, one a file of about ``per_file`` rows."""
    files = max(1, math.ceil(rows.count() / per_file))
    dealt = rows.select(F.pmod(F.xxhash64(*rows.columns), F.lit(files)).alias("file"), F.struct(*rows.columns).alias("row"))
    dealt.groupBy("file").agg(F.to_json(F.collect_list("row")).alias("value")).write.mode("overwrite").partitionBy("file").text(path)


def write_split(rows: DataFrame, valid: Column, path: str) -> None:
    """Valid rows to ``valid=true`` of a folder, all others (null verdicts too) to ``valid=false``, in one pass."""
    rows.withColumn("valid", F.coalesce(valid, F.lit(False))).write.mode("overwrite").partitionBy("valid").json(path)


def write_stamped(rows: DataFrame, folder: str, name: str, stamp: str, separator: str = "\t") -> str:
    """A table under a name of its own for each run, ``{name}_{stamp}.tsv``; returns its path."""
    path = f"{folder}/{name}_{stamp}.{'tsv' if separator == chr(9) else 'csv'}"
    write_table(rows, path, separator)
    return path


def write_result(rows: DataFrame, summary: DataFrame, path: str) -> None:
    write_table(rows, f"{path}/rows")
    write_lines(summary, f"{path}/summary")


def version(spark: SparkSession, path: str) -> str:
    """Changes whenever a file of a folder does: a hash of names, sizes and times."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at))
    return f"{hash_text(repr(files)):016x}"


def hash_text(text: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big")


def staged(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage's table: read if it has been completed before, else made and written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
