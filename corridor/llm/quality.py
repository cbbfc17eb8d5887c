"""Text quality: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

``statistics`` reads a whole text: shares of character classes, repetition of words, lines and bytes, lengths. Standardised, they go through random Fourier
features, whose products approximate a Gaussian kernel. Each partition of the labelled rows adds up its part of the normal equations; their sum is solved on
the driver, D by D numbers however many rows. Isotonic regression, on rows that the ridge fit did not see, turns its values into probabilities of label 1.

The fit takes the documents of at most ``SAMPLE`` labels, those of least hash; of repeated rows of a document one, of least text hash. Null texts count as empty;
the statistics of an empty text are zeros; texts of any length are read whole, one at a time. A document with several labels has their mean. Without labels
every score is 0.5; with one label alone, that label. An empty table gives none. Rows are independent; repeated and null ids keep a row each, and a null id
falls into no fold and has no label. Columns beyond those named are left behind, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor.llm.common import documents, map_arrow, remainder, written

SAMPLE, FEATURES, RIDGE = 20_000, 192, 1e-3
_CLASSES = np.zeros(256, np.intp)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\f\v", "\n", ".,;:'\"()-", "!?", "#$%&*@^~+=/\\_<>[]{}`", "|"), 1):
    _CLASSES[[ord(c) for c in _chars]] = _k
_CLASSES[128:] = 10
_END = re.compile(r"[.!?]+")


def statistics(text: str | None) -> np.ndarray:
    data = (text or "").encode()
    if not data:
        return np.zeros(20)
    shares = np.bincount(_CLASSES[np.frombuffer(data, np.uint8)], minlength=11) / len(data)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = len(words)
    kinds = set(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    squeezed = zlib.compressobj(1)
    size = sum(len(squeezed.compress(data[k : k + 65536])) for k in range(0, len(data), 65536)) + len(squeezed.flush())
    long = sum(map(len, words))
    marked = shares[5] + shares[6] + shares[7] + shares[8]
    return np.array([*shares, np.log1p(n), len(kinds) / max(n, 1), pairs / max(n - 1, 1) if n > 1 else 1.0, len(set(lines)) / max(len(lines), 1), np.log1p(n / max(len(lines), 1)), long / max(n, 1) / 10, np.log1p(n / (1 + len(_END.findall(text)))), min(size / len(data), 1.5), marked * len(data) / max(n, 1)])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    values: np.ndarray
    constant: float | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / len(self.phases)) * np.cos(z @ self.waves + self.phases)])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.clip(np.interp(self.features(x) @ self.weights, self.steps, self.values), 0, 1)


def isotonic(x: np.ndarray, total: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools neighbours, in the order of x, until the shares of good ones rise from pool to pool. Returns the pools' mean x and shares; both ascend."""
    pools: list[list[float]] = []
    for a, n, g in zip(x, total, good, strict=True):
        pools.append([a * n, n, g])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            s, n2, g2 = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n2, pools[-1][2] + g2]
    return np.array([s / n for s, n, _ in pools]), np.array([g / n for _, n, g in pools])


def measured(docs: DataFrame, *more: str) -> DataFrame:
    """The columns ``more`` and x, the statistics of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([statistics(t.as_py()) for t in batch.column(0)], pa.list_(pa.float64()))], [f.name for f in batch.schema][1:] + ["x"])

    rows = docs.select("text", *more)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return map_arrow(rows, run, f"{schema}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> Model:
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("double").alias("y"))
    marks = marks.where(F.col("y").isNotNull() & (remainder(F.col("doc_id"), folds) != held_out)).groupBy("doc_id").agg(F.avg("y").alias("y"))
    marks = written(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE), "labels")  # SAMPLE rows bound the broadcast
    own = documents(docs).join(F.broadcast(marks), "doc_id")
    first = own.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("h"))
    own = own.join(F.broadcast(first), "doc_id").where(F.xxhash64("text").eqNullSafe(F.col("h"))).dropDuplicates(["doc_id"])  # SAMPLE rows at most, however often an id is repeated
    own = written(measured(own.withColumn("calibrates", remainder(F.col("doc_id"), folds) == (held_out + folds - 1) % folds), "y", "calibrates"), "statistics")
    stats = own.select(F.col("y"), F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("scale")).orderBy("k").collect()
    range_ = own.agg(F.min("y"), F.max("y")).first()
    if range_[0] is None or range_[0] == range_[1]:
        return Model(*(np.zeros(0) for _ in range(7)), constant=0.5 if range_[0] is None else float(range_[0]))
    rng = np.random.default_rng(11)
    d = len(stats)
    model = Model(np.array([r["mean"] for r in stats]), np.array([r["scale"] or 1.0 for r in stats]) + 1e-6, rng.normal(size=(d, FEATURES)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(0), np.zeros(0), np.zeros(0))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            if len(y):
                z = model.features(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1))
                total += z.T @ np.column_stack([z, y])
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel(), pa.float64())], ["i", "j", "v"])

    sums = map_arrow(own.where("not calibrates").select("y", "x"), equations, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # (FEATURES + 1) * (FEATURES + 2) rows
    both = np.zeros((FEATURES + 1, FEATURES + 2))
    for r in sums:
        both[r.i, r.j] = r.v
    left = both[:, :-1] + np.eye(FEATURES + 1) * RIDGE * max(both[0, 0], 1.0)
    model.weights = np.linalg.solve(left, both[:, -1])

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if n := batch.num_rows:
                v = model.features(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)) @ model.weights
                yield pa.RecordBatch.from_arrays([pa.array(np.round(v, 3)), batch.column(0)], ["v", "y"])

    bins = map_arrow(own.where("calibrates").select("y", "x"), values, "v double, y double").groupBy("v").agg(F.count("*").alias("n"), F.sum("y").alias("good")).orderBy("v").collect()  # values lie within a few units, by thousandths
    if not bins:
        bins = [{"v": v, "n": 1, "good": v} for v in (0.0, 1.0)]
    model.steps, model.values = isotonic(*(np.array([float(r[c]) for r in bins]) for c in ("v", "n", "good")))
    return model


def scored(docs: DataFrame, model: Model, *more: str) -> DataFrame:
    """The columns ``more`` of docs and the score of its text, of every row."""
    rows = docs.select(docs["text"].cast("string").alias("_text"), *[docs[c].alias(f"_{k}") for k, c in enumerate(more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                x = np.array([statistics(t.as_py()) for t in part.column(0)])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(model.score(x), pa.float64())], [f.name for f in part.schema][1:] + ["score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return map_arrow(rows, run, f"{schema}, score double").toDF(*more, "score")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    found = scored(docs, train(docs, labels, folds, held_out), "doc_id")
    own = F.col("doc_id").cast("long")
    return found.select(own.alias("doc_id"), F.coalesce(remainder(own, folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
