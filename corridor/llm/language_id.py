"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the counts of hashed 1- to 3-grams of lower-case characters (digits and ASCII punctuation read as spaces), weighted by inverse document
frequency and scaled to unit length. Document frequencies cover every learnable text. The weights are trained by follow-the-regularised-leader with an
elastic-net penalty, which leaves most of them at zero: a model keeps the buckets that any language has a weight for. They are trained on a sample bounded by
``SLOTS`` documents a language and ``SAMPLE`` in all: the one of least hash in each slot that ids hash into, once however often it is repeated. A part of the
sample is left for calibration: one temperature that fits the probabilities to it. The sample is of the ``MOST`` commonest language values (ties by name), which are those
that can be predicted; so a model has at most MOST * 2^BITS weights, and travels as a broadcast of that bound.

A text that is null, empty or has no letter is ``und`` with score 0. Learnable are rows with an id, a text, a language and a fold other than the held-out one;
without any, every text is ``und``. An empty table gives none. Rows are independent; repeated and null ids keep a row each. Whole texts are read, in blocks of
bounded size. Columns beyond those named are left behind, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor.llm.common import map_arrow, remainder

BITS = 15
SLOTS, SAMPLE, MOST = 256, 16384, 1024
EPOCHS, ALPHA, BETA, L1, L2 = 4, 1.0, 1.0, 2e-3, 1e-3
BLOCK = 1 << 20
_LETTER = regex.compile(r"\p{L}")
_PLAIN = np.arange(128, dtype=np.uint32)
_PLAIN[[c for c in range(128) if not chr(c).isalpha()]] = 32


def grams(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text."""
    counts = np.zeros(1 << BITS, np.int64)
    shift = np.uint32(32 - BITS)
    for lo in range(0, len(text), BLOCK):
        part = text[max(0, lo - 2) : lo + BLOCK]
        c = np.frombuffer(part.lower().encode("utf-32-le"), np.uint32).copy()
        low = c < 128
        c[low] = _PLAIN[c[low]]
        if lo == 0:
            c = np.r_[np.uint32(32), c, np.uint32(32)]
        with np.errstate(over="ignore"):
            one = c * np.uint32(0x9E3779B1)
            two = one[:-1] + c[1:] * np.uint32(0x85EBCA6B) + np.uint32(0x5BD1E995)
            three = two[:-1] * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F)
        for h in (one, two, three):
            h ^= h >> np.uint32(15)
            counts += np.bincount((h * np.uint32(0x2C1B3C6D)) >> shift, minlength=1 << BITS)
    return counts


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


@dataclass
class Model:
    """languages; place: of each bucket, its column in weights, or -1 where all languages have none; inverse document frequencies; bias; temperature."""

    languages: list[str] = field(default_factory=list)
    place: np.ndarray | None = None
    weights: np.ndarray | None = None
    idf: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = counts * self.idf[at]
        norm, k = max(np.sqrt((x * x).sum()), 1e-12), self.place[at]
        return self.weights[:, k[k >= 0]] @ (x[k >= 0] / norm) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return "und", 0.0
        counts = grams(text)
        at = np.flatnonzero(counts)
        p = softmax(self.logits(at, counts[at]) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def follow(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by follow-the-regularised-leader over rows of (class, buckets, values); the last column is the bias, without penalty."""
    z, n = np.zeros((classes, size + 1)), np.zeros((classes, size + 1))
    l1, l2 = np.full(size + 1, L1), np.full(size + 1, L2)
    l1[size] = l2[size] = 0

    def at(k: np.ndarray) -> np.ndarray:
        rate = (BETA + np.sqrt(n[:, k])) / ALPHA + l2[k]
        return np.where(np.abs(z[:, k]) > l1[k], (np.sign(z[:, k]) * l1[k] - z[:, k]) / rate, 0.0)

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for r in order.permutation(len(rows)):
            y, k, x = rows[r]
            k, x = np.r_[k, size], np.r_[x, 1.0]
            w = at(k)
            error = softmax(w @ x)
            error[y] -= 1
            g = error[:, None] * x
            z[:, k] += g - (np.sqrt(n[:, k] + g * g) - np.sqrt(n[:, k])) / ALPHA * w
            n[:, k] += g * g
    w = at(np.arange(size + 1))
    return w[:, :size], w[:, size]


def temperature_of(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section over its logarithm."""
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean()
    lo, hi, g = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, folds: int = 4, held_out: int = 2) -> Model:
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (remainder(F.col("doc_id"), folds) != held_out))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                found += grams(text.as_py()) > 0
            total += batch.num_rows
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*found[at].tolist(), total], pa.int64())], ["bucket", "n"])

    sums = map_arrow(rows.select("text"), frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most 2^15 + 1 rows
    df = {r.bucket: r.n for r in sums}
    total = df.pop(-1, 0)
    idf = np.full(1 << BITS, np.log((1 + total) / 1) + 1)
    for k, n in df.items():
        idf[k] = np.log((1 + total) / (1 + n)) + 1

    common = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST).select("lang").collect()
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(common, "lang string")), "lang", "left_semi")  # MOST values at most
    slots = min(SLOTS, SAMPLE // max(len(common), 1))
    hashed = F.xxhash64("doc_id")
    slot, version = F.pmod(hashed, F.lit(slots)), F.xxhash64("text")
    picks = rows.groupBy("lang", slot.alias("slot")).agg(F.min(F.struct(hashed.alias("h"), F.col("doc_id"), version.alias("version"))).alias("p"))
    picks = picks.select("lang", "p.doc_id", "p.version")  # at most SAMPLE rows
    sample = rows.withColumn("version", version).join(F.broadcast(picks), ["lang", "doc_id", "version"]).select("lang", slot.alias("slot"), "text").dropDuplicates(["lang", "slot"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, counts = [], []
            for text in batch.column(2):
                own = grams(text.as_py())  # one text's buckets at a time
                at.append(np.flatnonzero(own).astype(np.int32))
                counts.append(own[at[-1]].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["lang", "slot", "at", "counts"])

    own = map_arrow(sample, features, "lang string, slot long, at array<int>, counts array<int>").orderBy("lang", "slot").collect()
    languages = sorted({r.lang for r in own})
    if not languages:
        return Model()
    place = {x: k for k, x in enumerate(languages)}
    fit, check = [], []
    for r in own:
        at, counts = np.array(r["at"], np.int64), np.array(r["counts"], np.float64)
        x = counts * idf[at]
        (check if r.slot < slots // 4 else fit).append((place[r.lang], at, x / max(np.sqrt((x * x).sum()), 1e-12)))
    fit, check = fit or check, check or fit
    weights, bias = follow(fit, len(languages), 1 << BITS)
    used = np.flatnonzero((weights != 0).any(0))
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    model = Model(languages, place, weights[:, used], idf, bias)
    logits = np.array([weights[:, at] @ x + bias for _, at, x in check])
    model.temperature = temperature_of(logits, np.array([y for y, _, _ in check])) if len(languages) > 1 else 1.0
    return model


def identify(docs: DataFrame, model: Model, *more: str) -> DataFrame:
    """The columns ``more`` of docs, and lang_pred and score of its text, of every row."""
    others = [docs[c].alias(f"_{k}") for k, c in enumerate(more)]
    rows = docs.select(docs["text"].cast("string").alias("_text"), *others)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [f.name for f in batch.schema][1:] + ["lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return map_arrow(rows, run, f"{schema}, lang_pred string, score double").toDF(*more, "lang_pred", "score")


def languages(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    found = identify(docs, train(docs, folds, held_out), "doc_id")
    own = F.col("doc_id").cast("long")
    return found.select(own.alias("doc_id"), F.coalesce(remainder(own, folds) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
