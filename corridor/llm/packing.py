"""Concatenate and cut: one stream of all tokens, cut into windows of fixed length, with a record for every piece.

First pass: every task encodes its documents, keeps their ids with the running token total inside its partition, and the result is a table in the shared
folder, so that the order it fixed can't change under retries. The totals of the partitions (one row each) get a prefix sum. Second pass: a document's
place in the stream is its partition's offset plus its running total, and from that its pieces follow without any look at other documents.

A document's ids are those of its text and the end id; a null text counts as empty. So every row yields at least one piece, repeated and null ids too, and an
empty table none. Texts of any length are encoded whole, one at a time, and cut freely. Other columns are left behind, whatever their names. The last sequence alone is short, and it is padded to a power of two if that is less than the window: see ``padded``.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corridor.llm.bpe import byte_characters
from corridor.llm.common import documents, map_arrow, uncollected, written

BROADCAST = 1_000_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids as the tokenizers library gives them for a byte-level file, special strings in texts included, by the byte-pair engine of tiktoken."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        own = spec["pre_tokenizer"]
        if own["type"] != "ByteLevel" or own["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path}: not plain byte-level BPE")
        byte = byte_characters()
        special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        ids = {bytes(byte[c] for c in piece): k for piece, k in spec["model"]["vocab"].items() if piece not in special}
        self.engine = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ids, special_tokens={})
        self.special = special
        self.split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.dtype = "<u2" if max([*ids.values(), *special.values(), 0]) < 1 << 16 else "<u4"

    def encode(self, text: str) -> list[int]:
        if not self.special or not any(s in text for s in self.special):
            return self.engine.encode_ordinary(text)
        out: list[int] = []
        for part in self.split.split(text):
            out += [self.special[part]] if part in self.special else self.engine.encode_ordinary(part)
        return out


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encoded(docs: DataFrame, vocabulary: str, pattern: str, end_id: int) -> DataFrame:
    """part, doc_id, ids (little-endian, of ``width`` bytes), before (tokens of the partition before it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, total = encoder(vocabulary, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some, ids, before = batch.slice(k, 512), [], []
                with uncollected():
                    for text in some.column(1):
                        one = np.array([*own.encode(text.as_py() or ""), end_id], own.dtype)
                        ids.append(one.tobytes())
                        before.append(total)
                        total += len(one)
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), some.column(0), pa.array(ids, pa.binary()), pa.array([int(own.dtype[-1])] * n, pa.int32()), pa.array(before, pa.int64())], ["part", "doc_id", "ids", "width", "before"])

    return map_arrow(documents(docs), run, "part int, doc_id long, ids binary, width int, before long")


def cut(ids: bytes, width: int, at: int, window: int) -> Iterator[tuple]:
    """(start, length, crc32, sequence, offset) of the pieces of one document that begins at token ``at`` of the stream."""
    wide = np.frombuffer(ids, f"<u{width}").astype("<u4")
    start = 0
    while start < len(wide):
        sequence, offset = divmod(at + start, window)
        length = min(len(wide) - start, window - offset)
        yield start, length, zlib.crc32(wide[start : start + length].tobytes()), sequence, offset
        start += length


def padded(length: int, window: int) -> int:
    """The stored length of a sequence: the window, or for a short one the next power of two if that is less."""
    return min(window, 1 << max(0, length - 1).bit_length())


def pack(docs: DataFrame, vocabulary: str, pattern: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """A row per piece, in the columns of ``PIECES``."""
    table = written(encoded(docs, vocabulary, pattern, end_id), "packing")
    totals = table.groupBy("part").agg(F.max(F.col("before") + F.length("ids") / F.col("width")).cast("long").alias("tokens"))
    offsets = written(totals.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("base")), "offsets")  # a row per partition of the first pass
    offsets = F.broadcast(offsets) if offsets.count() <= BROADCAST else offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids, width, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(ids) // width
                rows += [(doc_id, start, length, crc, n, sequence, offset) for start, length, crc, sequence, offset in cut(ids, width, at, window)]
            names = [c.split()[0] for c in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names)

    placed = table.join(offsets, "part").select("doc_id", "ids", "width", (F.col("base") + F.col("before")).alias("at"))
    return map_arrow(placed, run, PIECES)
