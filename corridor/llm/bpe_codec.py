"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by an incremental UTF-8 state machine.

A word's bytes go through the transducer (see bpe.py), which emits ids after a bounded lookahead; words that have been read are stored with what they emit. The decoder
takes ids in blocks, and a character whose bytes lie in two blocks waits for its end. Null and empty texts have no ids, an empty table gives none. Rows are independent:
repeated and null ids keep a row each. Texts of any length are encoded whole. Other columns are left behind, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from corridor.llm import bpe
from corridor.llm.common import documents, map_arrow, uncollected
from corridor.llm.token_counts import Words

BLOCK = 1 << 15
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Utf8Machine:
    """Bytes in, whole characters out. The state is the start of a character whose end has not come yet; malformed bytes become U+FFFD."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            lead = data[cut - back]
            if lead & 0xC0 == 0x80:
                continue
            if back < (4 if 0xF0 <= lead <= 0xF4 else 3 if 0xE0 <= lead < 0xF0 else 2 if 0xC2 <= lead < 0xE0 else 1):
                cut -= back
            break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.held = self.held.decode("utf-8", "replace"), b""
        return rest


class Codec:
    def __init__(self, path: str, pattern: str) -> None:
        self.machine, self.pieces = bpe.from_ranks(path)
        self.decimal = [str(k) for k in range(len(self.pieces))]
        self.split = bpe.splitter(pattern)
        self.words = Words(lambda word: tuple(self.machine.ids(word.encode().decode("latin-1"))))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.split(text))))

    def bytes_of(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def decode(self, ids: list[int]) -> Iterator[str]:
        machine = Utf8Machine()
        for k in range(0, len(ids), BLOCK):
            yield machine.feed(self.bytes_of(ids[k : k + BLOCK]))
        yield machine.end()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                with uncollected():
                    ids = [own.encode(t.as_py() or "") for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_arrow(documents(docs), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; a null list of ids gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["".join(own.decode(x.as_py() or [])) for x in batch.column(1)], pa.string())], ["doc_id", "text"])

    return map_arrow(encoded.select(encoded["doc_id"].cast("long").alias("doc_id"), encoded["ids"]), run, "doc_id long, text string")


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Encodes and decodes every row in one pass: doc_id, n_tokens, sha256 of the decimal ids joined by a space, sha256 of the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in batches:
            sizes, coded, decoded = [], [], []
            with uncollected():
                for text in batch.column(1):
                    ids = own.encode(text.as_py() or "")
                    sizes.append(len(ids))
                    coded.append(hashlib.sha256(" ".join(map(own.decimal.__getitem__, ids)).encode()).hexdigest())
                    back = hashlib.sha256()
                    for piece in own.decode(ids):
                        back.update(piece.encode())
                    decoded.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(documents(docs), run, SCHEMA)
