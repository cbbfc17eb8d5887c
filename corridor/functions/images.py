"""Sizes of images from their first bytes: PNG, JPEG, GIF and WebP headers, without decoding a pixel."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.functions.workers import shipped

HEADER = "format string, width int, height int, channels int"
#: Fixed values of the formats: samples a pixel by PNG colour type, JPEG markers that stand alone, and those that begin a frame.
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
ALONE = frozenset([0x01, *range(0xD0, 0xD9)])
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def png(b: bytes) -> tuple[int, int, int] | None:
    if len(b) < 26 or b[12:16] != b"IHDR" or b[25] not in PNG_CHANNELS:
        return None
    return int.from_bytes(b[16:20], "big"), int.from_bytes(b[20:24], "big"), PNG_CHANNELS[b[25]]


def jpeg(b: bytes) -> tuple[int, int, int] | None:
    """Walks from marker to marker, each with its length, to the first frame header."""
    at = 2
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            return None
        mark = b[at + 1]
        if mark == 0xFF or mark in ALONE:  # fill byte, or a marker without a body
            at += 1 if mark == 0xFF else 2
            continue
        size = int.from_bytes(b[at + 2 : at + 4], "big")
        if mark in FRAMES:
            if size < 8 or at + 10 > len(b):
                return None
            return int.from_bytes(b[at + 7 : at + 9], "big"), int.from_bytes(b[at + 5 : at + 7], "big"), b[at + 9]
        if size < 2 or mark in (0xD9, 0xDA):
            return None
        at += 2 + size
    return None


def gif(b: bytes) -> tuple[int, int, int] | None:
    return (int.from_bytes(b[6:8], "little"), int.from_bytes(b[8:10], "little"), 1) if len(b) >= 10 else None


def webp(b: bytes) -> tuple[int, int, int] | None:
    kind = b[12:16]
    if kind == b"VP8 " and len(b) >= 30 and b[23:26] == b"\x9d\x01\x2a":
        return int.from_bytes(b[26:28], "little") & 0x3FFF, int.from_bytes(b[28:30], "little") & 0x3FFF, 3
    if kind == b"VP8L" and len(b) >= 25 and b[20] == 0x2F:
        n = int.from_bytes(b[21:25], "little")
        return (n & 0x3FFF) + 1, (n >> 14 & 0x3FFF) + 1, 4 if n >> 28 & 1 else 3
    if kind == b"VP8X" and len(b) >= 30:
        return int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1, 4 if b[20] & 0x10 else 3
    return None


def header(b: bytes | None) -> tuple[str, int, int, int] | None:
    """(format, width, height, channels), None for what is no image of these formats, broken off before its size, or empty in a direction."""
    if not b:
        return None
    for name, starts, read in (("png", b[:8] == b"\x89PNG\r\n\x1a\n", png), ("jpeg", b[:2] == b"\xff\xd8", jpeg), ("gif", b[:6] in (b"GIF87a", b"GIF89a"), gif), ("webp", b[:4] == b"RIFF" and b[8:12] == b"WEBP", webp)):
        if starts:
            found = read(b)
            return (name, *found) if found and 0 < found[0] < 1 << 31 and 0 < found[1] < 1 << 31 and found[2] else None
    return None


def image_bytes(value: Column) -> Column:
    """The bytes of a data URI in base64, null for any other value and for broken base64."""
    return F.when(value.rlike(r"(?s)^data:image[^,]*;base64,"), F.try_to_binary(F.regexp_extract(value, r"(?s)^data:image[^,]*;base64,(.*)$", 1), F.lit("base64")))


def with_headers(rows: DataFrame, content: str, name: str = "image") -> DataFrame:
    """Adds a struct of format, width, height and channels (samples a pixel as stored), null for what can't be read. content: a column of bytes, such as binaryFile gives."""

    @F.pandas_udf(HEADER)
    def read(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([header(bytes(v) if v is not None else None) or (None, None, None, None) for v in values], columns=["format", "width", "height", "channels"]).astype({c: "Int32" for c in ("width", "height", "channels")})

    found = shipped(rows).withColumn(name, read(F.col(content)))
    return found.withColumn(name, F.when(F.col(f"{name}.format").isNotNull(), F.col(name)))
