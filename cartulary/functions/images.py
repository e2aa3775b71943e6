"""Kind and size of images, from their first bytes."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


def dimensions(data: bytes) -> tuple[str, int, int] | None:
    """PNG, GIF, WebP, JPEG or AVIF; None for other or cut off content."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
            return "png", *struct.unpack(">II", data[16:24])
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return "gif", *struct.unpack("<HH", data[6:10])
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return _webp(data)
        if data[:2] == b"\xff\xd8":
            return _jpeg(data)
        if data[4:12] in (b"ftypavif", b"ftypavis"):
            at = data.find(b"ispe", 12)  # the first item's spatial extents, after the box's version
            return ("avif", *struct.unpack(">II", data[at + 8 : at + 16])) if at > 0 else None
    except (struct.error, IndexError):
        pass
    return None


def _webp(data: bytes) -> tuple[str, int, int] | None:
    kind = data[12:16]
    if kind == b"VP8X":
        return "webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
    if kind == b"VP8L":
        bits = struct.unpack("<I", data[21:25])[0]
        return "webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if kind == b"VP8 ":
        w, h = struct.unpack("<HH", data[26:30])
        return "webp", w & 0x3FFF, h & 0x3FFF
    return None


def _jpeg(data: bytes) -> tuple[str, int, int] | None:
    at = 2
    while data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF or marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):  # a start of frame
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return "jpeg", width, height
        at += 2 + size
    return None


@F.pandas_udf(SIZE)
def image_size(content: pd.Series) -> pd.DataFrame:
    """kind, width and height of binary contents; nulls for what is no image."""
    found = [(None if c is None else dimensions(bytes(c))) or (None, None, None) for c in content]
    return pd.DataFrame(found, columns=["kind", "width", "height"]).astype({"width": "Int32", "height": "Int32"})
