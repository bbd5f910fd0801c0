"""Format and size of images from their first bytes, and limits on them."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import ship


def probe(data: bytes | None) -> tuple[str, int, int] | None:
    """(format, width, height) of PNG, GIF, BMP, JPEG or WEBP bytes; None for anything else."""
    if not data or len(data) < 16:
        return None
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return ("png", *struct.unpack(">II", data[16:24]))
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return ("gif", *struct.unpack("<HH", data[6:10]))
        if data[:2] == b"BM":
            if data[14:18] == b"\x0c\0\0\0":  # the core header has sides of two bytes
                return ("bmp", *struct.unpack("<HH", data[18:22]))
            w, h = struct.unpack("<ii", data[18:26])
            return ("bmp", w, abs(h))
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            kind = data[12:16]
            if kind == b"VP8X":
                return ("webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"))
            if kind == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return ("webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF))
            w, h = struct.unpack("<HH", data[26:30])
            return ("webp", w & 0x3FFF, h & 0x3FFF)
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data):
                if data[at] != 0xFF:
                    return None
                mark = data[at + 1]
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return ("jpeg", w, h)
                at += 2 if mark == 0xFF or 0xD0 <= mark <= 0xD8 else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    except struct.error:
        pass
    return None


def image_sizes(df: DataFrame, column: str, output: str = "image") -> DataFrame:
    """Add ``struct<format,width,height>`` of each image; null where the bytes are no known image."""
    ship(df.sparkSession)
    kind = pa.struct([("format", pa.string()), ("width", pa.int32()), ("height", pa.int32())])

    @F.arrow_udf(returnType="struct<format:string,width:int,height:int>")
    def sizes(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in parts:
            found = [probe(x) for x in a.to_pylist()]
            yield pa.array([None if f is None else dict(zip(("format", "width", "height"), f)) for f in found], kind)

    return df.withColumn(output, sizes(F.col(column)))


def size_reason(image: str, min_width: int = 0, min_height: int = 0, min_side: int = 0, min_pixels: int = 0) -> Column:
    """Why an image is too small, or null; an unknown image is ``not_an_image``."""
    w, h = F.col(f"{image}.width"), F.col(f"{image}.height")
    return (
        F.when(F.col(image).isNull(), "not_an_image").when(w < min_width, "min_width").when(h < min_height, "min_height").when(F.least(w, h) < min_side, "min_side").when(w.cast("long") * h < min_pixels, "min_pixels")
    )
