"""Image files: width, height and orientation from their headers, without decoding.

files() reads a folder through Spark's binaryFile source; header() is an expression over their bytes and works on any binary column.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "format string, w int, h int, orientation int"
#: Fixed values of the formats: the first bytes, JPEG frame markers, markers without a length, the tag of the orientation.
PNG, JPEG = b"\x89PNG\r\n\x1a\n", b"\xff\xd8"
FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
BARE = {0x01, *range(0xD0, 0xD8)}
ORIENTATION = 0x0112


def _tiff_orientation(block: bytes) -> int | None:
    """The orientation in the first directory of a TIFF block; None if it has none or is cut short."""
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    try:
        (at,) = struct.unpack_from(f"{order}I", block, 4)
        (count,) = struct.unpack_from(f"{order}H", block, at)
        for k in range(count):
            tag, kind, _, value = struct.unpack_from(f"{order}HHIH", block, at + 2 + 12 * k)
            if tag == ORIENTATION and kind == 3:
                return value if 1 <= value <= 8 else None
    except struct.error:
        pass
    return None


def _png(data: bytes) -> tuple[str, int, int, int] | None:
    """The first chunk of a PNG holds its size; an eXIf chunk its orientation."""
    if len(data) < 26 or data[12:16] != b"IHDR":
        return None
    (w, h), at, turned = struct.unpack_from(">II", data, 16), 8, None
    while turned is None and at + 8 <= len(data):
        (length,) = struct.unpack_from(">I", data, at)
        if data[at + 4 : at + 8] == b"eXIf":
            turned = _tiff_orientation(data[at + 8 : at + 8 + length])
        at += 12 + length
    return ("png", w, h, turned or 1) if w and h else None


def _jpeg(data: bytes) -> tuple[str, int, int, int] | None:
    """Segments are walked through up to the frame, which holds the size; an Exif segment before it holds the orientation."""
    at, turned = 2, None
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF or marker in BARE:  # filler, or a marker by itself
            at += 1 if marker == 0xFF else 2
            continue
        (length,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + length]
        if marker in FRAMES:
            if len(body) < 5:
                return None
            h, w = struct.unpack_from(">HH", body, 1)
            return ("jpeg", w, h, turned or 1) if w and h else None
        if marker == 0xE1 and body[:6] == b"Exif\0\0" and turned is None:
            turned = _tiff_orientation(body[6:])
        if marker == 0xDA or length < 2:  # the picture begins, or the segment is broken
            return None
        at += 2 + length
    return None


def _headers(contents):
    import pyarrow as pa

    rows = []
    for content in contents:
        data = content.as_py() or b""
        rows.append(_png(data) if data[:8] == PNG else _jpeg(data) if data[:2] == JPEG else None)
    names = ["format", "w", "h", "orientation"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32()]
    columns = [pa.array([r[i] if r else None for r in rows], k) for i, k in enumerate(kinds)]
    return pa.StructArray.from_arrays(columns, names=names, mask=pa.array([r is None for r in rows]))


def header(content: Column) -> Column:
    """struct(format, w, h, orientation) of JPEG or PNG bytes, as stored; null for other and broken files, and for null."""
    return F.arrow_udf(_headers, HEADER)(content)


def files(spark: SparkSession, path: str, glob: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """path, bytes, format, w, h and orientation of the image files below a folder; Spark leaves out empty files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("length").alias("bytes"), header(F.col("content")).alias("_h")).select("path", "bytes", "_h.*")
