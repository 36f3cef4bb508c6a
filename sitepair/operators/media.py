"""Media files: hashes with a cache, the plan of thumbnails and their making."""

from __future__ import annotations

import io
import os
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import write_csv


#: Files that are pictures.
IMAGE_TYPES = ("jpg", "jpeg", "png", "gif", "webp")


def images_only(files: DataFrame) -> DataFrame:
    return files.where(F.lower(F.substring_index("media", ".", -1)).isin(list(IMAGE_TYPES)) & F.col("media").contains("."))


#: The cache of hashes: size in bytes, time in microseconds.
CACHE = "media string, bytes long, modified long, sha1 string"


def _timed(files: DataFrame) -> DataFrame:
    return files.select("media", "bytes", F.unix_micros("modified").alias("modified"))


def unchanged(files: DataFrame, cache: DataFrame) -> DataFrame:
    """``media, bytes, modified, sha1`` of ``files(media, bytes, modified)`` whose size and time the cache knows."""
    return _timed(files).join(cache, ["media", "bytes", "modified"])


def changed(files: DataFrame, cache: DataFrame) -> DataFrame:
    """The files whose content must be read."""
    return _timed(files).join(cache, ["media", "bytes", "modified"], "left_anti")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Rows of four fields of which two are numbers; others are passed over. The last row of a file counts."""
    rows = spark.read.csv(path, schema="media string, bytes string, modified string, sha1 string, more string", header=True, multiLine=True, escape='"', mode="PERMISSIVE")
    numbered = rows.where("more is null and sha1 is not null").select("media", F.expr("try_cast(bytes AS long) AS bytes"), F.expr("try_cast(modified AS long) AS modified"), "sha1")
    return numbered.where("bytes is not null and modified is not null").dropDuplicates(["media"])


def write_cache(hashed: DataFrame, path: str) -> None:
    """Sorted by file; fields are not guarded, as no one opens it as a spreadsheet."""
    write_csv(hashed.select("media", "bytes", "modified", "sha1"), path, ["media"], guarded=False)


def make_thumbnails(planned: DataFrame, out: str, quality: int) -> DataFrame:
    """``media, error`` of each row of ``planned(media, content, new_width, new_height)``; a failure stops nothing."""

    def make(batches):
        for batch in batches:
            errors = [_thumbnail(bytes(c), f"{out}/{m}", w, h, quality) for m, c, w, h in zip(batch["media"], batch["content"], batch["new_width"], batch["new_height"], strict=True)]
            yield pd.DataFrame({"media": batch["media"], "error": errors})

    return planned.mapInPandas(make, "media string, error string")


def _thumbnail(content: bytes, path: str, width, height, quality: int) -> str | None:
    if pd.isna(width) or pd.isna(height):
        return "not a picture"
    try:
        from PIL import Image, ImageOps
    except ImportError:
        return "Pillow is not installed"
    try:
        picture = ImageOps.exif_transpose(Image.open(io.BytesIO(content))).resize((int(width), int(height)), Image.Resampling.LANCZOS)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        kind = {"jpg": "JPEG", "jpeg": "JPEG"}.get(path.rsplit(".", 1)[-1].lower(), path.rsplit(".", 1)[-1].upper())
        picture.save(path + ".tmp", kind, quality=quality)
        os.replace(path + ".tmp", path)
    except (OSError, ValueError) as e:
        return str(e)
    return None


def orientation(data: bytes) -> int:
    """The EXIF orientation of a JPEG, 1 to 8; 1 if it says none."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        block = data[at + 4 : at + 2 + size]
        if data[at + 1] == 0xE1 and block[:6] == b"Exif\0\0" and len(block) >= 14:
            tiff, order = block[6:], "<" if block[6:8] == b"II" else ">"
            first = struct.unpack(order + "I", tiff[4:8])[0]
            n = struct.unpack(order + "H", tiff[first : first + 2])[0] if first + 2 <= len(tiff) else 0
            for i in range(n):
                entry = tiff[first + 2 + 12 * i : first + 14 + 12 * i]
                if len(entry) == 12 and struct.unpack(order + "H", entry[:2])[0] == 0x0112:
                    value = struct.unpack(order + "H", entry[8:10])[0]
                    return value if 1 <= value <= 8 else 1
        at += 2 + size
    return 1


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height as shown, from the header of a PNG, GIF, WebP or JPEG: an orientation of 5 to 8 turns a picture."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return tuple(1 + int.from_bytes(data[i : i + 3], "little") for i in (24, 27))
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        return tuple(x & 0x3FFF for x in struct.unpack("<HH", data[26:30]))
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return (height, width) if orientation(data) >= 5 else (width, height)
        at += 2 + size
    return None


def thumbnail_plan(images: DataFrame, existing: DataFrame, max_width: int) -> DataFrame:
    """``media, width, height, new_width, new_height`` of images without a thumbnail; never enlarged. Sizes are null for
    what is no picture."""

    def sizes(batches):
        for batch in batches:
            found = [image_size(bytes(b)) or (None, None) for b in batch["content"]]
            yield pd.DataFrame({"media": batch["media"], "width": pd.array([f[0] for f in found], "Int32"), "height": pd.array([f[1] for f in found], "Int32")})

    rows = images.join(existing.select("media"), "media", "left_anti").select("media", "content").mapInPandas(sizes, "media string, width int, height int")
    wide = F.least("width", F.lit(max_width))
    tall = F.greatest(F.round(F.col("height") * wide / F.col("width")).cast("int"), F.lit(1))
    return rows.withColumn("new_width", F.when(F.col("width").isNotNull(), wide)).withColumn("new_height", F.when(F.col("height").isNotNull(), tall))
