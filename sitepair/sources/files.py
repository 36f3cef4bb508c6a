"""Files of a site: the mirror and media as tables, and byte-exact inventories."""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"


def _relative(root: str):
    return F.regexp_replace("path", "^.*?" + _quoted(root.rstrip("/") + "/"), "")


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def scan(spark: SparkSession, root: str, glob: str = "*.html") -> DataFrame:
    """``rel_path, content, length, modified`` of the files below ``root``."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return rows.select(_relative(root).alias("rel_path"), "content", "length", F.col("modificationTime").alias("modified"))


def decode(rows: DataFrame, encoding: str | None = None) -> DataFrame:
    """``html`` of ``content``; bad bytes are replaced and a byte order mark dropped."""
    name = encoding or "utf-8"

    @F.pandas_udf("string")
    def text(content):
        return content.map(lambda b: bytes(b).decode(name, "replace").removeprefix(BOM))

    return rows.withColumn("html", text("content")).drop("content")


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``media, bytes, modified`` without the content."""
    return scan(spark, root, glob).select(F.col("rel_path").alias("media"), F.col("length").alias("bytes"), "modified")


def guard(value: str) -> str:
    return "'" + value if value[:1] in ("=", "+", "-", "@", "\t", "\r") and value else value


def csv_text(header: Iterable[str], rows: Iterable[Iterable], guarded: bool = True) -> str:
    """With a byte order mark and CRLF; a field is quoted only if it must be."""
    out = io.StringIO()
    for row in (header, *rows):
        cells = ["" if v is None else str(v) for v in row]
        cells = [guard(c) for c in cells] if guarded else cells
        out.write(",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n\r') else c for c in cells) + "\r\n")
    return BOM + out.getvalue()


def read_csv(text: str) -> list[list[str]]:
    return list(csv.reader(io.StringIO(text.removeprefix(BOM), newline="")))


def write_text(path: str, text: str) -> None:
    write_bytes(path, text.encode("utf-8"))


def write_bytes(path: str, data: bytes) -> None:
    """By a temporary file and a rename, so that no half-written file is left."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    held = path + ".tmp"
    try:
        with open(held, "wb") as f:
            f.write(data)
        os.replace(held, path)
    except BaseException:
        if os.path.exists(held):
            os.remove(held)
        raise


def write_csv(df: DataFrame, path: str, order: list[str], columns: list[str] | None = None, guarded: bool = True) -> None:
    """An inventory, sorted; rows come to the driver one partition at a time."""
    columns = columns or df.columns
    rows = df.orderBy(*order).select(*columns).toLocalIterator()
    write_text(path, csv_text(columns, rows, guarded))


def lines(text: str) -> list[str]:
    """Trimmed lines that aren't empty or comments."""
    return [x for x in map(str.strip, text.splitlines()) if x and not x.startswith("#")]
