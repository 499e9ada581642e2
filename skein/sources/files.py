"""Local files as documents: bytes decoded, tables found, quality scored, snapshots compared."""

from __future__ import annotations

import csv
import io
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from skein.functions.text import col, letter_share

#: Extensions by class of file (fixed values).
TEXT = ("txt", "md", "csv", "json", "xml", "html", "htm", "log", "rst", "yaml", "yml", "py", "ini", "cfg", "toml", "sh", "bat", "ps1", "sql", "r", "rb", "js", "ts", "css")
PDF = ("pdf",)
IMAGE = ("png", "jpg", "jpeg", "gif", "bmp", "tiff", "tif")
MEDIA = ("mp3", "wav", "ogg", "flac", "m4a", "mp4", "avi", "mov", "webm", "mkv")


def decode_bytes(data: bytes) -> str:
    """UTF-8, then UTF-16 with a mark, then Latin-1; never fails."""
    for encoding in ("utf-8", "utf-16") if data[:2] in (b"\xff\xfe", b"\xfe\xff") else ("utf-8",):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def csv_text(text: str) -> str:
    """A header line, and each row as ``Row i: column: value``."""
    rows = list(csv.reader(io.StringIO(text)))
    if not rows:
        return ""
    head = rows[0]
    lines = ["Columns: " + ", ".join(head)]
    for i, row in enumerate(rows[1:], 1):
        lines.append(f"Row {i}: " + ", ".join(f"{h}: {v}" for h, v in zip(head, row)))
    return "\n".join(lines)


def _texts(content: pd.Series, ext: pd.Series) -> pd.Series:
    return pd.Series([csv_text(decode_bytes(b)) if e == "csv" else decode_bytes(b) if e in TEXT else None for b, e in zip(content, ext)])


def text_of(content: str | Column, ext: Column) -> Column:
    return pandas_udf(_texts, "string")(col(content), ext)


def read_files(spark: SparkSession, path: str, most_bytes: int = 100 * 1024 * 1024, recursive: bool = True) -> DataFrame:
    """Files below ``path`` as documents: id from the path, text where it is text, class, and quality. Files above ``most_bytes`` are listed without text, at quality 0."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext.isin(*TEXT), "text").when(ext.isin(*PDF), "pdf").when(ext.isin(*IMAGE), "image").when(ext.isin(*MEDIA), "media")
    rows = raw.filter(~F.col("path").contains("..")).withColumn("ext", ext).withColumn("kind", kind).filter("kind IS NOT NULL")
    fits = F.col("length") <= most_bytes
    rows = rows.withColumn("text", F.when((F.col("kind") == "text") & fits, text_of(F.when(fits, F.col("content")), F.col("ext"))))
    quality = F.when(F.col("kind") == "text", F.when(F.length(F.trim("text")) < 10, 0.3).otherwise(0.95)).when(F.col("kind") == "pdf", F.when(F.coalesce(letter_share("text"), F.lit(0.0)) < 0.4, 0.5).otherwise(0.7)).otherwise(0.2)
    quality = F.when(fits, quality).otherwise(0.0)
    return rows.select(F.sha2("path", 256).alias("id"), "path", "ext", "kind", "length", "modificationTime", F.sha2("content", 256).alias("digest"), "text", quality.alias("quality"))


TABLES = "array<struct<table_id:int,row:int,col:int,value:string>>"


def find_tables(text: str) -> list[dict]:
    """Cells of tables in plain text: rows with two bars or more, or rows with tabs, at least two together."""
    out, block, kind, n = [], [], None, 0

    def close():
        nonlocal block, n
        if len(block) >= 2:
            for r, cells in enumerate(block):
                out.extend({"table_id": n, "row": r, "col": c, "value": v} for c, v in enumerate(cells))
            n += 1
        block = []

    for line in (text or "").split("\n") + [""]:
        now = "|" if line.count("|") >= 2 else "\t" if "\t" in line else None
        if now != kind:
            close()
            kind = now
        if now == "|" and not re.fullmatch(r"[\s|:+-]+", line):
            block.append([c.strip() for c in line.strip().strip("|").split("|")])
        elif now == "\t":
            block.append([c.strip() for c in line.split("\t")])
    close()
    return out


def tables_in(text: str | Column) -> Column:
    return pandas_udf(_tables, TABLES)(col(text))


def _tables(s: pd.Series) -> pd.Series:
    return s.map(find_tables)


def export(df: DataFrame, path: str, form: str = "json") -> None:
    """Rows as JSON lines or CSV with a header."""
    writer = df.write.mode("overwrite")
    writer.option("header", "true").csv(path) if form == "csv" else writer.json(path)
