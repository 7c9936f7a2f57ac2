"""Files to text: dispatch by extension, decode ladder, rich text and word-processor files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The extensions that are accepted, and the largest file.
TEXT, RICH, WORD, PAGES, IMAGES = ("txt",), ("rtf",), ("docx",), ("pdf",), ("png", "jpg", "jpeg", "tiff", "bmp", "gif", "webp")
SUPPORTED = (*PAGES, "doc", *WORD, *TEXT, *RICH, *IMAGES)
MOST_BYTES = 16 << 20
ENCODINGS = ("utf-8-sig", "utf-16", "cp1252", "latin-1")


def extension(path: Column) -> Column:
    """Lower-cased extension, empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_supported(path: Column) -> Column:
    return extension(path).isin(*SUPPORTED)


def decode(content: bytes) -> str:
    """The first encoding of the ladder that reads all bytes."""
    for name in ENCODINGS:
        try:
            return content.decode(name)
        except UnicodeError:
            continue
    return ""


def strip_rich_text(text: str) -> str:
    """Escapes and control words go, braces go, white space becomes single blanks."""
    for pattern in (r"\\'[0-9a-fA-F]{2}", r"\\[a-zA-Z]+-?\d* ?", r"[{}]"):
        text = re.sub(pattern, " ", text)
    return re.sub(r"\s+", " ", text).strip()


def docx_text(content: bytes) -> str:
    """Paragraphs outside tables, then tables row by row, cells joined by `` | ``."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    lines = [words(p) for p in body.findall(f"{w}p")]
    for row in body.iter(f"{w}tr"):
        lines.append(" | ".join(c for c in (words(cell).strip() for cell in row.findall(f"{w}tc")) if c))
    return "\n".join(x for x in lines if x.strip())


def read_files(spark: SparkSession, path: str, reader: Callable[[str, bytes], str] | None = None) -> DataFrame:
    """(path, extension, text, error) of all files below ``path``; every file gives one row.

    Unsupported extensions, files over the size limit and formats that need a tool that is absent give an error instead of
    a text. ``reader`` reads what is not built in (pages and images); it gets extension and bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.select("path", "length", "content", extension(F.col("path")).alias("extension"))
    refused = F.when(~F.col("extension").isin(*SUPPORTED), "unsupported file type").when(F.col("length") > MOST_BYTES, "file too large")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, kind, content, no in zip(b["path"], b["extension"], b["content"], b["refused"], strict=True):
                text, error = None, no
                try:
                    if error is None and kind in TEXT:
                        text = decode(content)
                    elif error is None and kind in RICH:
                        text = strip_rich_text(decode(content))
                    elif error is None and kind in WORD:
                        text = docx_text(content)
                    elif error is None and reader:
                        text = reader(kind, content)
                    elif error is None:
                        error = f"no reader for {kind}"
                except Exception as e:  # one broken file must not end the job
                    error = f"{type(e).__name__}: {e}"
                rows.append((p, kind, text, error))
            yield pd.DataFrame(rows, columns=["path", "extension", "text", "error"])

    # the content of what is refused is not sent to Python
    files = files.withColumn("refused", refused).withColumn("content", F.when(F.col("refused").isNull(), F.col("content")).otherwise(F.lit(b"")))
    return files.select("path", "extension", "content", "refused").mapInPandas(run, "path string, extension string, text string, error string")
