"""Reading uploaded files: dispatch by suffix, text decoding, DOCX and PDF."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.functions.text import page_count, remove_page_numbers, universal_newlines, word_count

SUFFIXES = {"txt": (".txt", ".text", ".md", ".markdown"), "docx": (".docx", ".doc"), "pdf": (".pdf",)}
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def parser_of(path: Column) -> Column:
    """txt, docx, pdf, or null for a file that no parser takes."""
    found = F.lit(None).cast("string")
    for name, kinds in SUFFIXES.items():
        found = F.when(suffix(path).isin(*kinds), name).otherwise(found)
    return found


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content and sha256 of files, for parse_files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def decode_text(data: bytes) -> str:
    """UTF-8, else UTF-16 where a byte-order mark says so, else Latin-1.

    Without the demand for a mark, many 8-bit files of even length would pass as UTF-16.
    """
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def decode_in_order(data: bytes, encodings: tuple[str, ...] = ("utf-8", "utf-16", "latin-1")) -> str:
    """The first of the encodings that takes the bytes. With UTF-16 among them an 8-bit file of even length may be read as it: see decode_text for what does not."""
    for encoding in encodings:
        try:
            return data.decode(encoding)
        except UnicodeError:
            continue
    raise ValueError(f"none of {', '.join(encodings)} takes the file")


def docx_text(data: bytes) -> str:
    """Paragraphs that aren't blank, then the rows of all tables, cells joined by ` | `."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{WORD}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{WORD}t"))
    lines = [t for p in body.findall(f"{WORD}p") if (t := text(p)).strip()]
    for table in body.findall(f"{WORD}tbl"):
        for row in table.iter(f"{WORD}tr"):
            lines.append(" | ".join("\n".join(text(p) for p in cell.iter(f"{WORD}p")).strip() for cell in row.findall(f"{WORD}tc")))
    return "\n".join(lines)


def pdf_text(data: bytes) -> str:
    """Text of a PDF's pages; needs pypdf, which need not be there."""
    try:
        from pypdf import PdfReader
    except ImportError:
        raise ValueError("no PDF library is installed") from None
    return "".join((page.extract_text() or "") + "\n" for page in PdfReader(io.BytesIO(data)).pages)


PARSERS = {"txt": decode_text, "docx": docx_text, "pdf": pdf_text}


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, errors = [], []
        for parser, content in zip(batch["parser"], batch["content"], strict=True):
            try:
                if parser not in PARSERS:
                    raise ValueError("no parser takes this file")
                text, error = PARSERS[parser](bytes(content)), None
                if not text.strip():
                    text, error = None, "the file has no text"
            except Exception as problem:
                text, error = None, str(problem)
            texts.append(text)
            errors.append(error)
        yield pd.DataFrame({"path": batch["path"], "parser": batch["parser"], "text": texts, "error": errors})


def parse_files(files: DataFrame) -> DataFrame:
    """path, parser, text, error, word_count, page_count; a file that fails has an error and no text."""
    rows = files.select("path", parser_of(F.col("path")).alias("parser"), "content")
    parsed = rows.mapInPandas(_parse, "path string, parser string, text string, error string")
    text = universal_newlines(F.col("text"))
    text = F.when(F.col("parser") == "pdf", remove_page_numbers(text)).otherwise(text)
    parsed = parsed.withColumn("text", text).withColumn("word_count", F.when(F.col("text").isNotNull(), word_count(F.col("text"))))
    return parsed.withColumn("page_count", page_count(F.col("word_count")))


