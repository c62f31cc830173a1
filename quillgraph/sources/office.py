"""DOCX files as texts: a zip of XML, read in parallel with the standard library."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The namespace of word-processing documents, and the part that holds the text.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_BODY = "word/document.xml"
#: Bytes that a document's text part may unpack to.
MOST_BYTES = 256 << 20


def docx_text(data: bytes, most_bytes: int = MOST_BYTES) -> str:
    """The paragraphs of a document, one a line; tabs and breaks within them are kept."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if z.getinfo(_BODY).file_size > most_bytes:
            raise ValueError("the text is too large")
        raw = z.read(_BODY)
    if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw[:4096]:
        raise ValueError("entities are not allowed")
    lines = []
    for paragraph in ElementTree.fromstring(raw).iter(f"{_W}p"):
        parts = []
        for x in paragraph.iter():
            if x.tag == f"{_W}t":
                parts.append(x.text or "")
            elif x.tag == f"{_W}tab":
                parts.append("\t")
            elif x.tag in (f"{_W}br", f"{_W}cr"):
                parts.append("\n")
        lines.append("".join(parts))
    return "\n".join(lines)


def docx_files(spark: SparkSession, folder: str) -> DataFrame:
    """filename, file_size, text and error of the DOCX files below a folder: every file has a row,
    with its text or with the reason why it has none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(folder)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("file_size"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for data in batch.column("content"):
                try:
                    texts.append(docx_text(data.as_py()))
                    errors.append(None)
                except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError, NotImplementedError, RuntimeError) as e:
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pa.RecordBatch.from_arrays([batch.column("filename"), batch.column("file_size"), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["filename", "file_size", "text", "error"])

    return rows.mapInArrow(run, "filename string, file_size long, text string, error string")


def parsed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts and quarantine: the files that could be read (filename, file_size, text) and those that
    couldn't (filename, file_size, error). ``files`` should be stored, else both read them."""
    good = F.col("error").isNull()
    return files.filter(good).drop("error"), files.filter(~good).drop("text")
