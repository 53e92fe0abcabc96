"""Files as tables: text, Markdown, archives and EPUB books."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, path, text`` of whole text or Markdown files; the id is a hash of the path."""
    found = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return found.select(F.xxhash64("path").alias("doc_id"), "path", "text")


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``doc_id, path, content`` of whole files in the folder and below."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def archive_entries(files: DataFrame) -> DataFrame:
    """``doc_id, entry_idx, entry_name, content`` of every entry of the archives, in the archive's order."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                with zipfile.ZipFile(io.BytesIO(row.content)) as z:
                    names = z.namelist()
                    for k, name in enumerate(names):
                        yield pd.DataFrame({"doc_id": [row.doc_id], "entry_idx": [k], "entry_name": [name], "content": [z.read(name)]})

    return files.select("doc_id", "content").mapInPandas(work, "doc_id bigint, entry_idx int, entry_name string, content binary")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def spine(book: zipfile.ZipFile) -> list[str]:
    """Paths of a book's sections in reading order."""
    container = ElementTree.fromstring(book.read("META-INF/container.xml"))
    package = next(e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile")
    tree = ElementTree.fromstring(book.read(package))
    folder = posixpath.dirname(package)
    items = {e.get("id"): e.get("href") for e in tree.iter() if _local(e.tag) == "item"}
    order = [e.get("idref") for e in tree.iter() if _local(e.tag) == "itemref"]
    return [posixpath.normpath(posixpath.join(folder, unquote(items[i]))) for i in order if i in items]


def epub_sections(files: DataFrame) -> DataFrame:
    """``doc_id, section_idx, path, html, error``: sections in reading order, bytes that are no UTF-8 replaced.

    A file that is no readable book gives one row with the error and nothing else.
    """

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                try:
                    with zipfile.ZipFile(io.BytesIO(row.content)) as book:
                        found = [(k, p, book.read(p).decode("utf-8", "replace")) for k, p in enumerate(spine(book))]
                except Exception as e:  # any damage to one file must not stop the others
                    yield pd.DataFrame({"doc_id": [row.doc_id], "section_idx": [None], "path": [None], "html": [None], "error": [f"{type(e).__name__}: {e}"]})
                    continue
                yield pd.DataFrame({"doc_id": [row.doc_id] * len(found), "section_idx": [f[0] for f in found], "path": [f[1] for f in found], "html": [f[2] for f in found], "error": [None] * len(found)})

    return files.select("doc_id", "content").mapInPandas(work, "doc_id bigint, section_idx int, path string, html string, error string")
