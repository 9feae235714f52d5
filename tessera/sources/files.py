"""Documents from files and databases.

Every reader gives content, source, title, timestamp, author, image. File readers go through
Spark's own sources, so paths of any file system work and files are read where the tasks are.
"""

from __future__ import annotations

import io
import json
import os
import warnings
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import TesseraError
from ..functions import scalar as S
from ..operators.documents import make_documents
from .sqlite import SqliteSource, opened, row_text

DOCUMENT = "content string, source string, title string, timestamp string, author string, image string"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _documents(rows: DataFrame, now: str | None) -> DataFrame:
    """rows: content, source (and title)."""
    title = F.col("title") if "title" in rows.columns else None
    return make_documents(rows, F.col("content"), F.col("source"), title, now=F.lit(now) if now else None)


def _whole(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select(F.regexp_replace("path", "^file:/+", "/").alias("source"), F.col("content").alias("data"))


def read_txt(spark: SparkSession, path: str, now: str | None = None, glob: str | None = None) -> DataFrame:
    """A document per file, trimmed; bytes that aren't UTF-8 are left out and empty files give none."""
    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"source": part["source"], "content": [bytes(b).decode("utf-8", "ignore").strip() for b in part["data"]]})

    rows = _whole(spark, path, glob).mapInPandas(decode, "source string, content string").filter("content <> ''")
    return _documents(rows, now)


def cell(value) -> str:
    """A cell's text as a data frame prints it."""
    if value is None or value != value:
        return "nan"
    return str(value)


def read_csv(spark: SparkSession, path: str, max_rows: int = 10_000, now: str | None = None) -> DataFrame:
    """A document per row: 'column: value' joined by ' | '; blank cells are left out, missing ones read nan. Rows count from 1."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', nullValue="", inferSchema=True).limit(max_rows)
    parts = [F.when(F.coalesce(S.strip(F.col(f"`{c}`").cast("string")), F.lit("nan")) != "", F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")))) for c in rows.columns]
    numbered = rows.select(F.monotonically_increasing_id().alias("_at"), F.concat_ws(" | ", *parts).alias("content"))
    numbered = numbered.select("content", F.row_number().over(Window.orderBy("_at")).alias("n")).filter("content <> ''")  # at most max_rows rows
    return _documents(numbered.select("content", F.concat(F.lit(f"{path}#row"), "n").alias("source"), F.lit(os.path.basename(path)).alias("title")), now)


def flatten_json(value) -> str:
    """'key: value' joined by ' | ' for objects, items joined by spaces for lists, else its spelling in Python."""
    if isinstance(value, dict):
        return " | ".join(f"{k}: {flatten_json(v)}" for k, v in value.items())
    if isinstance(value, list):
        return " ".join(map(flatten_json, value))
    return str(value)


def read_json(spark: SparkSession, path: str, now: str | None = None, glob: str | None = None) -> DataFrame:
    """A document per item of a top-level list (#item0 on), else one."""
    def load(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for source, data in zip(part["source"], part["data"], strict=True):
                value = json.loads(bytes(data).decode("utf-8", "ignore"))
                listed = [(f"{source}#item{i}", v) for i, v in enumerate(value)] if isinstance(value, list) else [(source, value)]
                rows += [(flatten_json(v), s, os.path.basename(source)) for s, v in listed]
            yield pd.DataFrame([r for r in rows if r[0].strip()], columns=["content", "source", "title"])

    return _documents(_whole(spark, path, glob).mapInPandas(load, "content string, source string, title string"), now)


def docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{_WORD}t")).strip() for p in root.iter(f"{_WORD}p"))
    return "\n\n".join(p for p in paragraphs if p)


def read_docx(spark: SparkSession, path: str, now: str | None = None, glob: str | None = None) -> DataFrame:
    """A document per file: its paragraphs that aren't blank, a blank line between them."""
    def load(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"source": part["source"], "content": [docx_text(bytes(b)) for b in part["data"]]})

    return _documents(_whole(spark, path, glob).mapInPandas(load, "source string, content string").filter("content <> ''"), now)


def read_pdf(spark: SparkSession, path: str, max_pages: int = 500, now: str | None = None, glob: str | None = None) -> DataFrame:
    """A document per page that has text, numbered among those from 1. Needs pymupdf."""
    try:
        import fitz  # noqa: F401
    except ImportError as e:
        raise TesseraError("pymupdf is needed to read this source", "dependency", source=path) from e

    def load(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for part in parts:
            rows = []
            for source, data in zip(part["source"], part["data"], strict=True):
                texts = (p.get_text().strip() for p, _ in zip(fitz.open(stream=bytes(data), filetype="pdf"), range(max_pages), strict=False))
                rows += [(t, f"{source}#page{i + 1}") for i, t in enumerate(t for t in texts if t)]
            yield pd.DataFrame(rows, columns=["content", "source"])

    return _documents(_whole(spark, path, glob).mapInPandas(load, "content string, source string"), now)


def read_sqlite(spark: SparkSession, path: str, table: str | None = None, query: str | None = None, max_rows: int = 10_000, now: str | None = None) -> DataFrame:
    """A document per row (#row0 on); cells that are null, zero or empty are left out. query wins and has no limit of rows, a table has.

    Ranges of a table's rows are read by tasks of their own, a query by one. All of them must see the file.
    """
    if not (table or query):
        raise TesseraError("give a table or a query", "ingest", source=path)
    if not query:
        spark.dataSource.register(SqliteSource)
        return _documents(spark.read.format(SqliteSource.name()).options(path=path, table=table, max_rows=max_rows).load(), now)

    def load(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in parts:
            with opened(path) as db:
                cursor = db.execute(query)
                names, at = [d[0] for d in cursor.description], 0
                while batch := cursor.fetchmany(5000):
                    rows = [(row_text(dict(zip(names, r, strict=True))), f"{path}#row{at + i}", "query") for i, r in enumerate(batch)]
                    at += len(batch)
                    yield pd.DataFrame([r for r in rows if r[0]], columns=["content", "source", "title"])

    return _documents(spark.range(1).coalesce(1).mapInPandas(load, "content string, source string, title string"), now)


def read_jdbc(spark: SparkSession, url: str, query: str, max_rows: int = 10_000, properties: dict | None = None, now: str | None = None) -> DataFrame:
    """A document per row of a query (#row0 on). The driver of the database must be on the class path."""
    if not query:
        raise TesseraError("give a query", "ingest", source=url)
    reader = spark.read.format("jdbc").option("url", url).option("query", query).option("fetchsize", 5000)
    rows = reader.options(**(properties or {})).load().limit(max_rows)
    parts = [F.when(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).isin("", "0", "0.0", "false"), None).otherwise(F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string"))) for c in rows.columns]
    numbered = rows.select(F.monotonically_increasing_id().alias("_at"), F.concat_ws(" | ", *parts).alias("content"))
    numbered = numbered.select("content", (F.row_number().over(Window.orderBy("_at")) - 1).alias("n")).filter("content <> ''")
    return _documents(numbered.select("content", F.concat(F.lit(f"{url}#row"), "n").alias("source"), F.lit("query").alias("title")), now)


READERS = {"pdf": read_pdf, "docx": read_docx, "txt": read_txt, "csv": read_csv, "json": read_json}


def ingest(spark: SparkSession, source: str, **options) -> DataFrame:
    """Documents of a source by its kind: sqlite://, postgresql:// or postgres://, a folder, or a file by its extension."""
    if source.startswith("sqlite://"):
        return read_sqlite(spark, source.replace("sqlite://", "", 1), **options)
    if source.startswith(("postgresql://", "postgres://")):
        return read_jdbc(spark, "jdbc:postgresql://" + source.split("://", 1)[1], **options)
    if _is_folder(spark, source):
        return ingest_folder(spark, source, **options)
    kind = source.rsplit(".", 1)[-1].lower() if "." in os.path.basename(source) else ""
    if kind not in READERS:
        raise TesseraError(f"no reader for .{kind}", "format", source=source)
    return READERS[kind](spark, source, **options)


def _is_folder(spark: SparkSession, path: str) -> bool:
    """On any file system that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def csv_rows(data: bytes, max_rows: int = 10_000) -> list[tuple[int, str]]:
    """(number from 1, text) of the rows of a CSV file."""
    rows = pd.read_csv(io.BytesIO(data), nrows=max_rows)
    texts = (" | ".join(f"{c}: {cell(v)}" for c, v in r.items() if cell(v).strip()) for r in rows.to_dict("records"))
    return [(i, t) for i, t in enumerate(texts, 1) if t]


def file_documents(source: str, data: bytes) -> list[tuple[str, str, str]]:
    """(content, source, title) of the documents of a text, CSV, JSON or DOCX file, by its extension."""
    name = os.path.basename(source)
    kind = name.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return [(t, f"{source}#row{i}", name) for i, t in csv_rows(data)]
    if kind == "json":
        value = json.loads(data.decode("utf-8", "ignore"))
        listed = [(f"{source}#item{i}", v) for i, v in enumerate(value)] if isinstance(value, list) else [(source, value)]
        return [(flatten_json(v), s, name) for s, v in listed if flatten_json(v).strip()]
    text = docx_text(data) if kind == "docx" else data.decode("utf-8", "ignore").strip()
    return [(text, source, name)] if text else []


def ingest_folder(spark: SparkSession, folder: str, now: str | None = None) -> DataFrame:
    """Documents of all files below a folder that have a reader, on any file system, in one pass of many tasks.

    Files that can't be read are left out, and PDFs where pymupdf is missing.
    """
    def load(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for source, data in zip(part["source"], part["data"], strict=True):
                try:
                    rows += file_documents(source, bytes(data))
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    warnings.warn(f"left out {source}: {e}", stacklevel=1)
            yield pd.DataFrame(rows, columns=["content", "source", "title"])

    found = _documents(_whole(spark, folder, "*.{txt,csv,json,docx,TXT,CSV,JSON,DOCX}").mapInPandas(load, "content string, source string, title string"), now)
    try:
        return found.unionByName(read_pdf(spark, folder, now=now, glob="*.{pdf,PDF}"))
    except TesseraError as e:
        if e.code != "dependency":
            raise
        warnings.warn(f"PDFs are left out: {e}", stacklevel=2)
        return found
