"""File sources and sinks: delimited text, JSON lines, line ranges, listings, workbooks, and external databases."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import urlsplit
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import PIECE_ROWS, bound_batches
from .pdf import page_texts


def read_csv_strings(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8") -> DataFrame:
    """A delimited file with a header; every column is text."""
    return spark.read.csv(path, header=True, inferSchema=False, sep=delimiter, encoding=encoding, multiLine=True, escape='"')


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object a line; nulls are kept, and text isn't escaped to ASCII."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema=None, lines: bool = True) -> DataFrame:
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def export(df: DataFrame, path: str) -> None:
    """Sink by extension: .csv, .parquet, or JSON lines for .json, .jsonl and .ndjson."""
    ext = path.rstrip("/").rpartition(".")[2].lower()
    sinks = {"csv": write_csv, "parquet": write_parquet, "json": write_json_lines, "jsonl": write_json_lines, "ndjson": write_json_lines}
    if ext not in sinks:
        raise ValueError(f"no sink for .{ext}")
    sinks[ext](df, path)


def line_range(df: DataFrame, text_col: str, first: int, last: int) -> DataFrame:
    """Lines ``first``..``last`` (from 1, inclusive) of each text: the other columns, ``line_no`` and ``line``."""
    kept = [c for c in df.columns if c != text_col]
    return df.select(*kept, F.posexplode(F.split(text_col, "\n")).alias("_p", "line")).where(F.col("_p").between(first - 1, last - 1)).select(*kept, (F.col("_p") + 1).alias("line_no"), "line")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, size, modified, extension``; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"))


#: URL schemes of external databases.
DIALECTS = {"postgresql": "postgresql", "postgres": "postgresql", "mysql": "mysql", "mariadb": "mysql", "sqlite": "sqlite", "mssql": "mssql", "oracle": "oracle", "duckdb": "duckdb", "clickhouse": "clickhouse", "snowflake": "snowflake"}


def dialect(url: str) -> str:
    scheme = urlsplit(url).scheme.lower().split("+")[0]
    return DIALECTS.get(scheme, scheme or "unknown")


def read_sql(spark: SparkSession, url: str | None, query: str, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A query against registered views (no URL) or an external database, read in ranges of a column where given."""
    if not url:
        return spark.sql(query)
    reader = spark.read.format("jdbc").option("url", url)
    if partition:
        column, low, high, n = partition
        return reader.options(dbtable=f"({query}) q", partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=n).load()
    return reader.option("query", query).load()


#: Which parsers read which extensions.
PARSERS = {"txt": ("text",), "md": ("text",), "html": ("html",), "csv": ("table",), "json": ("json",), "xlsx": ("workbook",), "pdf": ("pdf",)}


def parser_compatibility(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e, p) for e, ps in PARSERS.items() for p in ps], "extension string, parser string")


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def workbook_cells(content: bytes) -> Iterator[tuple[str, int, str, str]]:
    """``sheet, row, cell, value`` of the non-empty cells of an .xlsx file, in order."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
        target = rels[sheet.get(f"{_REL}id")].lstrip("/")
        root = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
        for c in root.iter(f"{_NS}c"):
            kind, v = c.get("t"), c.find(f"{_NS}v")
            value = "".join(t.text or "" for t in c.iter(f"{_NS}t")) if kind == "inlineStr" else (v.text or "" if v is not None else "")
            if kind == "s" and value:
                value = shared[int(value)]
            if kind == "b" and value:
                value = "TRUE" if value == "1" else "FALSE"
            if value.strip():
                ref = c.get("r")
                yield sheet.get("name"), int(re.sub("[A-Z]", "", ref)), ref, value


def workbook_rows(content: bytes) -> Iterator[tuple[str, int, str]]:
    """``sheet, row, text``: a lone first cell is a title, the next row is the header, then ``header: value | ...``.

    With several sheets each text starts with the sheet's name in brackets.
    """
    sheets: dict[str, dict[int, dict[str, str]]] = {}
    for sheet, row, ref, value in workbook_cells(content):
        sheets.setdefault(sheet, {}).setdefault(row, {})[re.sub("[0-9]", "", ref)] = value
    for sheet, rows in sheets.items():
        prefix, header = (f"[{sheet}] " if len(sheets) > 1 else ""), None
        for row, cells in sorted(rows.items()):
            if header is None and len(cells) == 1 and row == min(rows):
                text = next(iter(cells.values()))
            elif header is None:
                header = cells
                text = " | ".join(cells.values())
            else:
                text = " | ".join(f"{header[k]}: {v}" if k in header else v for k, v in cells.items())
            yield sheet, row, prefix + text


def parsed(contents: DataFrame, read, schema: str) -> DataFrame:
    """The rows that ``read`` finds in each of ``path, content``, after the path."""
    names = [f.split(" ")[0] for f in schema.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64()}[f.split(" ")[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for b in batches:
            rows: list[tuple] = []
            for p, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                for r in read(content.as_py()):
                    rows.append((p, *r))
                    if len(rows) == PIECE_ROWS:
                        yield told(rows)
                        rows = []
            if rows:
                yield told(rows)

    bound_batches(contents.sparkSession)
    return contents.select("path", "content").mapInArrow(run, schema)


def contents_of(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def parsed_rows(contents: DataFrame) -> DataFrame:
    """``path, sheet, row, text`` of workbooks."""
    return parsed(contents, workbook_rows, "path string, sheet string, row long, text string")


def parsed_cells(contents: DataFrame) -> DataFrame:
    """``path, sheet, row, cell, value`` of workbooks; ``text`` is ``sheet cell: value``."""
    cells = parsed(contents, workbook_cells, "path string, sheet string, row long, cell string, value string")
    return cells.withColumn("text", F.concat("sheet", F.lit(" "), "cell", F.lit(": "), "value"))


def read_workbook_rows(spark: SparkSession, path: str) -> DataFrame:
    return parsed_rows(contents_of(spark, path, "*.xlsx"))


def read_workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    return parsed_cells(contents_of(spark, path, "*.xlsx"))


def parsed_pages(contents: DataFrame) -> DataFrame:
    """``path, page, text`` of PDF files."""
    return parsed(contents, page_texts, "path string, page long, text string")


def pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    return parsed_pages(contents_of(spark, path, "*.pdf"))
