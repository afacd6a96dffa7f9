"""File sources and sinks beyond tables: text, CSV, JSON lines, and Office documents and archives from binary files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest size in bytes by extension.
LIMITS = {"pdf": 100 << 20, "docx": 50 << 20, "pptx": 50 << 20, "ppt": 50 << 20, "txt": 10 << 20, "csv": 25 << 20, "xlsx": 25 << 20, "png": 10 << 20, "jpg": 10 << 20, "gif": 10 << 20, "webp": 10 << 20}


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, extension, length, content) of files of a known kind within its size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    most = F.create_map(*[F.lit(x) for p in LIMITS.items() for x in p])
    return files.withColumn("extension", ext).filter(F.col("length") <= F.try_element_at(most, F.col("extension"))).select("path", "extension", "length", "content")


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8, or Latin-1 where that fails; trimmed."""
    return F.trim(F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1")))


def text_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    return binary_files(spark, path, pattern).select("path", decoded(F.col("content")).alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType, since: str | None = None, ts: str = "ts") -> DataFrame:
    """Rows of JSON lines (a glob may name several files); lines that don't parse are left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.filter(F.col(ts) >= F.lit(since)) if since else rows


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def office_texts(files: DataFrame) -> DataFrame:
    """(path, text) of .docx, .pptx and .xlsx rows of ``binary_files``: one file a row, by the standard library.

    Paragraphs and slides are lines, cells of a row are joined by `` | ``. A file that is no such archive gives null.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [_office(e, c) for e, c in zip(pdf["extension"], pdf["content"])]})

    return files.select("path", "extension", "content").mapInPandas(run, "path string, text string")


def _office(extension: str, content: bytes) -> str | None:
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    tag = lambda e: e.tag.rpartition("}")[2]
    joined = lambda e: "".join(x.text or "" for x in e.iter() if tag(x) == "t")
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            number = lambda n: [int(x) for x in re.findall(r"\d+", n)]
            pages = {"docx": r"word/document\.xml", "pptx": r"ppt/slides/slide\d+\.xml", "xlsx": r"xl/worksheets/sheet\d+\.xml"}[extension]
            roots = [ElementTree.fromstring(z.read(n)) for n in sorted(z.namelist(), key=number) if re.fullmatch(pages, n)]
            if extension == "xlsx":
                known = [joined(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []

                def cell(c) -> str:
                    value = next((x.text or "" for x in c if tag(x) == "v"), joined(c))
                    return known[int(value)] if c.get("t") == "s" else value

                return "\n".join(" | ".join(cell(c) for c in row) for r in roots for row in r.iter() if tag(row) == "row")
            lines = []
            for r in roots:
                in_rows = {id(p) for row in r.iter() if tag(row) in ("tr",) for p in row.iter() if tag(p) == "p"}
                for e in r.iter():
                    if tag(e) == "tr":
                        lines.append(" | ".join(joined(c) for c in e if tag(c) == "tc"))
                    elif tag(e) == "p" and id(e) not in in_rows and joined(e):
                        lines.append(joined(e))
            return "\n".join(lines)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
